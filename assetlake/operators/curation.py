"""CAD curation: why a solid is rejected, and how many are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none; a null condition does not hold."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return out


def incidence_summary(incidence: DataFrame, solid: str = "solid") -> DataFrame:
    """Per solid from (solid, face, edge, on) rows of the incidence matrix."""
    faces = incidence.groupBy(solid, "face").agg(F.bool_or("on").alias("any")).groupBy(solid).agg(F.count("*").alias("faces"), F.bool_or(~F.col("any")).alias("bare_face"))
    edges = incidence.groupBy(solid, "edge").agg(F.count_if("on").alias("k")).groupBy(solid).agg(F.count("*").alias("edges"), F.bool_or(F.col("k") != 2).alias("non_manifold"))
    return faces.join(edges, solid)


def degenerate(lo: list[str], hi: list[str], bit: int) -> Column:
    """A box all of whose extents are below 2^(1 - bit)."""
    tol = 2.0 ** (1 - bit)
    out = F.lit(True)
    for a, b in zip(lo, hi, strict=True):
        out = out & (F.abs(F.col(a) - F.col(b)) < tol)
    return out


def prefilter_reason(max_edge: int) -> Column:
    """Over columns err, scaled_unique, faces, edges, bare_face, non_manifold, flat_face, flat_edge (and rank)."""
    return first_reason([
        ("dataset_err", F.col("err")),
        ("scaled_unique_false", F.col("scaled_unique") == F.lit(False)),
        ("empty_face_edge_incidence", F.coalesce("faces", F.lit(0)) == 0),
        ("scalar_face_edge_incidence", F.col("rank") == 0),
        ("face_without_edges", F.col("bare_face")),
        ("non_manifold_edge_incidence", F.col("non_manifold")),
        ("too_many_edges", F.col("edges") > max_edge),
        ("degenerate_face_bbox", F.col("flat_face")),
        ("degenerate_edge_bbox", F.col("flat_edge")),
    ])


def shape_reason() -> Column:
    """Over the shapes of the seven decoded blobs (``<blob>_shape``), ``invalid`` and ``any_mask``."""
    s = lambda name: F.col(f"{name}_shape")
    rank = lambda name: F.size(s(name))
    dim = lambda name, i: F.try_element_at(s(name), F.lit(i + 1))
    faces, edges = dim("face_edge", 0), dim("face_edge", 1)
    return first_reason([
        ("invalid_blob", F.col("invalid")),
        ("invalid_face_grid_shape", rank("face_points") != 4),
        ("invalid_edge_grid_shape", rank("edge_points") != 3),
        ("invalid_face_bbox_shape", (rank("face_bbox") != 2) | (dim("face_bbox", 1) != 6)),
        ("invalid_edge_bbox_shape", (rank("edge_bbox") != 2) | (dim("edge_bbox", 1) != 6)),
        ("invalid_face_edge_shape", rank("face_edge") != 2),
        ("invalid_face_mask_shape", ~rank("face_mask").isin(3, 4)),
        ("invalid_face_types_shape", rank("face_types") != 1),
        ("face_grid_count_mismatch", dim("face_points", 0) != faces),
        ("face_bbox_count_mismatch", dim("face_bbox", 0) != faces),
        ("edge_grid_count_mismatch", dim("edge_points", 0) != edges),
        ("edge_bbox_count_mismatch", dim("edge_bbox", 0) != edges),
        ("face_mask_count_mismatch", dim("face_mask", 0) != faces),
        ("face_types_count_mismatch", dim("face_types", 0) != faces),
        ("empty_face_mask", ~F.col("any_mask")),
    ])


def quality_reason(max_components: int = 0, max_small_ratio: float = 1.0, low_ratio: tuple[float, float] = (0.0, 0.0), low_count: int = 0) -> Column:
    """Over component metrics; a guard at its default is off."""
    n = F.col("component_count")
    rules = [("empty_voxel_grid", F.col("total_voxels") == 0)]
    if max_components > 0:
        rules.append(("too_many_voxel_components", n > max_components))
    if low_count > 0:
        rules.append(("low_largest_component_ratio", F.col("largest_component_ratio").between(*low_ratio) & (n >= low_count)))
    if max_small_ratio < 1.0:
        rules.append(("too_many_small_components", F.col("small_component_ratio") > max_small_ratio))
    return first_reason(rules)


def status_counts(df: DataFrame, by: str, reason: str) -> DataFrame:
    """Rows per shard and reason with totals per shard and over all (null marks a total)."""
    return df.select(by, F.coalesce(reason, F.lit("kept")).alias("reason")).rollup(by, "reason").agg(F.count("*").alias("n"))
