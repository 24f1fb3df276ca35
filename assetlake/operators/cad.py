"""CAD solids: from decoded blobs to grid, edge and box rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import curation as Q

#: Blob columns of a CAD shard (short name: column).
BLOBS = {
    "face_points": "face_points_normalized", "face_mask": "face_mask", "face_types": "face_types", "edge_points": "edge_points_normalized",
    "face_bbox": "face_bbox_world", "edge_bbox": "edge_bbox_world", "face_edge": "face_edge_incidence",
}


def decode(cad: DataFrame) -> DataFrame:
    """Arrays and shapes under short names, ``invalid`` where any blob is broken, ``any_mask``."""
    from assetlake.sources.files import decode_npy_blobs

    d = decode_npy_blobs(cad, "stem", list(BLOBS.values()))
    out = d.select("stem", *[F.col(c + s).alias(n + s) for n, c in BLOBS.items() for s in ("", "_shape")], G.total(F.col(f"{c}_error").isNotNull().cast("int") for c in BLOBS.values()).alias("_bad"))
    return out.withColumn("invalid", F.col("_bad") > 0).withColumn("any_mask", F.exists("face_mask", lambda x: x != 0)).drop("_bad")


def _flat_boxes(name: str, bit: int) -> Column:
    """Whether some box of the array has all extents below 2^(1 - bit)."""
    tol, a = 2.0 ** (1 - bit), F.col(name)
    flat = lambda i: G.total((F.abs(F.get(a, i * 6 + k) - F.get(a, i * 6 + 3 + k)) < tol).cast("int") for k in range(3)) == 3
    return F.when(F.size(a) >= 6, F.exists(F.sequence(F.lit(0), F.expr(f"cast(size({name}) div 6 as int)") - 1), flat)).otherwise(False)


def prefilter(decoded: DataFrame, bit: int, max_edge: int) -> DataFrame:
    """``stem, reason`` of the rules on incidence and boxes; flags of the row are tested before decoding."""
    inc = decoded.where(F.size("face_edge_shape") == 2).select("stem", F.col("face_edge_shape")[1].alias("_e"), F.posexplode("face_edge").alias("i", "v"))
    inc = inc.select(F.col("stem").alias("solid"), F.expr("cast(i div _e as int)").alias("face"), (F.col("i") % F.col("_e")).alias("edge"), (F.col("v") != 0).alias("on"))
    s = Q.incidence_summary(inc).withColumnRenamed("solid", "stem")
    rows = decoded.select("stem", "invalid", F.size("face_edge_shape").alias("rank"), F.coalesce(F.size("face_edge"), F.lit(0)).alias("_n"), _flat_boxes("face_bbox", bit).alias("flat_face"), _flat_boxes("edge_bbox", bit).alias("flat_edge"))
    j = rows.join(s, "stem", "left").withColumns({"err": F.lit(False), "scaled_unique": F.lit(True), "faces": F.when(F.col("rank") == 0, 1).otherwise(F.coalesce("faces", F.lit(0)))})
    return j.select("stem", F.when(F.col("invalid"), None).otherwise(Q.prefilter_reason(max_edge)).alias("reason"))


def _box(name: str, i: Column) -> list[Column]:
    return [F.get(F.col(name), i * 6 + k).alias(f"{side}_{a}") for side, o in (("lo", 0), ("hi", 3)) for k, a in zip(range(o, o + 3), "xyz", strict=True)]


def face_grid(decoded: DataFrame) -> DataFrame:
    """``stem, face, row, col, x, y, z, valid, cls`` in world coordinates."""
    s = F.col("face_points_shape")
    rows = decoded.select("*", s[1].alias("_u"), s[2].alias("_v"), F.explode(F.sequence(F.lit(0), F.expr("cast(size(face_points) div 3 as int)") - 1)).alias("i"))
    rows = rows.withColumns({"face": F.expr("cast(i div (_u * _v) as int)"), "row": F.expr("cast((i div _v) % _u as int)"), "col": F.col("i") % F.col("_v")})
    xyz = [F.get("face_points", F.col("i") * 3 + k).cast("double").alias(a) for k, a in enumerate("xyz")]
    p = rows.select("stem", "face", "row", "col", *xyz, (F.get("face_mask", F.col("i")) != 0).alias("valid"), G.face_type_name(F.get("face_types", F.col("face"))).alias("cls"), *_box("face_bbox", F.col("face")))
    return _restored(p)


def edge_points(decoded: DataFrame) -> DataFrame:
    """``stem, edge, i, x, y, z`` in world coordinates."""
    rows = decoded.select("*", F.col("edge_points_shape")[1].alias("_p"), F.explode(F.sequence(F.lit(0), F.expr("cast(size(edge_points) div 3 as int)") - 1)).alias("k"))
    rows = rows.withColumns({"edge": F.expr("cast(k div _p as int)"), "i": F.col("k") % F.col("_p")})
    xyz = [F.get("edge_points", F.col("k") * 3 + j).cast("double").alias(a) for j, a in enumerate("xyz")]
    return _restored(rows.select("stem", "edge", "i", *xyz, *_box("edge_bbox", F.col("edge"))))


def _restored(p: DataFrame) -> DataFrame:
    half = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"]) / 2
    out = p.withColumns({a: F.col(a) * half + (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 for a in "xyz"})
    return out.drop(*[f"{s}_{a}" for s in ("lo", "hi") for a in "xyz"])
