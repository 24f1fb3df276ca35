"""Composite jobs: operators put together, each one plan or a few written stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import cad as C
from assetlake.operators import curation as Q
from assetlake.operators import manifest as M
from assetlake.operators import metrics as X
from assetlake.operators import points as P
from assetlake.operators import sampling as S
from assetlake.operators import views as W
from assetlake.operators import voxel as V
from assetlake.session import cut, materialize, spread
from assetlake.sources import files


@dataclass(frozen=True)
class Curation:
    """Limits of the curation rules; a guard at its default is off."""

    resolution: int = 64
    bit: int = 7
    max_edge: int = 1000
    max_components: int = 0
    max_small_ratio: float = 1.0
    low_ratio: tuple[float, float] = (0.0, 0.0)
    low_count: int = 0


def _numbered(stems: DataFrame) -> DataFrame:
    return M.with_global_index(stems.select("stem").distinct(), ["stem"], "b")


def quality_metrics(grid: DataFrame, stems: DataFrame, res: int) -> DataFrame:
    """Component metrics per stem of the voxels of densified faces."""
    ids = cut(_numbered(stems))
    p = W.densify_grid(grid, ["stem", "face"]).join(ids, "stem")
    v = V.cells(p, res).select("b", *[F.col(f"v{a}").alias(a) for a in "xyz"]).distinct()
    return V.component_metrics(cut(v), ids, res).join(ids, "b").drop("b")


def scan_candidates(cad: DataFrame, cfg: Curation) -> DataFrame:
    """Every row with its first reason (null: candidate) and component metrics where they were needed.

    Flags drop rows before any blob is decoded, and only what passes shapes and
    incidence is voxelised.
    """
    flags = Q.first_reason([("dataset_err", F.col("err")), ("scaled_unique_false", F.col("scaled_unique") == F.lit(False))])
    keyed = cad.withColumn("reason", flags)
    decoded = materialize(C.decode(keyed.where("reason is null")), "cad-decoded")
    shape = decoded.select("stem", Q.shape_reason().alias("s"))
    pre = C.prefilter(decoded, cfg.bit, cfg.max_edge).select("stem", F.col("reason").alias("p"))
    first = cut(pre.join(shape, "stem").select("stem", F.coalesce("p", "s").alias("reason")))
    good = decoded.join(first.where("reason is null").select("stem"), "stem", "left_semi")
    metrics = quality_metrics(cut(C.face_grid(good)), good, cfg.resolution)
    judged = metrics.withColumn("q", Q.quality_reason(cfg.max_components, cfg.max_small_ratio, cfg.low_ratio, cfg.low_count))
    out = keyed.select("stem", "parquet_index", "row_index", F.col("reason").alias("f")).join(first, "stem", "left").join(judged, "stem", "left")
    return out.withColumn("reason", F.coalesce("f", "reason", "q")).drop("f", "q")


def finalize_selection(candidates: DataFrame, target: int, reserve: int) -> DataFrame:
    """The first target + reserve candidates by place in the shards, with their rank."""
    return M.select_first(candidates, ["parquet_index", "row_index", "stem"], target, reserve)


def build_voxels(cad: DataFrame, selected: DataFrame, cfg: Curation, samples: int = 24) -> tuple[DataFrame, DataFrame]:
    """Labelled voxels with sampled points, and one status row per selected solid."""
    reasons = cut(scan_candidates(cad.join(selected.select("stem"), "stem", "left_semi"), cfg))
    good = reasons.where("reason is null").select("stem")
    decoded = materialize(C.decode(cad.join(good, "stem", "left_semi")), "cad-selected")
    grid = cut(C.face_grid(decoded))
    dense = W.densify_grid(grid, ["stem", "face"]).join(grid.select("stem", "face", "cls").distinct(), ["stem", "face"])
    p = cut(dense.withColumnRenamed("stem", "asset").withColumn("ord", F.struct("face", "kind", "row", "col")))
    edges = W.rasterize_polyline(C.edge_points(decoded).withColumnRenamed("stem", "asset"), ["asset", "edge"], ["i"], cfg.resolution)
    classes = V.majority_class(p, cfg.resolution, list(G.CLASS_ORDER), boundary=edges, default=G.DEFAULT_TYPE)
    v = V.cells(p, cfg.resolution).select("asset", "vx", "vy", "vz", "ord", "x", "y", "z")
    sampled = P.farthest_points(v, ["asset", "vx", "vy", "vz"], samples, ["ord"])
    arrays = sampled.groupBy("asset", "vx", "vy", "vz").agg(F.sort_array(F.collect_list(F.struct("slot", "x", "y", "z"))).alias("samples"))
    voxels = materialize(classes.join(arrays, ["asset", "vx", "vy", "vz"]), "voxels")
    nnz = voxels.groupBy(F.col("asset").alias("stem")).agg(F.count("*").alias("nnz"))
    status = selected.select("rank", "stem").join(reasons.select("stem", "reason"), "stem", "left").join(nnz, "stem", "left")
    quality = F.col("reason").isin("empty_voxel_grid", "too_many_voxel_components", "low_largest_component_ratio", "too_many_small_components")
    kind = F.when(F.col("reason").isNotNull() & quality, "skip_quality").when(F.col("reason").isNotNull(), "skip_prefilter").when(F.col("nnz") > 0, "success").otherwise("empty")
    return voxels, status.withColumn("status", kind)


def finalize_dataset(status: DataFrame, target: int, val: int) -> DataFrame:
    """Successful and cached rows in rank order with their split."""
    good = M.with_global_index(status.where(F.col("status").isin("success", "cached")), ["rank"], "place")
    return M.split_by_rank(good, "place", target, val).where("split is not null")


def prune_dataset(final: DataFrame, reasons: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept in split order, removed with reason, counts): nothing is written, so this is the dry run of ``prune_stored``."""
    removed = final.join(reasons.where("reason is not null").select(key, "reason"), key)
    counts = removed.groupBy("split", "reason").agg(F.count("*").alias("n"))
    return M.order_by_split(M.keep_unpruned(final, removed, key), "split", "rank"), removed, counts


def prune_stored(spark: SparkSession, path: str, reasons: DataFrame, key: str, tag: str, artifacts: dict[str, str] | None = None, dry_run: bool = True) -> DataFrame:
    """Prune the stored data set at ``path``; returns what goes, by split and reason.

    Without ``dry_run`` the table is replaced by the kept rows in split order, the old
    one stays as a backup named by ``tag``, and the removed keys go from each artefact
    table (name to path) likewise. Run again with the same tag, it finishes what is left.
    """
    if not dry_run and files.finish_swap(spark, path, tag):
        final = spark.read.parquet(f"{path}.backup-{tag}")
    else:
        final = spark.read.parquet(path)
    kept, removed, counts = prune_dataset(final, reasons, key)
    counts = cut(counts)
    if dry_run:
        return counts
    removed = cut(removed.select(key))
    for where in (artifacts or {}).values():
        if not files.finish_swap(spark, where, tag):
            files.delete_artifacts(spark.read.parquet(where), removed, key, where, tag, dry_run=False)
    if not files.finish_swap(spark, path, tag):
        files.replace_table(kept.drop("position"), path, tag)
    return counts


def build_manifest(published: DataFrame, records: DataFrame, listing: DataFrame, key: str, columns: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records merged, defaults set, flags derived from artefacts; and the statistics."""
    m = M.merge_records(published, records, key, columns, order)
    m = M.with_default_flags(m, ["rendered", "voxelized", "latent"])
    m = M.flag_from_artifacts(m, listing, key, "latent", ["rendered", "voxelized"])
    return m, M.manifest_statistics(m, ["local_path"], ["rendered", "voxelized", "latent"])


@dataclass(frozen=True)
class Cloud:
    """Settings of the point-cloud job."""

    step: float = 1e-5
    most: float = 1.0
    k: int = 16
    boundary: int | None = 0
    boundary_k: int = 24
    round_classes: tuple[int, ...] = (3, 6)
    tolerance: float = 0.25
    patch_k: int = 12
    patch_scale: float = 1.75
    patch_gap: int = 2
    patch_angle: float = 20.0
    curvature: tuple[int, float] = (1, 0.05)
    min_patch: int = 8
    classes: tuple[int, ...] = tuple(range(7))
    resolution: int = 64


def clean_cloud(samples: DataFrame, cfg: Cloud) -> DataFrame:
    """Points of labelled voxel samples (``asset, voxel, slot, cls, x, y, z``) with normals, radii and sources, written.

    Valid samples of each voxel, merged where voxels meet, numbered in each asset; normals
    from the class, at the boundary from all classes; refined on round classes.
    """
    # what follows goes by asset, so one exchange is enough
    samples = spread(samples, samples.count(), "asset")
    p = P.explode_samples(samples, cfg.step, ["asset", "voxel"], "slot", cfg.most)
    boundary = -1 if cfg.boundary is None else cfg.boundary
    p = P.merge_duplicates(p, cfg.step, "asset", boundary)
    place = Window.partitionBy("asset").orderBy("qx", "qy", "qz")
    p = materialize(p.withColumn("id", F.row_number().over(place) - 1).drop("qx", "qy", "qz"), "merged")
    pairs = cut(P.class_neighbours(p, "asset", cfg.k, cfg.boundary, cfg.boundary_k))
    n = cut(p.join(P.estimate_normals(p, pairs.drop("cls"), ["asset"]), ["asset", "id"], "left"))
    round_ = F.col("cls").isin(*cfg.round_classes)
    r = P.primitive_radius(n.where(round_ & F.col("normal").isNotNull()), pairs.where(round_), ["asset", "cls"])
    full = n.join(r, ["asset", "cls", "id"], "left")
    full = P.refine_normals(full, pairs.where(round_), ["asset", "cls"], cfg.round_classes, cfg.tolerance)
    return materialize(full.withColumn("normal_valid", F.col("normal").isNotNull()), "cloud")


def match_cloud(cloud: DataFrame, truth: DataFrame) -> DataFrame:
    """Each valid point with the nearest true point of its asset and class: ``dist``, ``angle`` of the normals, ``face``."""
    near = P.grid_knn(cloud.where("normal_valid"), truth, ["asset", "cls"], 1, own=("normal",), other=("normal", "face"))
    return cut(near.select("asset", "cls", "id", F.col("n_face").alias("face"), F.sqrt("d2").alias("dist"), G.vector_angle("normal", "n_normal").alias("angle")))


def grow_cloud(cloud: DataFrame, cfg: Cloud) -> DataFrame:
    """``asset, cls, id, patch_id`` of all points; the boundary has no patches."""
    full = cloud.withColumns({f"v{a}": G.cell(a, cfg.resolution) for a in "xyz"})
    e = P.patch_edges(full.where("normal_valid"), ["asset", "cls"], cfg.patch_k, cfg.patch_scale, cfg.patch_gap, cfg.patch_angle, cfg.curvature, (cfg.round_classes, cfg.tolerance))
    return cut(P.grow_patches(cloud, e, "asset", cfg.min_patch, cfg.boundary))


def point_cloud_report(samples: DataFrame, truth: DataFrame, cfg: Cloud) -> tuple[DataFrame, DataFrame]:
    """(one row per asset, angle report per class) of labelled samples against the true faces.

    ``truth`` has ``asset, cls, face, id, x, y, z, normal``. The rows hold the stage summary,
    matches with their mean distance and median angle, and the patches' purity (weighted
    by size) and the faces' completeness (weighted by points).
    """
    cloud = clean_cloud(samples, cfg)
    match = match_cloud(cloud, truth)
    patches = grow_cloud(cloud, cfg)
    summary = P.stage_summary(cloud.join(patches.select("asset", "id", "patch_id"), ["asset", "id"]), "asset", list(cfg.classes))
    fit = match.groupBy("asset").agg(F.count("*").alias("matched"), F.avg("dist").alias("mean_dist"), F.percentile("angle", F.lit(0.5)).alias("median_angle"))
    # faces are looked up by place in an asset, so that names of one are not those of another
    known = patches.join(match.select("asset", "id", "face"), ["asset", "id"])
    pure = P.patch_purity(known, ["asset"], "patch_id", "face").groupBy("asset").agg((F.sum(F.col("purity") * F.col("size")) / F.sum("size")).alias("purity"))
    whole = P.face_completeness(known, known, ["asset"], "patch_id", "face").groupBy("asset").agg((F.sum(F.col("completeness") * F.col("points")) / F.sum("points")).alias("completeness"))
    rows = summary.join(fit, "asset", "left").join(pure, "asset", "left").join(whole, "asset", "left").fillna(0, ["matched"])
    return rows, P.angle_report(match.select("cls", "dist", "angle"), list(cfg.classes))


def rank_cases(pred: DataFrame, gt: DataFrame, key: list[str], sample: str, cells: int, best: int, middle: int, worst: int, path: str | None = None) -> DataFrame:
    """Best, middle and worst samples by IoU, with all their metrics; ``path`` gets every sample as CSV.

    Both sides are occupied cells with ``cls`` and ``feats`` (an array of one length). Errors
    are taken over the true cells, a cell that isn't predicted has zeros.
    """
    m = X.occupancy_metrics(V.compare_voxels(pred, gt, key), sample, cells)
    m = m.join(X.class_accuracy(gt, pred, key, "cls", sample), sample, "left")
    both = gt.select(*key, F.col("feats").alias("_g")).join(pred.select(*key, F.col("feats").alias("_p")), key, "left")
    both = both.withColumn("_p", F.coalesce("_p", F.transform("_g", lambda x: x * 0)))
    width = F.size("_g")
    per = both.withColumn("_w", width).groupBy(sample).agg(F.max("_w").alias("_w"))
    mse = X.masked_mse(both, "_p", "_g", F.lit(True), 1, [sample]).join(per, sample).select(sample, (F.col("mse") / F.col("_w")).alias("mse"))
    m = cut(m.join(mse, sample, "left").withColumn("iou", F.round("iou", 9)))
    if path:
        files.write_metric_csv(m.orderBy(F.desc("iou"), sample), path)
    return X.pick_cases(m, [-F.col("iou"), F.col(sample)], best, middle, worst)


def latent_statistics(manifest: DataFrame, contents: DataFrame, key: str, field: str, n: int, seed: int, path: str, score: str | None = None, least: float = 0.0, stage: str | None = None, pooled: bool = False) -> DataFrame:
    """Channel moments over at most n eligible assets, chosen by seed, from their NPZ files; written as JSON to ``path``.

    ``contents`` are ``path, content`` with file names ``<key>.npz``; eligible are assets of the
    manifest with a score of at least ``least`` and the flag ``stage``. ``pooled`` takes the
    statistics with spreads averaged in place of pooled moments. Gives ``channel, mean, std``.
    """
    ok = M.filter_min_score(manifest, score, least) if score else manifest
    ok = ok.where(M.flag(stage)) if stage else ok
    chosen = ok.select(key).distinct().orderBy(S.seeded(seed, key), key).limit(n)
    named = contents.withColumn("_k", F.regexp_extract("path", r"([^/]+)\.npz$", 1))
    wanted = named.join(chosen.select(F.col(key).cast("string").alias("_k")), "_k", "left_semi").drop("_k")
    rows = files.decode_npz(wanted, field).where("values is not null")
    per = F.expr("aggregate(slice(shape, 2, size(shape) - 1), 1, (a, b) -> a * b)")  # positions of a channel
    flat = rows.select("asset", per.alias("_per"), F.posexplode("values").alias("i", "value"))
    flat = flat.select("asset", F.expr("cast(i div _per as int)").alias("channel"), F.expr("cast(i % _per as int)").alias("position"), F.col("value").cast("double").alias("value"))
    got = X.normalization_stats(flat, "asset").where("channel is not null") if pooled else X.latent_moments(flat, "asset")
    listed = got.agg(F.sort_array(F.collect_list(F.struct("channel", "mean", "std"))).alias("channels"))  # one entry a channel
    files.write_summary_json(listed, path)
    back = manifest.sparkSession.read.schema("channels array<struct<channel:int,mean:double,std:double>>").json(path)
    return back.select(F.inline("channels"))


def log_report(log: DataFrame, every: int, width: int = 10, norm: str = "grad_norm", percentile: float = 0.95, buffer: int = 1000, cap: float = 1.0, sign: str = "max") -> DataFrame:
    """One row a metric of a run log (``step, metric, value``), steps with a NaN left out.

    Statistics, the last step that improved on all before, windows of ``every`` steps, the
    mean of the last ``width`` values, for ``norm`` the clip threshold of the last step, and
    for time bins ``bin_i`` their number and mean.
    """
    clean = materialize(X.exclude_nan_steps(log.where("step is not null"), "step", "value"), "runlog")
    last = lambda df, c: df.groupBy("metric").agg(F.max_by(c, "step").alias(c))
    out = X.log_statistics(clean, "metric", "value")
    best = X.last_improvement(clean, ["metric"], "step", "value", sign).withColumnRenamed("step", "best_step")
    windows = X.log_rollup(clean, "step", "metric", "value", every).groupBy("metric").agg(F.count("*").alias("windows"))
    # what the last step looks back on is all that its mean and its threshold need
    ends = X.last_rows(clean, ["metric"], ["step"], width)
    smooth = last(X.moving_average(ends, ["metric"], ["step"], F.col("value"), width, "smooth"), "smooth")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    ends = X.last_rows(clean.where((F.col("metric") == norm) & finite), ["metric"], ["step"], buffer + 1)
    clip = last(X.adaptive_clip(ends, ["metric"], ["step"], "value", percentile, buffer, cap), "threshold")
    number = F.regexp_extract("metric", r"^bin_(\d+)$", 1)
    binned = clean.where(number != "").withColumn("t", (number.cast("double") + 0.5) / 10)
    bins = X.time_bin_mse(binned, "t", "value").select(F.concat(F.lit("bin_"), "bin").alias("metric"), "bin", F.col("mse").alias("bin_mse"))
    for part in (best, windows, smooth, clip, bins):
        out = out.join(part, "metric", "left")
    return out


def report_log(spark: SparkSession, path: str, **settings) -> DataFrame:
    """``log_report`` of run-log files."""
    return log_report(files.scan_run_log(spark, path), **settings)


@dataclass(frozen=True)
class Shards:
    """How training shards are dealt and what goes into them."""

    seed: int = 0
    epoch: int = 0
    world: int = 8
    batch: int = 4
    balanced: bool = False
    mean: tuple[float, ...] = (0.0,)
    std: tuple[float, ...] = (1.0,)
    per: int = 1


def training_shards(roots: dict[str, DataFrame], steps: list[tuple[str, Column]], key: str, cfg: Shards, load: str | None = None) -> DataFrame:
    """Eligible rows of all roots, dealt to ranks in the epoch's order, or by ``load`` in balanced batches."""
    every = M.concat_roots(roots).where(M.all_of([F.coalesce(c, F.lit(False)) for _, c in steps]))
    if cfg.balanced:
        dealt = S.balanced_batches(every, key, load, cfg.seed + cfg.epoch, cfg.batch, cfg.world)
        place = Window.partitionBy("chunk", "rank").orderBy(F.desc(load), key)
        dealt = dealt.select(key, "rank", (F.col("chunk") * cfg.batch + F.row_number().over(place) - 1).alias("slot"))
    else:
        dealt = S.sample_epoch(every.select(key), key, cfg.seed, cfg.epoch, cfg.world)
    return dealt.join(every, key)


def fill_training_shards(dealt: DataFrame, key: str, cfg: Shards, latent: str, captions: str, plain: str) -> tuple[DataFrame, DataFrame]:
    """(items with one caption, rows of the batches): what the ranks read.

    Each item takes one of its captions by seed, or the plain one where the list is not valid.
    Latents are standardised and batches of ``cfg.batch`` slots collated: ``rank, slot0, batch,
    key, channel, position, value``.
    """
    first, valid = X.parse_captions(F.col(captions), F.col(plain))
    rows = dealt.withColumns({"_first": first, "_valid": valid})
    told = rows.where("_valid").select(key, F.explode(F.from_json(captions, "array<string>")).alias("caption")).distinct()
    one = M.pick_one(told, key, "caption", cfg.seed)
    items = rows.join(one, key, "left").withColumn("caption", F.coalesce("caption", "_first")).drop("_first", "_valid")
    items = items.withColumn("slot0", F.expr(f"slot div {cfg.batch}"))
    scaled = items.select(key, F.posexplode(X.standardize(F.col(latent), list(cfg.mean), list(cfg.std), cfg.per)).alias("i", "v")).distinct()
    cells = scaled.select(F.col(key).alias("b"), F.expr(f"cast(i div {cfg.per} as int)").alias("x"), F.expr(f"cast(i % {cfg.per} as int)").alias("y"), F.lit(0).alias("z"), F.array("v").alias("feats"))
    groups = items.select(F.struct("rank", "slot0").alias("group"), F.col(key).alias("b"))
    stacked = V.collate(cells, groups)
    return items, stacked.select("group.rank", "group.slot0", "batch", F.col("b").alias(key), F.col("x").alias("channel"), F.col("y").alias("position"), F.col("feats")[0].alias("value"))


def write_training_shards(shards: DataFrame, path: str) -> None:
    """One folder a rank, rows in slot order."""
    ordered = shards.repartitionByRange("rank", "slot").sortWithinPartitions("rank", "slot")
    ordered.write.mode("overwrite").partitionBy("rank").parquet(path)

