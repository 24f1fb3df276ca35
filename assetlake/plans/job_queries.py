"""Composite jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import manifest as M
from assetlake.plans import jobs as J
from assetlake.plans.manifest_queries import manifest, scratch
from assetlake.plans.metric_queries import _LAT, _PAIR, npz_contents, pairs, rounded
from assetlake.plans.point_queries import cloud, points
from assetlake.plans.registry import Registry

_MAN = "SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
R = Registry(man=_MAN, lat=_LAT, pair=_PAIR)
QUERIES, ORACLES = R.queries, R.oracles


@R.query("job_manifest", """WITH m AS (SELECT d.doc_id, d.lang AS local_path, l.doc_id IS NOT NULL AS rendered, coalesce(l.quality = 1, false) AS voxelized, l.doc_id IS NOT NULL AND coalesce(l.quality = 1, false) AND d.doc_id % 2 = 0 AS latent FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'total' AS metric, count(*) AS n FROM m UNION ALL SELECT 'has_local_path', count(local_path) FROM m UNION ALL SELECT 'rendered', count(*) FILTER (WHERE rendered) FROM m UNION ALL SELECT 'voxelized', count(*) FILTER (WHERE voxelized) FROM m UNION ALL SELECT 'latent', count(*) FILTER (WHERE latent) FROM m""")
def job_manifest(t):
    none = F.lit(None).cast("boolean")
    published = t.documents.select("doc_id", F.col("lang").alias("local_path"), none.alias("rendered"), none.alias("voxelized"), none.alias("latent"), F.col("n_chars").alias("num_voxels"))
    records = t.labels.select("doc_id", F.lit(True).alias("rendered"), F.when(F.col("quality") == 1, True).alias("voxelized"), F.lit(0).alias("shard"))
    listing = t.documents.where("doc_id % 2 = 0").select("doc_id")
    return J.build_manifest(published, records, listing, "doc_id", ["rendered", "voxelized"], ["shard"])[1]


@R.query("job_prune", """WITH f AS (SELECT doc_id, quality, CASE WHEN r < 40 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM (<man>)) WHERE r < 180), x AS (SELECT *, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low' END AS reason FROM f)
SELECT split, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY ALL""")
def job_prune(t):
    m = manifest(t)
    final = M.split_by_rank(M.with_global_index(m.select("doc_id"), ["doc_id"], "rank"), "rank", 180, 40).where("split is not null")
    reasons = m.select("doc_id", F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "low").alias("reason"))
    return J.prune_dataset(final, reasons, "doc_id")[2]


@R.query("job_prune_live", """WITH f AS (SELECT doc_id, quality, CASE WHEN r < 40 THEN 'val' ELSE 'train' END AS split, r AS rank FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM (<man>)) WHERE r < 180)
SELECT doc_id, split, rank, true AS stored FROM f WHERE quality = 1 UNION ALL SELECT doc_id, 'artifact', 0, true FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE quality IS NULL OR quality = 0)""")
def job_prune_live(t):
    m, data, latents = manifest(t), scratch(t, "dataset"), scratch(t, "latents")
    final = M.split_by_rank(M.with_global_index(m.select("doc_id"), ["doc_id"], "rank"), "rank", 180, 40).where("split is not null")
    final.write.parquet(data)
    t.documents.select("doc_id").write.parquet(latents)
    reasons = m.select("doc_id", F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "low").alias("reason"))
    J.prune_stored(t.spark, data, reasons, "doc_id", "001", {"latents": latents}, dry_run=False)
    left = t.spark.read.parquet(data).select("doc_id", "split", "rank", F.lit(True).alias("stored"))
    return left.unionByName(t.spark.read.parquet(latents).select("doc_id", F.lit("artifact").alias("split"), F.lit(0).cast("long").alias("rank"), F.lit(True).alias("stored")))


@R.query("job_rank_cases", """WITH c AS (SELECT asset, i, a, b, (a > 0.1::DOUBLE)::INT AS pc, (b > 0.1::DOUBLE)::INT AS gc FROM (<pair>) WHERE a > 0 OR b > 0),
s AS (SELECT asset, count(*) FILTER (WHERE a > 0 AND b > 0) AS tp, count(*) FILTER (WHERE a > 0) AS p, count(*) FILTER (WHERE b > 0) AS g, count(*) AS u,
  avg((a > 0 AND pc = gc)::INT) FILTER (WHERE b > 0) AS accuracy, avg(((CASE WHEN a > 0 THEN a ELSE 0 END - b) ** 2 + (CASE WHEN a > 0 THEN 2 * a ELSE 0 END - 2 * b) ** 2) / 2) FILTER (WHERE b > 0) AS mse FROM c GROUP BY asset),
m AS (SELECT asset, round(tp / (u + 1e-8), 9) AS iou, tp / greatest(p, 1) AS precision, tp / greatest(g, 1) AS recall, accuracy, mse FROM s), r AS (SELECT *, row_number() OVER (ORDER BY iou DESC, asset) - 1 AS p, count(*) OVER () AS n FROM m),
k AS (SELECT *, 'best' AS kind, p AS place FROM r WHERE p < 4 UNION ALL SELECT *, 'middle', p - (n - 4) // 2 FROM r WHERE p >= (n - 4) // 2 AND p < (n - 4) // 2 + 4 UNION ALL SELECT *, 'worst', n - 1 - p FROM r WHERE p >= n - 4 UNION ALL SELECT *, 'csv', p FROM r)
SELECT asset, kind, place, round(iou, 6) AS iou, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(mse, 6) AS mse FROM k""")
def job_rank_cases(t):
    """The chosen cases, and every sample as the CSV has it."""
    p, path = pairs(t), scratch(t, "ranked")
    side = lambda c: p.where(f"{c} > 0").select("asset", "i", (F.col(c) > 0.1).cast("int").alias("cls"), F.array(F.col(c), F.col(c) * 2).alias("feats"))
    chosen = J.rank_cases(side("a"), side("b"), ["asset", "i"], "asset", 32, 4, 4, 4, path)
    csv = t.spark.read.option("header", True).schema(chosen.drop("kind", "place").schema).csv(path)
    every = M.with_global_index(csv.withColumn("_o", -F.col("iou")), ["_o", "asset"], "place").withColumn("kind", F.lit("csv"))
    out = chosen.unionByName(every.select(*chosen.columns))
    return rounded(out, 6, "iou", "precision", "recall", "accuracy", "mse").select("asset", "kind", "place", "iou", "precision", "recall", "accuracy", "mse")


@R.query("job_latent_statistics", """WITH c AS (SELECT asset FROM (SELECT DISTINCT asset FROM (<lat>) WHERE label % 2 = 0 AND label >= 3) ORDER BY md5('21|' || CAST(asset AS VARCHAR)), asset LIMIT 50), p AS (SELECT asset, channel, avg(value) AS m, avg(value * value) AS m2, stddev_pop(value) AS s FROM (<lat>) SEMI JOIN c USING (asset) GROUP BY ALL)
SELECT channel, 'moments' AS kind, round(avg(m), 6) + 0.0 AS mean, round(sqrt(avg(m2) - avg(m) * avg(m)), 6) AS std FROM p GROUP BY channel UNION ALL SELECT channel, 'spreads', round(avg(m), 6) + 0.0, round(avg(s), 6) FROM p GROUP BY channel""")
def job_latent_statistics(t):
    """From NPZ contents to the JSON summary, with both statistics."""
    manifest_ = t.embeddings.select("vec_id", F.col("label").cast("double").alias("score"), (F.col("label") % 2 == 0).alias("latent"))
    args = (manifest_, npz_contents(t), "vec_id", "mean", 50, 21)
    got = [J.latent_statistics(*args, scratch(t, "statistics"), "score", 3.0, "latent", pooled).withColumn("kind", F.lit(kind)) for kind, pooled in (("moments", False), ("spreads", True))]
    return rounded(got[0].unionByName(got[1]), 6, "mean", "std").select("channel", "kind", "mean", "std")


_RUN = """SELECT event_id AS step, unnest(['loss', 'grad_norm', 'bin_' || event_id % 10]) AS metric, unnest([value, value / 2, value / 4]) AS value FROM events WHERE event_id % 89 <> 7"""


@R.query("job_log_report", f"""WITH e AS ({_RUN}), s AS (SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS q2, count(DISTINCT step // 50) AS windows FROM e GROUP BY metric),
b AS (SELECT metric, max(step) AS best_step FROM (SELECT metric, step, value, min(value) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e) WHERE best IS NULL OR value < best GROUP BY metric),
a AS (SELECT metric, round(arg_max(v, step), 6) AS smooth FROM (SELECT metric, step, avg(value) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY metric ORDER BY step) AS k FROM e) WHERE k >= 10 GROUP BY metric),
h AS (SELECT metric, step, least(quantile_cont(value, 0.9) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 100.0) AS th FROM e WHERE metric = 'grad_norm'),
c AS (SELECT metric, round(arg_max(v, step), 6) AS threshold FROM (SELECT metric, step, lag(th) OVER (PARTITION BY metric ORDER BY step) AS v FROM h) GROUP BY metric)
SELECT metric, n, mean, std, max, q2, best_step, windows, smooth, threshold, CASE WHEN metric LIKE 'bin%' THEN metric[5:]::INT END AS bin, CASE WHEN metric LIKE 'bin%' THEN mean END AS bin_mse FROM s JOIN b USING (metric) LEFT JOIN a USING (metric) LEFT JOIN c USING (metric)""")
def job_log_report(t):
    """The events as lines of a run log, some with NaN, read back and reported."""
    path = scratch(t, "runlog")
    e, v = t.events, F.col("value")
    text = lambda c: F.format_string("np.float64(%s)", c.cast("string"))
    loss = F.when(F.col("event_id") % 89 == 7, F.lit("nan")).otherwise(v.cast("string"))
    line = F.concat(F.col("event_id").cast("string"), F.lit(": {'loss': "), loss, F.lit(", 'grad_norm': "), text(v / 2), F.lit(", 'bin_"), (F.col("event_id") % 10).cast("string"), F.lit("': {'mse': "), text(v / 4), F.lit("}}"))
    e.select(line.alias("value")).write.text(path)
    got = J.report_log(t.spark, path, every=50, percentile=0.9, buffer=20, cap=100.0, sign="min")
    got = rounded(got, 6, "mean", "std", "q2", "smooth", "threshold", "bin_mse")
    return got.select("metric", "n", "mean", "std", "max", "q2", "best_step", "windows", "smooth", "threshold", F.col("bin").cast("int").alias("bin"), "bin_mse")


_SHARD = """e AS (SELECT vec_id AS id, label, embedding, CASE WHEN vec_id % 9 = 0 THEN ['plain ' || vec_id] ELSE ['first ' || vec_id, 'second ' || label] END AS captions FROM embeddings WHERE label <= 7),
o AS (SELECT *, row_number() OVER (ORDER BY md5('8|' || CAST(id AS VARCHAR)), id) - 1 AS pos, count(*) OVER () AS n FROM e),
w AS (SELECT * FROM o UNION ALL SELECT * REPLACE (pos + n AS pos) FROM o WHERE pos < (4 - n % 4) % 4),
i AS (SELECT id, embedding, (pos % 4)::INT AS rank, pos // 4 AS slot, list_sort(list_transform(captions, lambda c: {'o': md5('6|' || id || '|' || c), 'c': c}))[1].c AS caption FROM w)"""


@R.query("job_training_shards", f"""WITH {_SHARD}, g AS (SELECT *, slot // 3 AS slot0, row_number() OVER (PARTITION BY rank, slot // 3 ORDER BY id) - 1 AS batch FROM i)
SELECT id, rank, slot, caption, slot0, batch, round(list_sum(list_transform(embedding, lambda v, k: (v::DOUBLE - ((k - 1) // 8) / 10.0::DOUBLE) / ((k - 1) // 8 + 0.5::DOUBLE))), 5) AS total, 64 AS values FROM g""", batch="INT", slot0="BIGINT", values="BIGINT")
def job_training_shards(t):
    """Two roots to shards on disk: items with a caption, and their collated latents added up."""
    listed = F.when(F.col("vec_id") % 9 == 0, "no list").otherwise(F.to_json(F.array(F.concat(F.lit("first "), "vec_id"), F.concat(F.lit("second "), "label"))))
    e = t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding", listed.alias("captions"), F.concat(F.lit("plain "), "vec_id").alias("plain"))
    cfg = J.Shards(6, 2, 4, 3, False, tuple(i / 10 for i in range(8)), tuple(i + 0.5 for i in range(8)), 8)
    dealt = J.training_shards({"even": e.where("id % 2 = 0"), "odd": e.where("id % 2 = 1")}, [("known", F.col("label") <= 7)], "id", cfg)
    items, rows = J.fill_training_shards(dealt, "id", cfg, "embedding", "captions", "plain")
    at, batches = scratch(t, "shards"), scratch(t, "batches")
    J.write_training_shards(items.select("id", "rank", "slot", "slot0", "caption"), at)
    J.write_training_shards(rows.withColumn("slot", F.col("slot0")), batches)
    sums = t.spark.read.parquet(batches).groupBy("rank", "slot0", "batch", "id").agg(F.round(F.sum("value"), 5).alias("total"), F.count("*").alias("values"))
    return t.spark.read.parquet(at).join(sums, ["rank", "slot0", "id"]).select("id", "rank", "slot", "caption", "slot0", "batch", "total", "values")


def samples_and_truth(t):
    """Embeddings as clouds: samples in voxels, some twice, and true points with normals on three faces a class."""
    p = points(t).withColumn("voxel", F.expr("slot div 3"))
    again = p.where("slot % 5 = 0").withColumns({"voxel": F.col("voxel") + 100, "slot": F.col("slot") + 50})
    truth = cloud(t).select("asset", "cls", F.expr("slot div 7").alias("face"), "id", *[(F.col(a) + 0.01).alias(a) for a in "xyz"], "normal")
    return p.unionByName(again).select("asset", "voxel", "slot", "cls", "x", "y", "z"), truth


CLOUD = J.Cloud(most=10.0, k=5, boundary=0, boundary_k=6, round_classes=(2,), tolerance=0.5, patch_k=4, patch_scale=1.5, patch_gap=4, patch_angle=60.0, curvature=(1, 0.3), min_patch=2, classes=(0, 1, 2), resolution=14)


@R.query("job_point_cloud")
def job_point_cloud(t):
    return J.point_cloud_report(*samples_and_truth(t), CLOUD)[0]


@R.query("hilbert_order")
def hilbert_order(t):
    from assetlake.operators import voxel as V
    from assetlake.plans.voxel_queries import voxels

    v = voxels(t).select("b", "x", "y", "z")
    return V.serialize_windows(v, 64, G.hilbert_code("x", "y", "z", 4)).select("b", "window", "slot", "x", "y", "z", "valid")
