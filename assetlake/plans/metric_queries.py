"""Queries on statistics, metrics and logs: ``embeddings`` are latents of 8 channels, ``events`` a run log."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import metrics as M
from assetlake.operators import voxel as V
from assetlake.plans.registry import Registry, Tables, r6

_LAT = "SELECT vec_id AS asset, (i // 8)::INT AS channel, (i % 8)::INT AS position, embedding[i+1]::DOUBLE AS value, label FROM embeddings, range(64) r(i)"
_PAIR = "SELECT vec_id AS asset, label, i::INT AS i, embedding[i+1]::DOUBLE AS a, embedding[i+33]::DOUBLE AS b FROM embeddings, range(32) r(i)"
_LOG = "SELECT event_id, event_type AS metric, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events"
_OUT = "SELECT asset, i, CASE WHEN a > 0 AND b > 0 THEN 'TP' WHEN a > 0 THEN 'FP' ELSE 'FN' END AS outcome FROM (<pair>) WHERE a > 0 OR b > 0".replace("<pair>", _PAIR)
R = Registry(lat=_LAT, pair=_PAIR, log=_LOG, out=_OUT)
QUERIES, ORACLES = R.queries, R.oracles


def latents(t: Tables):
    return M.channels(t.embeddings.withColumnRenamed("vec_id", "asset"), "asset", "embedding", 8)


def pairs(t: Tables):
    """First half against second half of each vector."""
    e = t.embeddings.select(F.col("vec_id").alias("asset"), "label", F.posexplode(F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))).alias("i", "p"))
    return e.select("asset", "label", "i", F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b"))


def log(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return t.events.select("event_id", F.col("event_type").alias("metric"), "ts", "value", (F.row_number().over(w) - 1).alias("step"))


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@R.query("latent_explode", "SELECT asset, channel, position, value FROM (<lat>)")
def latent_explode(t):
    return latents(t)


def npz_contents(t: Tables):
    """Vectors as NPZ contents, one an asset: ``path, content``."""

    @F.pandas_udf("binary")
    def npz(vectors: pd.Series) -> pd.Series:
        def one(v):
            out = io.BytesIO()
            np.savez(out, mean=np.asarray(v, np.float32).reshape(8, 8))
            return out.getvalue()

        return vectors.map(one)

    return t.embeddings.select(F.concat(F.lit("latents/"), "vec_id", F.lit(".npz")).alias("path"), npz("embedding").alias("content"))


@R.query("npz_roundtrip", "SELECT vec_id AS asset, i::INT AS position, embedding[i+1]::DOUBLE AS value FROM embeddings, range(64) r(i)")
def npz_roundtrip(t):
    """Vectors as NPZ contents, decoded again."""
    from assetlake.sources import files as S

    return S.decode_npz(npz_contents(t), "mean").select(F.col("asset").cast("long").alias("asset"), F.posexplode("values").alias("position", "v")).select("asset", "position", F.col("v").cast("double").alias("value"))


@R.query("score_stats", "SELECT asset, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS median FROM (<lat>) GROUP BY asset")
def score_stats(t):
    return rounded(M.score_stats(latents(t), "asset", "value"), 6, "mean", "std")


@R.query("linear_score", "SELECT vec_id, round(0.25 + list_sum(list_transform(embedding, lambda x, i: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 1e-12) * (i % 5 - 2))), 5) + 0.0 AS score FROM embeddings")
def linear_score(t):
    w = [(i + 1) % 5 - 2 for i in range(64)]
    return t.embeddings.select("vec_id", (F.round(M.linear_score(F.col("embedding"), w, 0.25), 5) + F.lit(0.0)).alias("score"))


@R.query("latent_moments", "SELECT channel, round(avg(m), 6) + 0.0 AS mean, round(sqrt(avg(m2) - avg(m) * avg(m)), 6) AS std FROM (SELECT asset, channel, avg(value) AS m, avg(value * value) AS m2 FROM (<lat>) GROUP BY ALL) GROUP BY channel")
def latent_moments(t):
    return rounded(M.latent_moments(latents(t), "asset"), 6, "mean", "std")


@R.query("norm_stats", "WITH p AS (SELECT asset, channel, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM (<lat>) GROUP BY GROUPING SETS ((asset, channel), (asset))) SELECT channel, round(avg(m), 6) + 0.0 AS mean, round(avg(s), 6) AS std, min(lo) AS min, max(hi) AS max FROM p GROUP BY channel")
def norm_stats(t):
    return rounded(M.normalization_stats(latents(t), "asset"), 6, "mean", "std")


@R.query("diagnostics", "SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS std, count(*) FILTER (WHERE abs(value) > 0.3) AS large FROM (<lat>)")
def diagnostics(t):
    return rounded(M.diagnostics(latents(t), "value", 0.3), 6, "mean", "std")


def outcomes(t: Tables):
    p = pairs(t)
    return V.compare_voxels(p.where("a > 0"), p.where("b > 0"), ["asset", "i"])


@R.query("voxel_outcomes", "<out>")
def voxel_outcomes(t):
    return outcomes(t)


@R.query("tp_fp_fn", "WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 2000), g AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT doc_id, CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 'TP' WHEN p.doc_id IS NOT NULL THEN 'FP' ELSE 'FN' END AS outcome FROM p FULL JOIN g USING (doc_id)")
def tp_fp_fn(t):
    return V.compare_voxels(t.documents.where("n_chars > 2000"), t.labels.where("quality = 1"), ["doc_id"])


@R.query("occ_metrics", "SELECT lang, round(i / (u + 1e-8), 6) AS iou, round(i / greatest(p, 1), 6) AS precision, round(i / greatest(g, 1), 6) AS recall, round(p / 64, 6) AS pred_ratio, round(g / 64, 6) AS gt_ratio FROM (SELECT lang, count(*) FILTER (WHERE p AND g) AS i, count(*) FILTER (WHERE p OR g) AS u, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE g) AS g FROM (SELECT lang, n_chars > 2000 AS p, coalesce(quality = 1, false) AS g FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang) WHERE u > 0")
def occ_metrics(t):
    d = t.documents.select("doc_id", "lang", "n_chars")
    o = V.compare_voxels(d.where("n_chars > 2000"), d.join(t.labels.where("quality = 1"), "doc_id", "left_semi"), ["lang", "doc_id"])
    return rounded(M.occupancy_metrics(o, "lang", 64), 6, "iou", "precision", "recall", "pred_ratio", "gt_ratio")


@R.query("occ_macro", "WITH s AS (SELECT asset, count(*) FILTER (WHERE outcome = 'TP') AS i, count(*) AS u, count(*) FILTER (WHERE outcome <> 'FN') AS p, count(*) FILTER (WHERE outcome <> 'FP') AS g FROM (<out>) GROUP BY asset) SELECT round(avg(i / (u + 1e-8)), 6) AS iou, round(avg(i / greatest(p, 1)), 6) AS precision, round(avg(i / greatest(g, 1)), 6) AS recall FROM s")
def occ_macro(t):
    m = M.occupancy_metrics(outcomes(t), "asset", 32)
    return rounded(M.macro(m, ["iou", "precision", "recall"]), 6, "iou", "precision", "recall")


@R.query("class_accuracy", "SELECT lang, round(avg((coalesce(toxic, 0) = CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END)::INT), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def class_accuracy(t):
    d = t.documents.select("doc_id", "lang", "n_chars")
    gt = t.labels.select("doc_id", F.col("toxic").alias("c")).join(d.select("doc_id", "lang"), "doc_id")
    pred = d.select("doc_id", "lang", (F.col("n_chars") > 3000).cast("int").alias("c"))
    return rounded(M.class_accuracy(gt, pred, ["doc_id", "lang"], "c", "lang"), 6, "accuracy")


@R.query("threshold_sweep", "WITH p AS (SELECT 1 / (1 + exp(-8 * a)) AS p, b > 0 AS g FROM (<pair>)), s AS (SELECT th, count(*) AS n, count(*) FILTER (WHERE p > th AND g) AS i, count(*) FILTER (WHERE p > th) AS k, count(*) FILTER (WHERE g) AS g FROM p, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS th) GROUP BY th) SELECT th AS threshold, round(i / (k + g - i + 1e-8), 6) AS iou, round(i / greatest(k, 1), 6) AS precision, round(i / greatest(g, 1), 6) AS recall, round(k / n, 6) AS pred_ratio FROM s")
def threshold_sweep(t):
    p = pairs(t).select(G.sigmoid(F.col("a") * 8).alias("p"), (F.col("b") > 0).alias("g"))
    return rounded(M.threshold_sweep(p, "p", "g", [i / 10 for i in range(1, 10)]), 6, "iou", "precision", "recall", "pred_ratio")


@R.query("masked_mse", "SELECT round(sum((a - b) * (a - b)) / count(*), 6) AS mse FROM (<pair>) WHERE label % 2 = 0")
def masked_mse(t):
    e = t.embeddings.select("label", F.slice("embedding", 1, 32).cast("array<double>").alias("a"), F.slice("embedding", 33, 32).cast("array<double>").alias("b"))
    return rounded(M.masked_mse(e, "a", "b", F.col("label") % 2 == 0, 32), 6, "mse")


@R.query("overlap_losses", "WITH p AS (SELECT 1 / (1 + exp(-8 * a)) AS p, (b > 0)::INT::DOUBLE AS g, 8 * a AS x FROM (<pair>)) SELECT round(1 - (2 * sum(p * g) + 1) / (sum(p) + sum(g) + 1), 6) AS dice, round(1 - (sum(p * g) + 1) / (sum(p * g) + 0.3 * sum(p * (1 - g)) + 0.7 * sum((1 - p) * g) + 1), 6) AS tversky, round(avg(2 * g * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) + (1 - g) * (greatest(x, 0) + ln(1 + exp(-abs(x))))), 6) AS bce FROM p")
def overlap_losses(t):
    p = pairs(t).select((F.col("a") * 8).alias("x"), (F.col("b") > 0).cast("double").alias("g"))
    o = M.overlap_losses(p, G.sigmoid("x"), F.col("g"), 0.3, 0.7)
    return rounded(o.crossJoin(p.agg(F.avg(M.bce_with_logits(F.col("x"), F.col("g"), 2.0)).alias("bce"))), 6, "dice", "tversky", "bce")


@R.query("cross_entropy", "SELECT vec_id, round(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label % 8 + 1], 5) + 0.0 AS ce, round(0.5 * (l[1] * l[1] + exp(l[2]) - 1 - l[2]), 6) + 0.0 AS kl FROM (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS l FROM embeddings)")
def cross_entropy(t):
    e = t.embeddings.select("vec_id", "label", F.slice("embedding", 1, 8).cast("array<double>").alias("l"))
    kl = M.gaussian_kl(F.col("l")[0], F.col("l")[1])
    return e.select("vec_id", (F.round(M.cross_entropy(F.col("l"), (F.col("label") % 8).cast("int")), 5) + F.lit(0.0)).alias("ce"), r6(kl).alias("kl"))


@R.query("pair_errors", "SELECT round(avg(abs(a - b)), 6) AS l1, round(avg((a - b) * (a - b)), 6) AS l2, round(avg(CASE WHEN abs(a - b) < 0.1 THEN 0.5 * (a - b) * (a - b) / 0.1 ELSE abs(a - b) - 0.05 END), 6) AS smooth_l1, round(20 * log10(1 / sqrt(avg((a - b) * (a - b)))), 5) AS psnr, round(avg((abs(a - b) <= 0.01)::INT), 6) AS within_abs, round(avg((abs(a - b) <= 0.1 * abs(b))::INT), 6) AS within_rel FROM (<pair>)")
def pair_errors(t):
    return rounded(rounded(M.pair_errors(pairs(t), F.col("a"), F.col("b"), 0.1, 0.01, 0.1), 6, "l1", "l2", "smooth_l1", "within_abs", "within_rel"), 5, "psnr")


@R.query("normal_angle", "WITH u AS (SELECT vec_id, i, embedding[3*i+1]::DOUBLE * 2 - 1 AS x, embedding[3*i+2]::DOUBLE * 2 - 1 AS y, embedding[3*i+3]::DOUBLE * 2 - 1 AS z FROM embeddings, range(2) r(i)) SELECT round(avg(degrees(acos(least(1, greatest(-1, (a.x*b.x + a.y*b.y + a.z*b.z) / (sqrt(a.x*a.x+a.y*a.y+a.z*a.z) * sqrt(b.x*b.x+b.y*b.y+b.z*b.z) + 1e-9)))))), 5) AS angle FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i = 0 AND b.i = 1")
def normal_angle(t):
    e = t.embeddings.select(F.slice("embedding", 1, 3).alias("a"), F.slice("embedding", 4, 3).alias("b"))
    return rounded(M.mean_normal_angle(e, "a", "b"), 5, "angle")


@R.query("time_bins", "WITH e AS (SELECT value, (event_id % 1000) / 1000.0::DOUBLE AS t FROM events), b AS (SELECT value, list_sum(list_transform([0, 1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: (t >= i * 0.1::DOUBLE)::INT)) + (t >= 1)::INT - 1 AS bin FROM e) SELECT bin::INT AS bin, round(avg(value), 6) AS mse, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin")
def time_bins(t):
    e = t.events.select(((F.col("event_id") % 1000) / 1000.0).alias("t"), "value")
    return rounded(M.time_bin_mse(e, "t", "value"), 6, "mse")


@R.query("noise_report", """WITH v AS (SELECT label % 10 / 10.0::DOUBLE AS t, avg((a-b)*(a-b)) AS mse, sum(a*b) / greatest(sqrt(sum(a*a)) * sqrt(sum(b*b)), 1e-8) AS cosine FROM (<pair>) GROUP BY asset, label), p AS (SELECT t, avg(mse) AS mse, avg(cosine) AS cosine FROM v GROUP BY t),
a AS (SELECT avg(CASE WHEN t <= 0.3::DOUBLE THEN mse END) AS low, avg(CASE WHEN t > 0.3::DOUBLE AND t <= 0.7::DOUBLE THEN mse END) AS mid, avg(CASE WHEN t > 0.7::DOUBLE THEN mse END) AS high FROM p)
SELECT t, round(mse, 6) AS mse, round(cosine, 6) + 0.0 AS cosine, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, coalesce(high > 5 * low, false) AS warn_high, coalesce(low > 0.1, false) AS warn_low FROM p, a""")
def noise_report(t):
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    mse = G.sum_of(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))) / 32
    v = t.embeddings.select((F.col("label") % 10 / 10.0).alias("t"), mse.alias("mse"), G.cosine(a, b).alias("cosine"))
    return rounded(M.noise_report(v, "t", "mse", "cosine"), 6, "mse", "cosine", "low", "mid", "high")


@R.query("log_eav", "SELECT step, 'loss' AS metric, value FROM (<log>) WHERE metric = 'error' UNION ALL SELECT step, 'bin_' || (step % 10), value / 2 FROM (<log>) WHERE metric = 'error' UNION ALL SELECT NULL, CASE WHEN event_id % 2 = 0 THEN 'miou_occ' ELSE 'miou' END, value FROM (<log>) WHERE metric = 'click'")
def log_eav(t):
    from assetlake.sources.files import parse_run_log

    l = log(t)
    num = lambda c: F.concat(F.lit("np.float64("), c.cast("string"), F.lit(")"))
    lines = l.where("metric = 'error'").select(F.concat(F.col("step").cast("string"), F.lit(": {'loss': "), num(F.col("value")), F.lit(", 'bin_"), (F.col("step") % 10).cast("string"), F.lit("': {'mse': "), num(F.col("value") / 2), F.lit("}}")).alias("value"))
    valid = l.where("metric = 'click'").select(F.concat(F.when(F.col("event_id") % 2 == 0, "Validation mIoU_occ: ").otherwise("Validation mIoU: "), F.col("value").cast("string")).alias("value"))
    return parse_run_log(lines.unionByName(valid))


@R.query("nan_steps", "WITH e AS (SELECT event_id // 7 AS step, event_id, CASE WHEN event_id % 50 = 3 THEN 'nan'::DOUBLE ELSE value END AS value FROM events) SELECT step, event_id, value FROM e WHERE step NOT IN (SELECT step FROM e WHERE isnan(value))")
def nan_steps(t):
    e = t.events.select(F.expr("event_id div 7").alias("step"), "event_id", F.when(F.col("event_id") % 50 == 3, float("nan")).otherwise(F.col("value")).alias("value"))
    return M.exclude_nan_steps(e, "step", "value")


@R.query("log_stats", "SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM (<log>) GROUP BY metric")
def log_stats(t):
    return rounded(M.log_statistics(log(t), "metric", "value"), 6, "mean", "std", "q1", "q2", "q3")


@R.query("log_rollup", "SELECT step // 100 AS \"window\", metric, round(avg(value), 6) AS mean, count(value) AS n FROM (<log>) GROUP BY ALL")
def log_rollup(t):
    return rounded(M.log_rollup(log(t), "step", "metric", "value", 100), 6, "mean")


@R.query("moving_avg", "SELECT metric, step, CASE WHEN step >= 9 THEN round(avg(value) OVER w, 6) END AS avg10, CASE WHEN step >= 9 THEN round(avg(ln(value + 1e-8)) OVER w, 6) + 0.0 END AS log10 FROM (<log>) WINDOW w AS (PARTITION BY metric ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", step="INT")
def moving_avg(t):
    a = M.moving_average(log(t), ["metric"], ["step"], F.col("value"), 10, "avg10")
    a = M.moving_average(a, ["metric"], ["step"], F.log(F.col("value") + 1e-8), 10, "log10")
    return a.select("metric", "step", F.round("avg10", 6).alias("avg10"), r6("log10").alias("log10"))


@R.query("adaptive_clip", "SELECT metric, step, round(coalesce(lag(th) OVER (PARTITION BY metric ORDER BY step), 100.0), 6) AS threshold FROM (SELECT metric, step, CASE WHEN step >= 19 THEN least(quantile_cont(value, 0.9) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 100.0) ELSE 100.0 END AS th FROM (<log>))", step="INT")
def adaptive_clip(t):
    c = M.adaptive_clip(log(t), ["metric"], ["step"], "value", 0.9, 20, 100.0)
    return rounded(c.select("metric", "step", "threshold"), 6, "threshold")


@R.query("running_best", "SELECT metric, step, value FROM (SELECT metric, step, value, max(value) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (<log>)) WHERE best IS NULL OR value > best", step="INT")
def running_best(t):
    return M.running_best(log(t), ["metric"], ["step"], "value").select("metric", "step", "value")


@R.query("usage_fit", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity * (1 - l_discount)) AS k, regr_intercept(l_extendedprice, l_quantity * (1 - l_discount)) AS b FROM lineitem) SELECT o_orderkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (40000 - b) / (k * (o_orderkey % 97 + 1)))), 5) AS ratio FROM orders, f")
def usage_fit(t):
    fit = M.fit_line(t.lineitem, F.col("l_extendedprice"), F.col("l_quantity") * (1 - F.col("l_discount")))
    s = t.orders.select("o_orderkey", (F.col("o_orderkey") % 97 + 1).alias("size"))
    return rounded(M.allowed_ratio(fit, s, "size", 40000.0), 5, "ratio").select("o_orderkey", "ratio")


@R.query("pick_cases", "WITH r AS (SELECT asset, row_number() OVER (ORDER BY s DESC, asset) - 1 AS p, count(*) OVER () AS n FROM (SELECT asset, round(avg(value), 6) AS s FROM (<lat>) GROUP BY asset)) SELECT asset, 'best' AS kind, p AS place FROM r WHERE p < 5 UNION ALL SELECT asset, 'middle', p - (n - 3) // 2 FROM r WHERE p >= (n - 3) // 2 AND p < (n - 3) // 2 + 3 UNION ALL SELECT asset, 'worst', n - 1 - p FROM r WHERE p >= n - 4")
def pick_cases(t):
    s = latents(t).groupBy("asset").agg(r6(F.avg("value")).alias("s"))
    return M.pick_cases(s, [-F.col("s"), F.col("asset")], 5, 3, 4).select("asset", "kind", "place")


@R.query("standardize", "WITH s AS (SELECT channel, CAST(channel AS DOUBLE) / 10 AS m, channel + 0.5 AS d FROM range(8) r(channel)) SELECT asset, channel, position, round((value - m) / d, 6) + 0.0 AS v, round(value, 5) + 0.0 AS back FROM (<lat>) JOIN s USING (channel)")
def standardize(t):
    mean, std = [i / 10 for i in range(8)], [i + 0.5 for i in range(8)]
    e = t.embeddings.select(F.col("vec_id").alias("asset"), M.standardize(F.col("embedding"), mean, std, 8).alias("s"))
    e = e.withColumn("o", M.unstandardize(F.col("s"), mean, std, 8))
    rows = e.select("asset", F.posexplode(F.arrays_zip("s", "o")).alias("i", "p"))
    return rows.select("asset", F.expr("cast(i div 8 as int)").alias("channel"), (F.col("i") % 8).alias("position"), r6("p.s").alias("v"), (F.round("p.o", 5) + F.lit(0.0)).alias("back"))


@R.query("activate", "WITH l AS (SELECT vec_id, embedding[1]::DOUBLE AS o, list_transform(embedding[2:8], lambda x: x::DOUBLE * 4) AS c FROM embeddings), s AS (SELECT vec_id, 1 / (1 + exp(-o)) AS occ, c, list_max(c) AS m FROM l) SELECT vec_id, round(occ, 6) AS occ, occ > 0.5 AS occupied, list_position(c, m)::INT - 1 AS class_id, round(1 / list_sum(list_transform(c, lambda x: exp(x - m))), 6) AS top FROM s")
def activate(t):
    e = t.embeddings.select("vec_id", G.sigmoid(F.col("embedding")[0].cast("double")).alias("occ"), F.transform(F.slice("embedding", 2, 7), lambda x: x.cast("double") * 4).alias("c"))
    p = G.softmax("c")
    return e.select("vec_id", F.round("occ", 6).alias("occ"), (F.col("occ") > 0.5).alias("occupied"), (F.array_position("c", F.array_max("c")) - 1).cast("int").alias("class_id"), F.round(F.array_max(p), 6).alias("top"))


@R.query("diffuse_pairs", "WITH p AS (SELECT asset, i, a, b, label % 10 / 10.0::DOUBLE AS t FROM (<pair>)) SELECT asset, i, round((1 - t) * a + (0.001::DOUBLE + 0.999::DOUBLE * t) * b, 6) + 0.0 AS xt, round(0.999::DOUBLE * b - a, 6) + 0.0 AS v, round(0.999::DOUBLE * ((1 - t) * a + (0.001::DOUBLE + 0.999::DOUBLE * t) * b) - (0.001::DOUBLE + 0.999::DOUBLE * t) * (0.999::DOUBLE * b - a), 6) + 0.0 AS x0 FROM p")
def diffuse_pairs(t):
    time = F.col("label") % 10 / 10.0
    a, e = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    d = t.embeddings.select(F.col("vec_id").alias("asset"), time.alias("t"), M.diffuse(a, e, time, 0.001).alias("xt"), M.velocity(a, e, 0.001).alias("v"))
    d = d.withColumn("x0", M.recover_x0(F.col("xt"), F.col("v"), F.col("t"), 0.001))
    return d.select("asset", F.posexplode(F.arrays_zip("xt", "v", "x0")).alias("i", "p")).select("asset", "i", *[r6(f"p.{c}").alias(c) for c in ("xt", "v", "x0")])


def _share(seed: str, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


@R.query("sample_t", f"SELECT vec_id, round(CASE WHEN {_share('5-3', 'vec_id')} < 0.8 THEN 1 / (1 + exp(-sqrt(-2 * ln({_share('5-0', 'vec_id')})) * cos(2 * pi() * {_share('5-1', 'vec_id')}))) ELSE {_share('5-2', 'vec_id')} END, 7) AS t FROM embeddings")
def sample_t(t):
    return rounded(M.sample_t(t.embeddings.select("vec_id"), "vec_id", "mixture", 5), 7, "t")


@R.query("drop_cond", f"SELECT doc_id, CASE WHEN {_share('3', 'doc_id')} < 0.1 THEN 'none' ELSE lang END AS lang FROM documents")
def drop_cond(t):
    return M.drop_condition(t.documents.select("doc_id", "lang"), "doc_id", "lang", F.lit("none"), 0.1, 3)


@R.query("mid_slice", "WITH p AS (SELECT asset, channel, position // 4 AS r, (position // 2) % 2 AS c, value FROM (<lat>) WHERE position % 2 = 1 AND channel < 3) SELECT asset, channel, r::INT AS row, c::INT AS col, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8), 6) AS v FROM p WINDOW w AS (PARTITION BY asset)")
def mid_slice(t):
    return rounded(M.mid_slice(latents(t), "asset", (2, 2, 2)), 6, "v")


@R.query("splat_stats", "WITH s AS (SELECT asset, label, a AS o, abs(b) AS p, abs(a) + 0.1 AS s0, abs(b) + 0.1 AS s1 FROM (<pair>)) SELECT label, round(avg(o), 6) + 0.0 AS offset_mean, max(o) AS offset_max, min(o) AS offset_min, round(avg(greatest(s0, s1)), 6) AS scale_mean, round(max(greatest(s0, s1)), 6) AS scale_max, round(min(greatest(s0, s1)), 6) AS scale_min, round(avg(p), 6) AS opacity_mean, max(p) AS opacity_max, min(p) AS opacity_min, round(avg(s0 * s1 * s0), 6) AS volume_mean, round(avg((p - 1) * (p - 1)), 6) AS opacity_loss FROM s GROUP BY label")
def splat_stats(t):
    s0, s1 = F.abs("a") + 0.1, F.abs("b") + 0.1
    s = pairs(t).select("label", F.col("a").alias("offset"), F.array(s0, s1, s0).alias("scale"), F.abs("b").alias("opacity"))
    return rounded(M.splat_stats(s, "label"), 6, "offset_mean", "scale_mean", "scale_max", "scale_min", "opacity_mean", "volume_mean", "opacity_loss")


@R.query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS is_list FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.json_array_length("props").isNotNull().alias("is_list"))


@R.query("parse_captions", "SELECT event_id, event_type || '-' || user_id AS caption, event_id % 9 <> 0 AS valid FROM events")
def parse_captions(t):
    text = F.when(F.col("event_id") % 9 == 0, "not a list").otherwise(F.to_json(F.array(F.concat_ws("-", "event_type", "user_id"), F.lit("x"))))
    e = t.events.select("event_id", F.concat_ws("-", "event_type", "user_id").alias("plain"), text.alias("captions"))
    caption, valid = M.parse_captions(F.col("captions"), F.col("plain"))
    return e.select("event_id", caption.alias("caption"), valid.alias("valid"))


@R.query("flatten_json", "SELECT event_id, 'a/k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events")
def flatten_json(t):
    e = t.events.select("event_id", F.to_json(F.struct(F.from_json("props", "k long").alias("a"), F.col("event_type").alias("type"))).alias("j"))
    return M.flatten_json(e, "event_id", "j")


@R.query("merge_leaves", "SELECT event_id, 'a/k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events UNION ALL SELECT event_id, 'a/user', user_id::VARCHAR FROM events")
def merge_leaves(t):
    one = t.events.select("event_id", F.to_json(F.struct(F.from_json("props", "k long").alias("a"), F.col("event_type").alias("type"))).alias("j"))
    two = t.events.select("event_id", F.to_json(F.struct(F.struct(F.col("user_id").alias("user")).alias("a"))).alias("j"))
    return M.merge_leaves(M.flatten_json(one, "event_id", "j"), M.flatten_json(two, "event_id", "j"), "event_id")


_DEEP = """j AS (SELECT event_id, json_object('a', json_object('k', json_extract(props, '$.k'), 'b', json_object('c', json_object('d', json_object('e', user_id, 'l', json_array(1, event_id))))), 'type', event_type, 'none', NULL) AS v FROM events),
t AS (SELECT event_id, '' AS path, v FROM j UNION ALL SELECT event_id, CASE WHEN path = '' THEN k ELSE path || '/' || k END, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT'))"""


def deep(t: Tables):
    e = F.struct(F.col("user_id").alias("e"), F.array(F.lit(1), "event_id").alias("l"))
    inner = F.struct(F.struct(F.struct(e.alias("d")).alias("c")).alias("b"))
    a = F.struct(F.from_json("props", "k long")["k"].alias("k"), inner["b"].alias("b"))
    return t.events.select("event_id", F.to_json(F.struct(a.alias("a"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"}).alias("j"))


@R.query("flatten_deep", f"WITH RECURSIVE {_DEEP} SELECT event_id, path, json_extract_string(v, '$') AS value FROM t WHERE json_type(v) <> 'OBJECT'")
def flatten_deep(t):
    return M.flatten_json(deep(t), "event_id", "j")


@R.query("usage_fit_recent", "WITH r AS (SELECT * FROM lineitem ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 1000) SELECT round(regr_slope(l_extendedprice, l_quantity * (1 - l_discount)), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity * (1 - l_discount)), 4) AS intercept, count(*) AS n FROM r")
def usage_fit_recent(t):
    fit = M.fit_line(t.lineitem, F.col("l_extendedprice"), F.col("l_quantity") * (1 - F.col("l_discount")), 1000, [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")])
    return rounded(fit, 4, "slope", "intercept")


@R.query("reduce_own", "SELECT metric, round(CASE metric WHEN 'click' THEN sqrt(avg(value * value)) WHEN 'error' THEN max(value) WHEN 'view' THEN arg_max(value, step) ELSE avg(value) END, 6) AS value FROM (<log>) GROUP BY metric")
def reduce_own(t):
    """Leaves of the log by reductions of one's own and by named ones, chosen by path."""
    from assetlake.functions.udf import UserAggregate, reduce_leaves

    rms = UserAggregate(lambda: (0, 0.0), lambda s, steps, v: (s[0] + len(v), s[1] + float((v * v).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: (s[1] / s[0]) ** 0.5)
    last = UserAggregate(lambda: (-1, 0.0), lambda s, steps, v: max(s, (int(steps[steps.argmax()]), float(v[steps.argmax()]))), max, lambda s: s[1])
    got = reduce_leaves(log(t).select("step", "metric", "value"), "metric", "value", special={"click": rms, "view": last, "error": "max"})
    return rounded(got, 6, "value")


@R.query("log_eav_all", """WITH l AS (SELECT event_id, metric AS kind, step, value FROM (<log>)) SELECT event_id AS step, unnest(['loss', 'grad_norm', 'bin_' || event_id % 10]) AS metric, unnest([value, value * 2, value / 2]) AS value FROM l
UNION ALL SELECT NULL, CASE WHEN event_id % 2 = 0 THEN 'miou_occ' ELSE 'miou' END, value FROM l""")
def log_eav_all(t):
    """All events as step lines, and as validation lines."""
    from assetlake.sources.files import parse_run_log

    v = F.col("value")
    num = lambda c: F.concat(F.lit("np.float64("), c.cast("string"), F.lit(")"))
    lines = t.events.select(F.concat(F.col("event_id").cast("string"), F.lit(": {'loss': "), num(v), F.lit(", 'grad_norm': "), num(v * 2), F.lit(", 'bin_"), (F.col("event_id") % 10).cast("string"), F.lit("': {'mse': "), num(v / 2), F.lit("}}")).alias("value"))
    valid = t.events.select(F.concat(F.when(F.col("event_id") % 2 == 0, "Validation mIoU_occ: ").otherwise("Validation mIoU: "), v.cast("string")).alias("value"))
    return parse_run_log(lines.unionByName(valid))


@R.query("cross_entropy_all", "SELECT vec_id, round(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label % 64 + 1], 5) + 0.0 AS ce FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings)")
def cross_entropy_all(t):
    """Over all 64 values as logits."""
    ce = M.cross_entropy(F.col("embedding").cast("array<double>"), (F.col("label") % 64).cast("int"))
    return t.embeddings.select("vec_id", (F.round(ce, 5) + F.lit(0.0)).alias("ce"))


@R.query("activate_all", "WITH l AS (SELECT vec_id, g::INT AS g, embedding[8 * g + 1]::DOUBLE AS o, list_transform(embedding[8 * g + 2:8 * g + 8], lambda x: x::DOUBLE * 4) AS c FROM embeddings, range(8) r(g)), s AS (SELECT vec_id, g, 1 / (1 + exp(-o)) AS occ, c, list_max(c) AS m FROM l) SELECT vec_id, g, round(occ, 6) AS occ, occ > 0.5 AS occupied, list_position(c, m)::INT - 1 AS class_id, round(1 / list_sum(list_transform(c, lambda x: exp(x - m))), 6) AS top FROM s")
def activate_all(t):
    """Every eight values an occupancy and seven classes."""
    e = t.embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("g"))
    e = e.select("vec_id", "g", G.sigmoid(F.col("embedding")[F.col("g") * 8].cast("double")).alias("occ"), F.transform(F.slice("embedding", F.col("g") * 8 + 2, F.lit(7)), lambda x: x.cast("double") * 4).alias("c"))
    return e.select("vec_id", "g", F.round("occ", 6).alias("occ"), (F.col("occ") > 0.5).alias("occupied"), (F.array_position("c", F.array_max("c")) - 1).cast("int").alias("class_id"), F.round(F.array_max(G.softmax("c")), 6).alias("top"))


@R.query("normal_angle_all", "WITH u AS (SELECT vec_id, i, embedding[3*i+1]::DOUBLE * 2 - 1 AS x, embedding[3*i+2]::DOUBLE * 2 - 1 AS y, embedding[3*i+3]::DOUBLE * 2 - 1 AS z FROM embeddings, range(21) r(i)) SELECT round(avg(degrees(acos(least(1, greatest(-1, (a.x*b.x + a.y*b.y + a.z*b.z) / (sqrt(a.x*a.x+a.y*a.y+a.z*a.z) * sqrt(b.x*b.x+b.y*b.y+b.z*b.z) + 1e-9)))))), 5) AS angle FROM u a JOIN u b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 21")
def normal_angle_all(t):
    """All 21 normals of a vector, each against the next."""
    e = t.embeddings.select("embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    at = lambda i: F.slice("embedding", i * 3 + 1, F.lit(3))
    return rounded(M.mean_normal_angle(e.select(at(F.col("i")).alias("a"), at((F.col("i") + 1) % 21).alias("b")), "a", "b"), 5, "angle")


@R.query("dense_layouts", """SELECT vec_id AS b, x::INT AS x, y::INT AS y, z::INT AS z, c::INT AS channel, v FROM (
  SELECT vec_id, c, x, y, z, embedding[CASE WHEN vec_id % 2 = 0 THEN c * 8 + x * 4 + y * 2 + z ELSE (x * 4 + y * 2 + z) * 8 + c END + 1]::DOUBLE AS v FROM embeddings, range(8) a(c), range(2) d(x), range(2) e(y), range(2) f(z)) WHERE v <> 0""")
def dense_layouts(t):
    """Vectors as tensors of 2 x 2 x 2 cells with their 8 channels first or last."""
    first = F.col("vec_id") % 2 == 0
    shape = F.when(first, F.array(*[F.lit(x) for x in (8, 2, 2, 2)])).otherwise(F.array(*[F.lit(x) for x in (2, 2, 2, 8)]))
    v = V.from_layout(t.embeddings.select("vec_id", shape.alias("shape"), F.col("embedding").alias("values")), "vec_id")
    return v.select("b", "x", "y", "z", F.posexplode("feats").alias("channel", "v")).where("v <> 0")
