"""Dataset statistics, evaluation metrics and run-log analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.session import cut


def score_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """mean, sample std, min, max and lower median of an asset's views."""
    median = F.expr(f"percentile_disc(0.5) within group (order by {value})")
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), median.alias("median"))


def linear_score(vector: Column, weights: list[float], bias: float) -> Column:
    """Bias plus weights times the vector scaled to length one."""
    return G.dot(G.unit(vector), F.array(*[F.lit(float(w)) for w in weights])) + bias


def channels(df: DataFrame, asset: str, vector: str, positions: int) -> DataFrame:
    """Long form (asset, channel, position, value) of a latent stored channel by channel."""
    rows = df.select(asset, F.posexplode(vector).alias("_i", "value"))
    return rows.select(asset, F.floor(F.col("_i") / positions).cast("int").alias("channel"), (F.col("_i") % positions).alias("position"), F.col("value").cast("double").alias("value"))


def latent_moments(rows: DataFrame, asset: str) -> DataFrame:
    """Per channel: mean over assets of asset means, and sqrt(mean of mean squares - mean^2)."""
    per = rows.groupBy(asset, "channel").agg(F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("m2"))
    got = per.groupBy("channel").agg(F.avg("m").alias("mean"), F.avg("m2").alias("m2"))
    return got.select("channel", "mean", F.sqrt(F.greatest(F.col("m2") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))


def normalization_stats(rows: DataFrame, asset: str) -> DataFrame:
    """Averages over assets of mean and population std, per channel and over whole assets (null channel), with the global range."""
    per = rows.groupingSets([[F.col(asset), F.col("channel")], [F.col(asset)]], asset, "channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return per.groupBy("channel").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def diagnostics(df: DataFrame, value: str, limit: float = 10.0) -> DataFrame:
    return df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count_if(F.abs(value) > limit).alias("large"))


def occupancy_metrics(outcomes: DataFrame, by: str, cells: int) -> DataFrame:
    """IoU (+1e-8 below), precision, recall (denominators at least 1) and shares of the grid, from TP / FP / FN rows."""
    n = lambda *k: F.count_if(F.col("outcome").isin(*k))
    inter, union, pred, gt = n("TP"), n("TP", "FP", "FN"), n("TP", "FP"), n("TP", "FN")
    one = lambda x: F.greatest(x, F.lit(1))
    return outcomes.groupBy(by).agg((inter / (union + 1e-8)).alias("iou"), (inter / one(pred)).alias("precision"), (inter / one(gt)).alias("recall"), (pred / cells).alias("pred_ratio"), (gt / cells).alias("gt_ratio"))


def macro(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def class_accuracy(gt: DataFrame, pred: DataFrame, key: list[str], cls: str, by: str) -> DataFrame:
    """Share of occupied ground truth whose class is met; a missing prediction misses."""
    j = gt.select(*key, F.col(cls).alias("_g")).join(pred.select(*key, F.col(cls).alias("_p")), key, "left")
    return j.groupBy(by).agg(F.avg(F.coalesce(F.col("_p") == F.col("_g"), F.lit(False)).cast("double")).alias("accuracy"))


def threshold_sweep(df: DataFrame, prob: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Micro IoU, precision, recall and predicted share per threshold, in one pass."""
    p, g = F.col(prob), F.col(truth)
    aggs = [F.count("*").alias("n"), F.count_if(g).alias("g")]
    for i, th in enumerate(thresholds):
        aggs += [F.count_if((p > th) & g).alias(f"i{i}"), F.count_if(p > th).alias(f"p{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(th).alias("threshold"), F.col(f"i{i}").alias("i"), F.col(f"p{i}").alias("p")) for i, th in enumerate(thresholds)]))
    r = df.agg(*aggs).select("n", "g", rows.alias("r")).select("n", "g", "r.*")
    one = lambda x: F.greatest(x, F.lit(1))
    return r.select("threshold", (F.col("i") / (F.col("p") + F.col("g") - F.col("i") + 1e-8)).alias("iou"), (F.col("i") / one(F.col("p"))).alias("precision"), (F.col("i") / one(F.col("g"))).alias("recall"), (F.col("p") / F.col("n")).alias("pred_ratio"))


def masked_mse(df: DataFrame, pred: str, gt: str, mask: Column, width: int, by: list[str] | None = None) -> DataFrame:
    err = G.sum_of(G.map_pairs(F.col(pred), F.col(gt), lambda a, b: (a.cast("double") - b) * (a - b)))
    return df.where(mask).groupBy(*(by or [])).agg((F.sum(err) / (F.count("*") * width)).alias("mse"))


def bce_with_logits(x: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Stable binary cross entropy; the positive part is weighted."""
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    return pos_weight * y * soft(-x) + (1 - y) * soft(x)


def overlap_losses(df: DataFrame, prob: Column, gt: Column, alpha: float, beta: float) -> DataFrame:
    """Dice and Tversky losses with 1 added above and below."""
    i, p, g = F.sum(prob * gt), F.sum(prob), F.sum(gt)
    fp, fn = F.sum(prob * (1 - gt)), F.sum((1 - prob) * gt)
    return df.agg((1 - (2 * i + 1) / (p + g + 1)).alias("dice"), (1 - (i + 1) / (i + alpha * fp + beta * fn + 1)).alias("tversky"))


def cross_entropy(logits: Column, target: Column) -> Column:
    """log-sum-exp minus the target's logit (target 0-based)."""
    top = F.array_max(logits)
    return top + F.log(G.sum_of(F.transform(logits, lambda x: F.exp(x - top)))) - F.get(logits, target)


def gaussian_kl(mean: Column, logvar: Column) -> Column:
    return 0.5 * (mean * mean + F.exp(logvar) - 1 - logvar)


def pair_errors(df: DataFrame, a: Column, b: Column, beta: float = 1.0, atol: float = 1e-3, rtol: float = 1e-2, peak: float = 1.0) -> DataFrame:
    """L1, L2, smooth L1, PSNR and shares within tolerance, over value pairs."""
    d = F.abs(a - b)
    smooth = F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    mse = F.avg((a - b) * (a - b))
    return df.agg(F.avg(d).alias("l1"), mse.alias("l2"), F.avg(smooth).alias("smooth_l1"), (20 * F.log10(F.lit(peak) / F.sqrt(mse))).alias("psnr"), F.avg((d <= atol).cast("double")).alias("within_abs"), F.avg((d <= rtol * F.abs(b)).cast("double")).alias("within_rel"))


def mean_normal_angle(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean degrees between unit vectors stored in [0, 1]; pairs without length are left out, -1 if none is left."""
    open_ = lambda v: F.transform(v, lambda x: x.cast("double") * 2 - 1)
    u, v = open_(F.col(a)), open_(F.col(b))
    norms = G.norm(u) * G.norm(v)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), G.dot(u, v) / (norms + 1e-9)))
    return df.agg(F.coalesce(F.avg(F.when(norms > 1e-9, F.degrees(F.acos(cos)))), F.lit(-1.0)).alias("angle"))


def time_bin_mse(df: DataFrame, t: str, value: str, bins: int = 10) -> DataFrame:
    return df.select(G.time_bin(t, bins).alias("bin"), value).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.avg(value).alias("mse"), F.count("*").alias("n"))


def noise_report(df: DataFrame, t: str, mse: str, cosine: str) -> DataFrame:
    """Per t the averages, with the three ranges' means and the two warnings on every row."""
    per = df.groupBy(t).agg(F.avg(mse).alias("mse"), F.avg(cosine).alias("cosine"))
    part = lambda cond: F.avg(F.when(cond, F.col("mse")))
    all_ = per.agg(part(F.col(t) <= 0.3).alias("low"), part((F.col(t) > 0.3) & (F.col(t) <= 0.7)).alias("mid"), part(F.col(t) > 0.7).alias("high"))
    out = per.crossJoin(F.broadcast(all_))  # one row
    return out.withColumn("warn_high", F.coalesce(F.col("high") > 5 * F.col("low"), F.lit(False))).withColumn("warn_low", F.coalesce(F.col("low") > 0.1, F.lit(False)))


def quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """``by`` and ``q``: exact quantiles of each group with linear interpolation, as ``percentile`` gives them.

    Values are placed by one sort over all groups, so no task holds a group. ``by`` has few values.
    """
    from assetlake.operators.manifest import with_global_index

    placed = with_global_index(df.select(by, value).where(F.col(value).isNotNull()), [by, value], "_i")
    ends = placed.groupBy(by).agg(F.min("_i").alias("_from"), F.count("*").alias("_n"))  # a row per group
    wanted = ends.select(F.col(by).alias("_g"), F.posexplode(F.array(*[F.col("_from") + (F.col("_n") - 1) * F.lit(float(s)) for s in shares])).alias("_k", "_p"))
    wanted = wanted.withColumn("_e", F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p")))))
    hit = placed.join(F.broadcast(wanted), F.col("_i") == F.col("_e"))
    weight = F.when(F.floor("_p") == F.ceil("_p"), 1.0).when(F.col("_e") == F.floor("_p"), F.ceil("_p") - F.col("_p")).otherwise(F.col("_p") - F.floor("_p"))
    per = hit.groupBy(by, "_k").agg(F.sum(weight * F.col(value)).alias("_v"))
    return per.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias("q"))


def log_statistics(df: DataFrame, metric: str, value: str) -> DataFrame:
    got = df.groupBy(metric).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, metric, value, [0.25, 0.5, 0.75]).withColumnRenamed(metric, "_g")
    got = got.join(q, got[metric].eqNullSafe(q["_g"]), "left")
    return got.select(metric, "n", "mean", "std", "min", "max", *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])


def last_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group; a task keeps no more than those."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def last_improvement(df: DataFrame, by: list[str], order: str, value: str, mode: str = "max") -> DataFrame:
    """Per group the ``order`` of the last row of ``running_best``: the first that has the best value, or the last if none has a value."""
    key = -F.col(value) if mode == "max" else F.col(value)
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(key.alias("v"), F.col(order).alias("o"))))["o"]
    return df.groupBy(*by).agg(F.coalesce(first, F.max(order)).alias(order))


def log_rollup(df: DataFrame, step: str, path: str, value: str, every: int) -> DataFrame:
    """Mean of each leaf over windows of ``every`` steps; leaves may be missing in some."""
    return df.groupBy(F.floor(F.col(step) / every).alias("window"), path).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def exclude_nan_steps(df: DataFrame, step: str, value: str) -> DataFrame:
    """Without every step of which any value is NaN."""
    bad = df.groupBy(step).agg(F.bool_or(F.isnan(value)).alias("_bad")).where("_bad").select(step)
    return df.join(bad, step, "left_anti")


def moving_average(df: DataFrame, by: list[str], order: list[str], value: Column, width: int, name: str) -> DataFrame:
    """Mean of the last ``width`` values, null before there are so many."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.when(F.row_number().over(w) >= width, F.avg(value).over(w.rowsBetween(1 - width, 0))))


def adaptive_clip(df: DataFrame, by: list[str], order: list[str], value: str, percentile: float, buffer: int, cap: float) -> DataFrame:
    """Threshold for each step: the percentile of the last ``buffer`` finite norms before it, capped; the cap until they are there."""
    ok = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    finite = df.withColumn("_v", ok).where("_v is not null")
    w = Window.partitionBy(*by).orderBy(*order)
    p = F.percentile("_v", F.lit(percentile)).over(w.rowsBetween(1 - buffer, 0))
    now = F.when(F.row_number().over(w) >= buffer, F.least(p, F.lit(cap))).otherwise(F.lit(cap))
    return finite.withColumn("_t", now).withColumn("threshold", F.coalesce(F.lag("_t").over(w), F.lit(cap))).drop("_v", "_t")


def running_best(df: DataFrame, by: list[str], order: list[str], value: str, mode: str = "max") -> DataFrame:
    """Rows that strictly improve on all before them in their group."""
    f, better = (F.max, lambda a, b: a > b) if mode == "max" else (F.min, lambda a, b: a < b)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", f(value).over(w)).where(F.col("_best").isNull() | better(F.col(value), F.col("_best"))).drop("_best")


def fit_line(df: DataFrame, y: Column, x: Column, last: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Least squares over all rows, or the ``last`` ones by ``order``; each task keeps no more than those."""
    if last is not None:
        df = df.orderBy(*[c.desc() for c in order]).limit(last)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def allowed_ratio(fit: DataFrame, sizes: DataFrame, size: str, memory: float, most: float = 1.0) -> DataFrame:
    """Ratio at which the line predicts ``memory`` for each input size, kept in [0, most]."""
    j = sizes.crossJoin(F.broadcast(fit.select("slope", "intercept")))  # one row
    r = (F.lit(memory) - F.col("intercept")) / (F.col("slope") * F.col(size))
    return j.withColumn("ratio", F.least(F.lit(most), F.greatest(F.lit(0.0), r))).drop("slope", "intercept")


def pick_cases(df: DataFrame, order: list[Column], best: int, middle: int, worst: int) -> DataFrame:
    """Best, middle and worst rows of a ranking; worst first among the worst, none for 0."""
    from assetlake.operators.manifest import with_global_index

    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    ranked = with_global_index(keyed, [f"_o{i}" for i in range(len(order))], "position").drop(*[f"_o{i}" for i in range(len(order))])
    n = F.broadcast(df.agg(F.count("*").alias("n")))
    j = ranked.crossJoin(n)
    start = F.greatest(F.lit(0), F.floor((F.col("n") - middle) / 2))
    pos = F.col("position")
    groups = [("best", pos < best, pos), ("middle", (pos >= start) & (pos < start + middle), pos - start), ("worst", pos >= F.col("n") - worst, F.col("n") - 1 - pos)]
    rows = F.explode(F.filter(F.array(*[F.when(c, F.struct(F.lit(g).alias("kind"), p.cast("long").alias("place"))) for g, c, p in groups]), lambda x: x.isNotNull()))
    return j.withColumn("_g", rows).select(*df.columns, "_g.kind", "_g.place")


def standardize(vector: Column, mean: list[float], std: list[float], per: int) -> Column:
    """(x - mean) / std with the channel's values; ``per`` positions a channel."""
    m, s = (F.array(*[F.lit(float(v)) for v in x]) for x in (mean, std))
    ch = lambda i: F.floor(i / per).cast("int")
    return F.transform(vector, lambda x, i: (x.cast("double") - F.get(m, ch(i))) / F.get(s, ch(i)))


def unstandardize(vector: Column, mean: list[float], std: list[float], per: int) -> Column:
    m, s = (F.array(*[F.lit(float(v)) for v in x]) for x in (mean, std))
    ch = lambda i: F.floor(i / per).cast("int")
    return F.transform(vector, lambda x, i: x * F.get(s, ch(i)) + F.get(m, ch(i)))


def diffuse(x0: Column, eps: Column, t: Column, sigma: float) -> Column:
    return F.zip_with(x0, eps, lambda a, e: (1 - t) * a.cast("double") + (sigma + (1 - sigma) * t) * e)


def velocity(x0: Column, eps: Column, sigma: float) -> Column:
    return F.zip_with(x0, eps, lambda a, e: (1 - sigma) * e.cast("double") - a)


def recover_x0(xt: Column, v: Column, t: Column, sigma: float) -> Column:
    return F.zip_with(xt, v, lambda x, u: (1 - sigma) * x - (sigma + (1 - sigma) * t) * u)


def recover_eps(xt: Column, v: Column, t: Column) -> Column:
    return F.zip_with(xt, v, lambda x, u: (1 - t) * u + x)


def _seeded_share(seed: str, key: str) -> Column:
    """A number in (0, 1) that looks random, the same for a key on each run and in every engine that has md5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def drop_condition(df: DataFrame, key: str, cond: str, negative: Column, p: float, seed: int) -> DataFrame:
    """The condition is replaced with probability p, the same rows on each run."""
    return df.withColumn(cond, F.when(_seeded_share(str(seed), key) < p, negative).otherwise(F.col(cond)))


def sample_t(df: DataFrame, key: str, kind: str, seed: int, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Times in (0, 1): uniform, logit-normal, or 80 % logit-normal with 20 % uniform; the same for a key on each run."""
    u = [_seeded_share(f"{seed}-{i}", key) for i in range(4)]
    normal = G.sigmoid(F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1]) * std + mean)
    t = {"uniform": u[2], "logit_normal": normal, "mixture": F.when(u[3] < 0.8, normal).otherwise(u[2])}[kind]
    return df.withColumn("t", t)


def mid_slice(rows: DataFrame, asset: str, shape: tuple[int, int, int], shown: int = 3) -> DataFrame:
    """The middle plane of the first channels, scaled to [0, 1] over the plane."""
    _, w, d = shape
    plane = rows.where((F.col("position") % d == d // 2) & (F.col("channel") < shown))
    win = Window.partitionBy(asset)
    v = (F.col("value") - F.min("value").over(win)) / (F.max("value").over(win) - F.min("value").over(win) + 1e-8)
    p = F.floor(F.col("position") / d)
    return plane.select(asset, "channel", F.floor(p / w).cast("int").alias("row"), (p % w).cast("int").alias("col"), v.alias("v"))


def splat_stats(df: DataFrame, by: str) -> DataFrame:
    """Over splats with offset, scale (array of 3) and opacity: means, ranges, volume, squared distance of opacity from 1."""
    s = F.col("scale")
    volume = s[0] * s[1] * s[2]
    one = lambda x, n: [F.avg(x).alias(f"{n}_mean"), F.max(x).alias(f"{n}_max"), F.min(x).alias(f"{n}_min")]
    return df.groupBy(by).agg(*one("offset", "offset"), *one(F.array_max("scale"), "scale"), *one("opacity", "opacity"), F.avg(volume).alias("volume_mean"), F.avg((F.col("opacity") - 1) * (F.col("opacity") - 1)).alias("opacity_loss"))


def flatten_json(df: DataFrame, key: str, text: str, sep: str = "/") -> DataFrame:
    """(key, path, value) of the leaves of a JSON object at any depth, names joined by ``sep``.

    Scalars are text, JSON null is null, lists are leaves and stay JSON. Each round opens
    the objects of one level, until none is left; empty objects, text that is no JSON or
    names a key twice, and anything but an object at the top have no leaves.
    """
    spark = df.sparkSession
    is_object = F.expr("schema_of_variant(v) like 'OBJECT%'")
    level = df.select(key, F.lit("").alias("path"), F.expr(f"try_parse_json(`{text}`)").alias("v")).where(is_object)
    done: list[DataFrame] = []
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_k"), F.col("value").alias("_v")))
        path = F.when(F.col("path") == "", F.col("_k")).otherwise(F.concat_ws(sep, "path", "_k"))
        opened = cut(opened.select(key, path.alias("path"), F.col("_v").alias("v")))
        done.append(opened.where(~is_object).select(key, "path", F.col("v").cast("string").alias("value")))
        level = opened.where(is_object)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)


def merge_leaves(left: DataFrame, right: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """Leaves (key, path, value) of both sides' objects together; a path that both have, or one below another's leaf, at whatever level, is an error at run time."""
    both = left.unionByName(right)
    parts = F.split("path", rf"\Q{sep}\E")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    inner = both.where(F.size(parts) > 1).select(key, F.explode(above).alias("path")).distinct().withColumn("_inner", F.lit(1))
    n = both.groupBy(key, "path").agg(F.count("*").alias("_n"), F.first("value").alias("value")).join(inner, [key, "path"], "left")
    once = F.assert_true((F.col("_n") == 1) & F.col("_inner").isNull(), F.concat(F.lit("duplicate leaf "), F.col("path"))).isNull()
    return n.where(once).select(key, "path", "value")


def parse_captions(text: Column, plain: Column) -> tuple[Column, Column]:
    """(first caption of a JSON list of strings, or the plain one; whether the list is valid)."""
    return F.coalesce(F.get(F.from_json(text, "array<string>"), F.lit(0)), plain), F.json_array_length(text).isNotNull()


def minmax_scale(x: Column, by: list[str] | None = None, bounds: tuple[float, float] | None = None) -> Column:
    """(x - min) / (max - min + 1e-8) within ``by``; with ``bounds`` those are used and the result is clipped to [0, 1]."""
    if bounds:
        lo, hi = bounds
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    w = Window.partitionBy(*(by or []))
    return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + 1e-8)
