"""Asset manifests: eligibility, stage flags, record merges, checks and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.session import cut

#: What must be there before a stage, and the flag that says it is done.
STAGES: dict[str, tuple[tuple[str, ...], str]] = {
    "download": ((), "downloaded"),
    "render": (("downloaded",), "rendered"),
    "voxelize": (("rendered",), "voxelized"),
    "feature": (("voxelized", "rendered"), "feature"),
    "latent": (("feature",), "latent"),
    "ss_latent": (("voxelized",), "ss_latent"),
    "cond": (("downloaded",), "cond_rendered"),
}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_instances(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the allow-list; no other filter applies to them."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def filter_min_score(df: DataFrame, score: str, least: float) -> DataFrame:
    """Null scores fail."""
    return df.where(F.col(score) >= least)


def filter_max_voxels(df: DataFrame, count: str = "num_voxels", most: int = 32768) -> DataFrame:
    return df.where(F.col(count) <= most)


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def pending(df: DataFrame, stage: str) -> DataFrame:
    """Eligible and not done; a null flag counts as not done."""
    needs, done = STAGES[stage]
    return df.where(all_of([flag(c) for c in needs]) & ~flag(done))


def funnel(df: DataFrame, steps: list[tuple[str, Column]], by: str) -> DataFrame:
    """(by, step, name, rows left): all steps counted in one pass, ``Total`` first."""
    passed, aggs = F.lit(True), [F.count("*").alias("c0")]
    for i, (_, cond) in enumerate(steps, 1):
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"c{i}"))
    names = ["Total", *(n for n, _ in steps)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"c{i}").alias("left")) for i, n in enumerate(names)]))
    return df.groupBy(by).agg(*aggs).select(by, rows.alias("s")).select(by, "s.step", "s.name", "s.left")


def needs(field: str, selected: str) -> bool:
    """Whether a comma-separated choice of fields, or ``all``, asks for a field."""
    chosen = {x.strip() for x in selected.split(",")}
    return "all" in chosen or field in chosen


def filter_reasons(df: DataFrame, reasons: list[str], reason: str = "reason") -> DataFrame:
    """Rejected rows with one of the reasons; it is an error at run time if there is none."""
    kept = df.where(F.col(reason).isin(reasons))
    n = F.broadcast(kept.agg(F.count("*").alias("_n")))
    some = F.assert_true(F.col("_n") > 0, F.lit(f"no row with reason {', '.join(sorted(reasons))}")).isNull()
    return n.where(some).crossJoin(kept).drop("_n")


def limit_samples(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in manifest order, with their index; 0 takes all."""
    indexed = with_global_index(df, order)
    return indexed.where(F.col("idx") < n) if n else indexed


def with_default_flags(df: DataFrame, flags: list[str], counts: tuple[str, ...] = ("num_voxels",)) -> DataFrame:
    """Missing or null flags are false, counts 0."""
    have = set(df.columns)
    new = {c: flag(c) if c in have else F.lit(False) for c in flags}
    new |= {c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0) for c in counts}
    return df.withColumns(new)


def with_global_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """0-based position in the whole order: one range shuffle, then offsets per partition."""
    tagged = cut(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = tagged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def shard_range(df: DataFrame, order: list[str], rank: int, world: int) -> DataFrame:
    """Rows [n*rank//world, n*(rank+1)//world) of the order, with their index."""
    indexed = with_global_index(df, order)
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    keep = (F.col("idx") >= F.expr(f"_n * {rank} div {world}")) & (F.col("idx") < F.expr(f"_n * {rank + 1} div {world}"))
    return indexed.crossJoin(n).where(keep).drop("_n")


def shard_stride(df: DataFrame, order: list[str], rank: int, world: int) -> DataFrame:
    return with_global_index(df, order).where(F.pmod(F.col("idx"), F.lit(world)) == rank)


def attach_records(manifest: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return manifest.join(records, key, "left")


def latest_record(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last by ``order`` (shard file name, then row), by a partial aggregate."""
    cols = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def merge_records(manifest: DataFrame, records: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Update-merge: non-null values of the last record replace those of rows that exist.

    Keys and columns that the manifest doesn't have are ignored.
    """
    new = latest_record(records, key, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = manifest.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*manifest.columns)


def mark_success(manifest: DataFrame, results: DataFrame, key: str, name: str) -> DataFrame:
    """The flag becomes true for keys in ``results``; a missing column starts as false."""
    done = results.select(key).distinct().withColumn("_done", F.lit(True))
    old = flag(name) if name in manifest.columns else F.lit(False)
    return manifest.join(done, key, "left").withColumn(name, F.coalesce("_done", old)).drop("_done")


def unscored(manifest: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return manifest.join(old.select(key), key, "left_anti")


def restrict_to_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return rows.join(manifest.select(key), key, "left_semi")


def verify_downloads(files: DataFrame, manifest: DataFrame, identifier: str, computed: str, expected: str) -> DataFrame:
    """Status per manifest row: ok, mismatch or missing."""
    status = F.when(F.col(computed).isNull(), "missing").when(F.col(computed) == F.col(expected), "ok").otherwise("mismatch")
    return manifest.join(files, identifier, "left").withColumn("status", status)


def join_required(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Inner join that fails at run time if a key has no partner."""
    got = left.join(right.select(key, value), key, "left")
    ok = F.assert_true(F.col(value).isNotNull(), F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string")))
    return got.where(ok.isNull())


def flag_from_artifacts(manifest: DataFrame, listing: DataFrame, key: str, name: str, needs: list[str]) -> DataFrame:
    """``flag or (prerequisites and an artefact exists)``."""
    seen = listing.select(key).distinct().withColumn("_seen", F.lit(True))
    now = flag(name) | (all_of([flag(c) for c in needs]) & F.coalesce("_seen", F.lit(False)))
    return manifest.join(seen, key, "left").withColumn(name, now).drop("_seen")


def manifest_statistics(df: DataFrame, nonnull: list[str], flags: list[str]) -> DataFrame:
    """(metric, n) in one aggregation."""
    aggs = [F.count("*").alias("total"), *[F.count(c).alias(f"has_{c}") for c in nonnull], *[F.count_if(flag(c)).alias(c) for c in flags]]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in wide.columns)
    return wide.selectExpr(f"stack({len(wide.columns)}, {pairs}) as (metric, n)")


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).withColumn("unique", F.col("rows") == F.col("keys"))


def report(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Ordered pass / fail table from aggregate conditions."""
    wide = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"k{i}") for i, (_, c) in enumerate(checks)])
    pairs = ", ".join(f"{i}, '{n}', k{i}" for i, (n, _) in enumerate(checks))
    return wide.selectExpr(f"stack({len(checks)}, {pairs}) as (position, check_name, passed)")


def split_by_rank(df: DataFrame, rank: str, target: int, val: int, policy: str = "val_first") -> DataFrame:
    """Split of successful rows by rank; rows beyond the target get null."""
    if val >= target:
        raise ValueError("val must be smaller than target")
    r = F.col(rank)
    if policy == "val_first":
        split = F.when(r < val, "val").when(r < target, "train")
    else:
        split = F.when(r < target - val, "train").when(r < target, "val")
    return df.withColumn("split", split)


def order_by_split(df: DataFrame, split: str, rank: str, first: tuple[str, ...] = ("val", "train")) -> DataFrame:
    """Rows in the order of their splits, others last, then by rank, with their ``position``."""
    place = F.lit(len(first))
    for i, name in reversed(list(enumerate(first))):
        place = F.when(F.col(split) == name, i).otherwise(place)
    return with_global_index(df.withColumn("_split", place), ["_split", rank], "position").drop("_split")


def select_first(df: DataFrame, order: list[str], target: int, reserve: int) -> DataFrame:
    """The first target + reserve rows with their 0-based rank; too few rows is an error at run time."""
    n = target + reserve
    have = F.broadcast(df.agg(F.count("*").alias("_have")))
    first = with_global_index(df, order, "rank").where(F.col("rank") < n).crossJoin(have)
    return first.where(F.assert_true(F.col("_have") >= n, F.lit("too few candidates")).isNull()).drop("_have")


def concat_roots(frames: dict[str, DataFrame], name: str = "root") -> DataFrame:
    """All rows with a source tag; columns that one side lacks are null there."""
    tagged = [df.withColumn(name, F.lit(k)) for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_unpruned(final: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return final.join(removed.select(key), key, "left_anti")


def pick_one(df: DataFrame, group: str, item: str, seed: int) -> DataFrame:
    """One item of each group, the same on each run with one seed."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(item).cast("string")).cast("binary"))
    return df.groupBy(group).agg(F.min_by(item, F.struct(order, F.col(item))).alias(item))


def intersect_members(members: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Archive members that are manifest ids, each once."""
    return members.select(key).intersect(manifest.select(key))
