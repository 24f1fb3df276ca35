"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assetlake.llm import exact_dedup, language_id, minhash_dedup, mixing, packing, prefix_trie, quality, sharding, spelling, substring_dedup, tiered_packing, toxicity
from assetlake.llm.common import map_rows
from assetlake.session import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sequence: members, cumulative lengths, digests of ids and positions."""
    packed, kind = packing.packed_matrix(table(spark, sf_dir, "documents"), tokenizer_path()), packing.id_type(tokenizer_path())

    def make():
        def step(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("ids_crc32", "n_segments", "n_resets")}
            for n, cu, ids, pos in zip(*(b.column(c).to_pylist() for c in ("n_tokens", "cu_seqlens", "ids", "position_ids")), strict=True):
                out["ids_crc32"].append(zlib.crc32(np.frombuffer(ids, kind)[:n].astype("<u4").tobytes()))
                out["n_segments"].append(len(cu) - 1)
                out["n_resets"].append(int((np.frombuffer(pos, "<u2")[:n] == 0).sum()))
            return out | {c: b.column(c) for c in ("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens")}

        return step

    return map_rows(packed, make, "sequence_id long, n_tokens int, n_segments int, n_resets int, ids_crc32 long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>")


def op4_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), method="sum_of_squares")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_packing.pack_hierarchy(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_minmax_dedup, op3_packed_matrix, op4_sum_of_squares, op5_substring_dedup, op6_histogram_sort, op7_language, op8_toxicity, op9_mix, op10_exact_dedup, op11_tiered_packing, op12_spelling_variants, op13_prefix_trie)}

# crc32 in SQL: the table of a byte's remainders, and the fold over a list of bytes
_CRC_TABLE = """tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i))"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_minmax_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 85 * (na.n + nb.n - p.i)),
reach AS (SELECT a AS node, a AS other FROM (SELECT DISTINCT a FROM links) UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.i) AS t FROM words k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op9_mix": f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR) || '|{mixing.SEED}') AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
r AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS rate
  FROM s WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((max(CASE WHEN rate * weight <= cap THEN rate END) OVER ()) * weight, cap::DOUBLE)) AS target FROM r),
p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM e""",
    "op10_exact_dedup": """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, text_sha256, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size
  FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents) WINDOW g AS (PARTITION BY text_sha256))""",
    "op12_spelling_variants": f"""
WITH RECURSIVE
{_CRC_TABLE},
r AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2),
b AS (
  SELECT run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS bytes FROM r),
h AS (SELECT run, k, {_CRC.format("bytes")} AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
e AS (SELECT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT x.word, y.word AS other, y.n FROM e x JOIN e y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.a || e.z
  UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.a || e.z),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM p GROUP BY 1),
g AS (SELECT v.word, CASE WHEN f.most >= 5 * v.n THEN f.other END AS form, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.most >= 5 * v.n THEN f.most END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
s AS (SELECT word, word AS here, 0 AS d FROM g UNION ALL SELECT s.word, g.form, d + 1 FROM s JOIN g ON g.word = s.here WHERE g.form IS NOT NULL)
SELECT g.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM g JOIN (SELECT word, arg_max(here, d) AS root FROM s GROUP BY 1) USING (word)""",
    "op13_prefix_trie": f"""
WITH RECURSIVE
{_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text)) AS i, role, text FROM t),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS turns FROM o GROUP BY 1),
c AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base,
    {_CRC.format("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)")} % 9 AS h
  FROM l, tab),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN l b ON b.conv_id = c.base),
p AS (SELECT conv_id, d AS depth, turns[1:d] AS k, turns[1:d - 1] AS up, len(turns) = d AS ends, coalesce(octet_length(encode(turns[d].text)), 0) AS bytes FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
ch AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.depth = n.depth AND ch.k = n.k),
s AS (
  SELECT u.depth, u.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM f JOIN (SELECT depth, k FROM f) u ON u.depth <= f.depth AND f.k[1:u.depth] = u.k GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.depth = f.depth AND s.k = f.k LEFT JOIN n q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.k = f.up""",
}
