"""Operators 11 to 13: brute force, properties, edge cases and layouts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from assetlake.llm import packing, prefix_trie, spelling, tiered_packing
from assetlake.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA

CLASH = ", length long, ids binary, g long, step_group string, word string, n long, form string, part long, task string, id long, run string, h long, idx string, depth long, size long, a string, b long, pa int, _cell long, weight string"
EXTRA = (1, b"x", 2, "s", "w", 3, "f", 4, "t", 5, "r", 6, "i", 7, 8, "a", 9, 1, 2, "w")
DOCS = "doc_id long, text string, lang string, source string, n_chars long" + CLASH
TURNS = "conv_id long, turn long, role string, text string" + CLASH


def docs_of(spark, some, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 1, *EXTRA) for i, t in some], DOCS).repartition(parts)


def turns_of(spark, some, parts=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in some], TURNS).repartition(parts)


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_prefix_trie"])
def test_sql(spark, duck, name):
    want, got = duck_rows(duck, ORACLES[name]), spark_rows(QUERIES[name](spark, DATA))
    assert got[0] == want[0] and got[1] == want[1] and got[1]


# --- 11 -----------------------------------------------------------------------------------


def test_tiers_are_full():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, rng.choice([5, 300, 700, 4096])) for _ in range(rng.randrange(60))]
        segments, windows = tiered_packing.pack_tiers(sizes)
        cover, places = defaultdict(list), defaultdict(list)
        for i, start, n, w, offset in segments:
            cover[i].append((start, n))
            places[w].append((offset, n))
        for parts, total in [*((sorted(cover[i]), s) for i, s in enumerate(sizes)), *((sorted(places[w]), s) for w, s in enumerate(windows))]:
            assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) == total
        assert sum(w not in tiered_packing.TIERS for w in windows) <= 9 and all(w & (w - 1) == 0 for w in windows)


def test_gaps_take_whole_pieces_of_shorter_tiers_before_any_cut():
    segments, windows = tiered_packing.pack_tiers([3000, 1000, 96, 600, 424])
    assert windows == [4096, 1024]
    assert sorted(segments) == [(0, 0, 3000, 0, 0), (1, 0, 1000, 0, 3000), (2, 0, 96, 0, 4000), (3, 0, 600, 1, 0), (4, 0, 424, 1, 600)]
    segments, windows = tiered_packing.pack_tiers([3000, 3000, 1500])
    assert windows[:2] == [4096, 2048] or windows[0] == 4096
    assert (2, 0, 1096) in [s[:3] for s in segments]  # the gap cuts the longest shorter piece


def test_step_groups_balance():
    rng = random.Random(2)
    windows = [4096] * 333 + [512] * 1000
    costs = [rng.randrange(1 << 20, 1 << 24) for _ in windows]
    steps = tiered_packing.step_groups(windows, costs, 1 << 16)
    for size, per in ((4096, 16), (512, 128)):
        of = defaultdict(list)
        for w, c, s in zip(windows, costs, steps, strict=True):
            if w == size:
                of[s].append(c)
        assert max(map(len, of.values())) <= per and max(map(len, of.values())) - min(map(len, of.values())) <= 1
        means = [sum(v) / len(v) for v in of.values()]
        assert max(means) < 1.1 * min(means)
    assert len({(w, s) for w, s in zip(windows, steps, strict=True)}) == len(set(steps))


@pytest.mark.parametrize("parts", [1, 4])
def test_hierarchy_returns_every_id_once(spark, parts):
    rng = random.Random(5)
    some = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 400, 2500])))) for i in range(60)]
    some += [(60, None), (61, ""), (None, "no id"), (None, "no id"), (3, "again"), (62, "word " * 30_000)]
    rows = tiered_packing.pack_hierarchy(docs_of(spark, some, parts), tokenizer_path(), with_ids=True, sequences=8).collect()
    encode = packing.word_ids(tokenizer_path()).tokenizer
    want = Counter((i, tuple(encode.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in some)
    by = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        by[r.doc_id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
    for (doc, total), pieces in by.items():
        times = sum(n for (i, ids), n in want.items() if i == doc and len(ids) == total)
        assert sum(len(ids) for _, ids in pieces) == total * times
        if times == 1:
            whole = tuple(x for _, ids in sorted(pieces) for x in ids)
            assert want[doc, whole] == 1
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id, r.context].append((r.offset, r.length))
    assert len(seqs) == len({s for s, _ in seqs})
    for (_, context), parts_ in seqs.items():
        parts_.sort()
        assert parts_[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts_, parts_[1:]))  # noqa: B905
        assert sum(n for _, n in parts_) == context <= 4096 and context & (context - 1) == 0
    steps = defaultdict(set)
    for r in rows:
        steps[r.step_group].add((r.sequence_id, r.context))
    assert all(len({c for _, c in v}) == 1 and sum(c for _, c in v) <= tiered_packing.STEP_TOKENS for v in steps.values())


def test_tiers_must_be_powers_of_two(spark):
    with pytest.raises(ValueError):
        tiered_packing.pack_hierarchy(docs_of(spark, [(1, "a")]), tokenizer_path(), tiers=(4096, 1000))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers_own(spark, name):
    encode, rng = packing.WordIds(tokenizer_path(name)), random.Random(7)
    assert (encode.plain, encode.whole) == ((True, False) if name.startswith("word") else (False, True))
    texts = ["".join(rng.choice("abcdeEéß 12  .,'\n\t|<ſ中") for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["hello", "World", "it's", "", "  x", "\n", "12,000"]) for _ in range(30)) for _ in range(200)]
    assert all(encode(t.encode()).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
    docs = docs_of(spark, list(enumerate(texts[-20:])), 2)
    packed = packing.packed_matrix(docs, tokenizer_path(name)).first()
    got = np.frombuffer(packed.ids, packing.id_type(tokenizer_path(name)))
    for k, doc in enumerate(packed.doc_ids):
        ids = got[packed.cu_seqlens[k] : packed.cu_seqlens[k + 1]].tolist()
        assert ids == encode.tokenizer.encode(texts[-20:][doc], add_special_tokens=False).ids + [packing.END_ID]


def test_wide_vocabularies_keep_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {f"t{i}": i for i in range(70_000)}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, unk_token="t0"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "wide.json")
    tokenizer.save(path)
    assert packing.id_type(path) == np.dtype("<u4")
    docs = docs_of(spark, [(1, "t69999 t65536 t5"), (2, "t66000")], 1)
    row = packing.packed_matrix(docs, path, length=16).first()
    assert np.frombuffer(row.ids, "<u4").tolist()[: row.n_tokens] in ([69999, 65536, 5, 1, 66000, 1], [66000, 1, 69999, 65536, 5, 1])
    rows = tiered_packing.pack_hierarchy(docs, path, tiers=(4, 2), with_ids=True).collect()
    assert sorted(x for r in rows for x in np.frombuffer(r.ids, "<u4").tolist()) == sorted([69999, 65536, 5, 2, 66000, 2])


# --- 12 -----------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_acceptor_is_minimal_and_composes():
    rng = random.Random(3)
    for _ in range(60):
        short = sorted({"".join(rng.choice("abc") for _ in range(4)) for _ in range(rng.randrange(1, 40))})
        long = sorted({"".join(rng.choice("abc") for _ in range(5)) for _ in range(rng.randrange(0, 40))})
        acceptor = spelling.Acceptor()
        replaced, longer = spelling.near_pairs(acceptor, short, long)
        assert sorted(replaced) == sorted((i, j) for i, x in enumerate(short) for j, y in enumerate(short) if i < j and one_edit(x, y))
        assert sorted(longer) == sorted((i, j) for i, x in enumerate(long) for j, y in enumerate(short) if one_edit(x, y))
        futures = set()

        def future(q, known):
            arcs = tuple((c, future(t, known)) for c, t, _ in known.arcs[q])
            return known.count[q] - sum(known.count[t] for _, t, _ in known.arcs[q]), arcs

        for q in range(len(acceptor.arcs)):
            assert (f := future(q, acceptor)) not in futures
            futures.add(f)


@pytest.mark.parametrize("most", [2048, 2])
def test_neighbours_lose_no_pair(spark, most):
    rng = random.Random(8)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(700)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaaab"}
    counts = {w: rng.randrange(5, 60) for w in words}
    got = {r.word: r for r in spelling.neighbours(spark.createDataFrame(list(counts.items()), "word string, n long"), 6, most, 200).collect()}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if not near:
            assert w not in got
            continue
        form = min(near, key=lambda x: (-counts[x], x))
        assert (got[w].n_near, got[w].form, got[w].form_n) == (len(near), form, counts[form])


def brute_variants(some):
    counts = Counter()
    for i, t in some:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        form = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = [form if form and counts[form] >= 5 * n else None, n, len(near)]
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_variants_on_edge_texts(spark, parts):
    chain = ("colour " * 900 + "color " * 10 + "colours " * 160 + "colourss " * 30 + "colourssy " * 6 + "ÄPFELCHEN äpfelchen Äpfelchen " * 7).strip()
    some = [(1, chain), (2, None), (None, "missing words " * 5), (2, "repeated rows"), (2, "repeated rows"), (3, ""), (4, "a1b2 ×÷××÷÷×"), (5, "x" * 40_000), (6, ("pattern patern " * 40_000))]
    some += [(100 + i, "patttern pattern letters lettres étranger étrangers") for i in range(300)]
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(docs_of(spark, some, parts)).collect()}
    assert got == brute_variants(some)
    assert {r[2] for r in got if r[0] == "colourssy"} == {"colour"}


# --- 13 -----------------------------------------------------------------------------------


def brute_trie(some, fork=5, share=9):
    def key(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest())

    turns = defaultdict(list)
    for r in sorted((r for r in some if r[0] is not None), key=key):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    nodes = defaultdict(list)
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % share
        base = c - int(np.fmod(c, fork))
        whole[c] = tuple(turns[base][:h] if base in turns else []) + tuple(turns[c][h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    saved, leaves = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    return {
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == k))).encode()).hexdigest())
        for k, m in nodes.items()
    }


def trie_rows(df):
    return [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()]


@pytest.mark.parametrize(("parts", "block"), [(1, 1 << 16), (4, 1 << 16), (3, 4)])
def test_trie_equals_brute_force(spark, parts, block):
    rng = random.Random(11)
    some = []
    for c in [*range(60), -7, -3, 2**62 + 3]:
        for t in range(rng.choice([1, 2, 5, 12, 30])):
            some.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["same", "same", "öther", f"t{c}", ""])))
    some += [(200, None, None, None), (200, None, "user", None), (200, 3, None, "x" * 50_000), (200, 3, None, "x"), (200, 3, None, "x"), (None, 1, "user", "lost"), (203, 0, "user", "short")]
    some += [(c, t, "user", "copy") for c in range(300, 400) for t in range(12)]
    got = trie_rows(prefix_trie.prefix_trie(turns_of(spark, some, parts), block=block))
    assert len(got) == len(set(got)) and set(got) == brute_trie(some)


def test_end_lists_go_on_over_batches(spark):
    from pyspark.sql import functions as F

    ends = spark.range(25_000).select((F.col("id") % 2).alias("depth"), F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), F.col("id").alias("conv_id"))
    got = {r.depth: r.ends_sha256 for r in prefix_trie.end_lists(ends).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, range(d, 25_000, 2))).encode()).hexdigest() for d in (0, 1)}


# --- all ----------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs, turns = spark.createDataFrame([], DOCS), spark.createDataFrame([], TURNS)
    for df, columns in (
        (tiered_packing.pack_hierarchy(docs, tokenizer_path()), "doc_id start length ids_crc32 doc_tokens sequence_id offset context step_group"),
        (spelling.spelling_variants(docs), "word form root n n_near form_n"),
        (prefix_trie.prefix_trie(turns), "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"),
    ):
        assert df.columns == columns.split() and df.count() == 0
