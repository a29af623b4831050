"""Hard negatives, spelling variants and decontamination, each against a brute-force version."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import op11_hard_negatives, op12_spelling, op13_decontaminate

SHARED = " ".join(f"w{i}" for i in range(14))
TEXTS = [
    None, "", " .,", "one", "x " + SHARED + " y", SHARED.upper().replace(" ", " - "), "w0 w1 w2", SHARED + " " + SHARED, " ".join(SHARED.split()[:9]), " ".join(SHARED.split()[3:13]),
    "short item here", "Short, ITEM; here short item here", "café naïve 你好 \U0001f642 café", "cafÉ naïve", "a" * 5000 + " " + "a" * 5000, "long " * 4000, "\x85 w0\x00w1",
    *["copy of a text " + SHARED] * 5,
]
ITEMS = [(1, SHARED), (2, "short item here"), (3, None), (4, ""), (10, "w3 w4"), (10, "café naïve"), (None, "copy of"), (5, "a" * 5000), (6, "not there"), (7, "你好"), (8, "long " * 30), (9, SHARED)]


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word_list(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc_id, text in docs:
        w = word_list(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])] - {None}
        out.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(map(str, found)))))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 1, "x"), (None, TEXTS[5], 1, "x"), (4, "another text short item here", 1, "x")]
    rows += [(r.doc_id + 1000, r.text, 1, "x") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return spark.createDataFrame(rows, "doc_id long, text string, key1 int, word string").repartition(3).persist()


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return spark.createDataFrame(ITEMS + [(r.item_id + 100, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], "item_id long, text string").persist()


@pytest.mark.parametrize("block_bytes,shard_words", [(1 << 25, op13_decontaminate.SHARD_WORDS), (1 << 25, 37), (20_000, 1000)])
def test_contamination_equals_brute_force(docs, items, block_bytes, shard_words):
    found = op13_decontaminate.contamination(docs, items, 10, block_bytes, shard_words).collect()
    got = collections.Counter((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.first, s.last)), tuple(r["items"])) for r in found)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == brute_contamination(pairs, [(r.item_id, r.text) for r in items.collect()])
    assert any(n for (_, _, hit, _), n in got.items() if hit)


def test_decontaminated_texts(docs, items):
    clean = op13_decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    pairs = {(r.doc_id, r.text) for r in docs.collect()}
    texts = {r.doc_id: r.text for r in clean.where("doc_id is not null and doc_id <> 4").collect()}
    assert texts[0] is None and texts[4 + 1] == "" and texts[11] == "" and texts[6] == "w0 w1 w2" and texts[12] == " \U0001f642 café"
    hits = {r.doc_id: r for r in op13_decontaminate.contamination(docs, items).collect()}
    for doc_id, text in pairs:
        if doc_id in texts and text:
            kept, at = "", 0
            for s in hits[doc_id].spans:
                assert len(word_list(text[s.start : s.end])) == s.last - s.first
                kept, at = kept + text[at : s.start], s.end
            assert texts[doc_id] == kept + text[at:]


def test_contamination_of_nothing(docs, items):
    found = op13_decontaminate.contamination(docs, items.where("false"))
    assert found.count() == docs.count() and found.where("size(spans) > 0 or size(items) > 0").count() == 0
    assert op13_decontaminate.contamination(docs.where("false"), items).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(2, 5), max_size=60), st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=4), max_size=8))
def test_index_finds_every_occurrence(text, phrases):
    index = op13_decontaminate.FmIndex(np.array(text, np.int32), 6)
    padded = np.array([[-1] * (4 - len(p)) + p for p in phrases], np.int32).reshape(-1, 4)
    for p, low, high in zip(phrases, *index.ranges(padded), strict=True):
        assert sorted(index.locate(np.arange(low, high)).tolist()) == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]


def test_a_very_long_text(spark):
    text = "".join(f"n{i} " for i in range(1_500_000)) + SHARED + " end"
    docs = spark.createDataFrame([(1, text), (2, SHARED)], "doc_id long, text string")
    found = {r.doc_id: r for r in op13_decontaminate.contamination(docs, spark.createDataFrame([(1, SHARED), (2, "n1048560 n1048561 n1048562 n1048563 n1048564 n1048565 n1048566 n1048567 n1048568 n1048569 n1048570 n1048571 n1048572 n1048573 n1048574 n1048575 n1048576 n1048577 n1048578")], "item_id long, text string")).collect()}
    assert found[1].n_words == 1_500_015 and [(s.first, s.last) for s in found[1].spans] == [(1048560, 1048579), (1_500_000, 1_500_014)]
    assert found[1]["items"] == ["1", "2"] and text[found[1].spans[1].start : found[1].spans[1].end] == SHARED


def brute_words(pairs):
    n = collections.Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edits(w, letters):
    for i in range(len(w) + 1):
        for x in letters:
            yield w[:i] + x + w[i:]
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            for x in letters:
                yield w[:i] + x + w[i + 1 :]


def brute_variants(n):
    letters = sorted({c for w in n for c in w})
    near = {w: {v for v in edits(w, letters) if v in n and v != w} for w in n}
    form = {w: (lambda b: b if n[b] >= 10 * n[w] else None)(min(vs, key=lambda v: (-n[v], v))) if vs else None for w, vs in near.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], form[w], form[w] and n[form[w]], len(near[w]), root))
    return out


@pytest.mark.parametrize("cells", [op12_spelling.TILE_CELLS, 40])
def test_spelling_equals_brute_force(spark, docs, cells):
    more = " ".join(["harvest"] * 30 + ["harvester"] * 3 + ["harvests"] * 2 + ["harves"] * 2 + ["éclairées"] * 2 + ["abcdefg"] * 2 + ["abcdefh"] * 20 + ["abcdeih"] * 200 + ["aaaaaaa"] * 2 + ["aaaaaaaa"] * 2 + ["b" * 3000] * 2 + ["b" * 2999] * 20)
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(7, more), (8, " ".join(f"prefixed{a}{b}" for a in "abcdefgh" for b in "abcdefgh") + " "), (9, "×÷Abcdefg")], "doc_id long, text string"))
    rows = rows.unionByName(rows.where("doc_id = 8"))
    counted = op12_spelling.words(rows)
    n = brute_words([(r.doc_id, r.text) for r in rows.collect()])
    assert {(r.word, r.n) for r in counted.collect()} == set(n.items())
    got = op12_spelling.variants(counted, tile_cells=cells).collect()
    assert len(got) == len(n) and {(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in got} == brute_variants(n)
    assert sum(r.form is not None for r in got) > 2


def test_spelling_of_nothing(docs):
    assert op12_spelling.variants(op12_spelling.words(docs.where("false"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=5), min_size=2, max_size=12, unique=True))
def test_tiles_find_single_edits(found):
    pairs = [(found[i], found[j]) for k in (4, 5) for a, b in op12_spelling.tile_pairs([w for w in found if k - 1 <= len(w) <= k], k, 0, k) for i, j in [(found.index([w for w in found if k - 1 <= len(w) <= k][x]), found.index([w for w in found if k - 1 <= len(w) <= k][y])) for x, y in zip(a, b)]]
    assert {frozenset(p) for p in pairs} == {frozenset((v, w)) for v in found for w in found if v != w and w in set(edits(v, "ab"))} and len(pairs) == len(set(map(frozenset, pairs)))


def test_negatives_equal_the_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    found = op11_hard_negatives.op11_hard_negatives(spark, "/root/testdata/sf0.01")
    want = con.sql(op11_hard_negatives.ORACLE_SQL)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall()) and found.count() > 0


def brute_negatives(rows):
    whole = [(i, k, np.floor(256 * np.array(v, float)).astype(int)) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = collections.Counter(), set()
    for a, label, v in whole:
        if a % 3 or (a, label, tuple(v)) in seen:
            continue
        seen.add((a, label, tuple(v)))
        scored = sorted((-int(v @ u), i, k) for i, k, u in whole if i != a and len(u) == len(v))
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            window = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out.update((a, i, r + 1, s[1], -p, -s[0]) for r, s in enumerate(window[:10]))
    return out


@pytest.mark.parametrize("block_rows", [10, 1 << 15])
def test_negatives_awkward_rows(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(160)]
    rows += [(i, i % 2, [1.0] * 6) for i in range(200, 260)] + rows[:7] + [(3, 1, [2.0] * 6), (6, 0, None), (9, None, [1.0] * 6), (None, 1, [1.0] * 6), (12, 1, [None] * 6), (15, 1, [float("nan")] * 6), (18, 1, [float("inf")] * 6)]
    rows += [(300 + i, i % 2, [float(i)]) for i in range(8)] + [(400 + i, i % 2, []) for i in range(6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, mark string").repartition(3)
    found = op11_hard_negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, block_rows=block_rows)
    assert collections.Counter(map(tuple, found.collect())) == brute_negatives(rows)
    assert op11_hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") % 3 == 0).count() == 0
    one = op11_hard_negatives.hard_negatives(df.where("vec_id = 300"), F.col("vec_id") % 3 == 0)
    assert one.count() == 0


def test_most_cells_are_not_visited():
    """On clustered vectors the certificate ends the walk early."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(64, 16)) * 1000
    vectors = np.floor(centers[rng.integers(0, 64, 20_000)] + rng.normal(size=(20_000, 16)) * 20).astype(np.int64)
    index = op11_hard_negatives.MultiIndex(np.arange(20_000), np.zeros(20_000, np.int64), vectors)
    visited = [0]
    whole = index.cells

    def counted(query):
        for cell in whole(query):
            visited[0] += 1
            yield cell

    index.cells = counted
    (best,) = index.search(vectors[5], -1, 0, True, [(-(1 << 62), 1 << 62)], 10)
    order = np.lexsort((np.arange(20_000), -(vectors @ vectors[5])))[:10]
    assert [i for i, _ in best] == order.tolist()
    assert visited[0] < sum(1 for _ in whole(vectors[5])) / 4


def test_contract_columns(spark, sf_dir):
    found = op13_decontaminate.op13_decontaminate(spark, sf_dir).collect()
    want = brute_contamination([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    digest = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == collections.Counter({(d, n, len(h), len(i), digest(i), len(h) > 0): c for (d, n, h, i), c in want.items()})
