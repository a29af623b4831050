"""Each operator against a brute-force version, a round trip or held-out accuracy, with the awkward cases in one fixture."""

import collections
import hashlib
import math
import os
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import op1_quality, op2_token_files, op3_mixing, op4_bpe, op5_repeats, op6_fingerprint, op7_ctw, op8_near_duplicates, op9_pii, op10_topk

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of rare herbs and moonlight near the old stone bridge at dawn "
PASSAGE = " ".join(f"shared{i}" for i in range(60))
NEAR = [" ".join(f"near{i}" for i in range(120)), " ".join(f"near{i}" for i in range(118)), "odd start " + " ".join(f"near{i}" for i in range(120))]
TEXTS = [
    None, "", " ", "\n\n", "a", "one two three four", "one two three four", "The Cat sat", "the cat SAT", "x" * 3000, "1." * 900 + "1", "ab " * 1500,
    LONG * 3, LONG * 3, "prefix words " + PASSAGE + " tail one", "another beginning " + PASSAGE + " and another end", *NEAR,
    "mail joe.b+c@mail.example.com or +1 (244) 555-4688, card 4111 1111 1111 1111, ip 10.0.0.255 not 10.0.0.256", "password=36fdea71d793cf922e é🙂 a@b.c_d@e.f",
    "<|endoftext|> It's  we'll\t　 x  y\x85z \x00 é́ 你好 مرحبا 🙂🙂", "  lead and trail  ", "﻿bom", "naïve café déjà",
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Documents of all kinds; a repeated row, a missing doc_id and columns whose names the operators use themselves."""
    own = [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1005, TEXTS[5]), (None, "no id here")]
    rows = own + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    made = [(i, t, "en", "s", len(t or ""), "x", 1, None) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, node int, part string"
    return spark.createDataFrame(made, schema).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_bpe_equals_the_library(docs, empty, pairs):
    t = Tokenizer.from_file(BPE)
    want = []
    for i, text in pairs:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), tuple(ids), t.decode(ids, skip_special_tokens=False)))
    got = op4_bpe.encode_decode(docs, BPE).collect()
    assert counted((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in got) == counted(want)
    assert op4_bpe.encode_decode(empty, BPE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdre.0é　\x1c\x85")), max_size=40), min_size=1, max_size=5))
def test_chunks_change_nothing(texts):
    t = Tokenizer.from_file(BPE)
    pairs, encoder = op4_bpe._encoder(BPE)
    library = op2_token_files._encoder(BPE)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [a.tolist() for a in encoder(pa.array(texts))] == want
    assert [a.tolist() for a in library(pa.array(texts))] == want
    assert [pairs.decode(w) for w in want] == [t.decode(w, skip_special_tokens=False) for w in want]


def test_merges_of_a_long_piece():
    t, pairs = Tokenizer.from_file(BPE), op4_bpe.BytePairs(BPE)
    for piece in ("a" * 5000, "abc" * 3000, "".join(chr(97 + i * i % 26) for i in range(4000))):
        assert pairs.encode(piece) == t.encode(piece, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    ef = op2_token_files.EliasFano.from_bytes(op2_token_files.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert ef.all().tolist() == values and all(ef.select(i) == v for i, v in enumerate(values))


def test_token_files_round_trip(spark, docs, empty, pairs, tmp_path):
    path = f"file://{tmp_path}/files"
    op2_token_files.write_token_files(docs, path, BPE, part_bytes=20_000)
    t = Tokenizer.from_file(BPE)
    got = sorted(op2_token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(got) == len(pairs)
    want = {}
    for i, text in pairs:
        want.setdefault(i, []).append([*t.encode(text, add_special_tokens=False).ids, 2])
    start = 0
    for r in got:
        assert r.start == start and r.ids in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    op2_token_files.write_token_files(empty, path + "-none", BPE)
    assert op2_token_files.read_token_files(spark, path + "-none").count() == 0


def test_wide_ids_and_negative_doc_ids_in_a_block():
    block = op2_token_files.pack_block(3, 1, [None, -5, 2**40], [np.array([70_000, 2]), np.array([2]), np.array([1, 2])]) + b"\n"
    (shard, number, names, ends, ids), = op2_token_files.unpack_blocks(block)
    assert (shard, number, names, ends.all().tolist(), ids.tolist()) == (3, 1, [None, -5, 2**40], [2, 3, 5], [70_000, 2, 2, 1, 2])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = op1_quality.op1_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found.predicted == found.quality).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_quality_awkward_rows(docs, empty, pairs):
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") % 3 == 0, 0).alias("quality"))
    trees = op1_quality.quality_model(docs, labels)
    found = op1_quality.scored(docs, trees)
    assert found.count() == len(pairs) and found.where("score between 0 and 1").count() == len(pairs)
    assert op1_quality.kept(docs, trees, 0.0).columns == docs.columns and op1_quality.kept(empty, trees).count() == 0
    flat = op1_quality.fit(docs, labels.where("quality = 1"))
    assert op1_quality.scored(docs, flat).select("score").distinct().count() == 1
    assert op1_quality.fit(empty, labels.where("false")).score(np.zeros((1, op1_quality.N_FEATURES)))[0] == 0.5


def test_trees_walk_like_plain_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    trees = op1_quality.fit_trees(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=10)
    for row, value in zip(x[:50], trees.raw(x[:50]), strict=True):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        assert abs(total - value) < 1e-9


def test_mixing_reaches_targets(spark, docs, empty, pairs):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, mixture, members = op3_mixing.fit(d, labels)
    assert np.allclose(mixture.totals, mixture.wanted, rtol=1e-4)
    found = op3_mixing.rates(d, labels).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.domain == found.lang).mean() > 0.95 and (found.rate >= 0).all()
    # The steps of the fit by plain numpy, from the same posteriors and tokens.
    m = members.toPandas()
    p, t = m[[f"p{k}" for k in range(len(model.prior))]].to_numpy(), m.tokens.to_numpy()
    rate = np.ones(len(m))
    for step in mixture.steps:
        rate = np.maximum(0, rate - p @ np.array(step))
    assert np.allclose((rate * t) @ p, mixture.totals)
    less = op3_mixing.fit_rates(members, total=0.5 * t.sum())
    assert np.allclose(less.totals, less.wanted, rtol=1e-3)
    mixed = op3_mixing.mixed(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() >= len(pairs)
    assert op3_mixing.rates(empty, labels).count() == 0


def test_domains_equal_brute_force_and_hold_out(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows, domains = d.select("doc_id", "text", "lang").collect(), list(op3_mixing.TARGETS)
    known = {r.doc_id for r in labels.select("doc_id").collect()}
    buckets = lambda text: [xxhash.xxh64_intdigest(w.encode(), seed=42) % 2**64 for w in re.split("[ \n]", (text or "").lower())]
    at = lambda h: (h - 2**64 if h >= 2**63 else h) % op3_mixing.BUCKETS
    counts, n = {k: collections.Counter() for k in domains}, collections.Counter()
    for r in rows:
        if r.doc_id in known and r.lang in counts:
            counts[r.lang].update(map(at, buckets(r.text)))
            n[r.lang] += 1
    model = op3_mixing.fit_domains(d.withColumn("domain", F.col("lang")), labels)
    for k in domains:
        whole = sum(counts[k].values()) + 0.5 * op3_mixing.BUCKETS
        assert np.allclose(model.rate[k], [(counts[k][b] + 0.5) / whole for b in range(op3_mixing.BUCKETS)]) and np.isclose(model.prior[k], (n[k] + 1) / (sum(n.values()) + len(domains)))
    logs = {k: np.log(model.rate[k]) for k in domains}
    found = op3_mixing.with_membership(d.select("doc_id", "text"), model).collect()
    lang, right, held = {r.doc_id: r.lang for r in rows}, 0, 0
    for r in found:
        words = [at(h) for h in buckets(r.text)]
        tokens = len(re.split("[ \n]", r.text)) if r.text else 0
        loud = np.array([np.log(model.prior[k]) + (min(1.0, op3_mixing.EVIDENCE / tokens) if tokens else 0.0) * logs[k][words].sum() for k in domains])
        p = np.exp(loud - loud.max())
        assert r.tokens == tokens and np.allclose([r[f"p{k}"] for k in range(len(domains))], p / p.sum(), atol=1e-9)
        if r.doc_id not in known:
            held, right = held + 1, right + (domains[int(p.argmax())] == lang[r.doc_id])
    assert held > 100 and right > 0.95 * held
    # Without labels each domain is as likely; with a bound of no rows as well.
    for flat in (op3_mixing.fit_domains(empty.withColumn("domain", F.col("lang")), labels), op3_mixing.fit_domains(d.withColumn("domain", F.col("lang")), labels.where("false"))):
        assert set(flat.prior.values()) == {0.25}
        one = op3_mixing.with_membership(docs, flat, "_" * 9).where("text is null or text = ''").collect()
        assert one and all(np.isclose(r["_" * 9 + "p0"], 0.25) and r["_" * 9 + "tokens"] == 0 for r in one)


def brute_repeats(pairs, length):
    raw = [t.encode() for _, t in pairs]
    seen = collections.Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(pairs, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=False) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "meet"), [(200, 32, 256), (40, 8, 1)])
def test_repeats_equal_brute_force(docs, empty, pairs, monkeypatch, length, gram, meet):
    monkeypatch.setattr(op5_repeats, "MEET", meet)
    assert counted(op5_repeats.without_repeats(docs, length, gram).collect()) == counted(brute_repeats(pairs, length))
    assert op5_repeats.without_repeats(empty, length, gram).count() == 0


def test_edited_fingerprints(docs, empty, pairs):
    ordered = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = op6_fingerprint.edited_fingerprints(docs).collect()
    assert counted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == counted(want)
    plain = counted(op6_fingerprint.fingerprints(docs).collect())
    assert counted((r.doc_id, r.fingerprint) for r in got) == plain
    assert np.mean([r.near_edited for r in got if r.n_chars > 400]) > 0.4 > np.mean([r.near_next for r in got if r.n_chars > 400])
    assert op6_fingerprint.edited_fingerprints(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=12), max_size=8), st.lists(st.text(alphabet="ab c", max_size=12), max_size=4), st.randoms())
def test_fingerprints_add_up(own, more, random):
    whole = op6_fingerprint.to_hex(op6_fingerprint.paragraph_vector(own + more))
    assert op6_fingerprint.changed(op6_fingerprint.to_hex(op6_fingerprint.paragraph_vector(own)), added=more) == whole
    mixed = own + more
    random.shuffle(mixed)
    assert op6_fingerprint.to_hex(op6_fingerprint.paragraph_vector(mixed)) == whole
    assert op6_fingerprint.changed(whole, removed=more) == op6_fingerprint.to_hex(op6_fingerprint.paragraph_vector(own))


def brute_tree(texts):
    """Counts, weights and probabilities of a context tree, node by node."""
    nodes = collections.defaultdict(lambda: [0, 0])

    def path(text):
        b = bytes(op7_ctw.DEPTH) + b" ".join(op7_ctw.words(text)) + b"\0"
        for i in range(op7_ctw.DEPTH, len(b)):
            for bit in range(8):
                yield [(b[i - d : i], 1 << bit | b[i] >> (8 - bit)) for d in range(op7_ctw.DEPTH + 1)], b[i] >> (7 - bit) & 1

    for t in texts:
        for names, bit in path(t):
            for n in names:
                nodes[n][bit] += 1
    below, weight = collections.defaultdict(list), {}
    for c, p in nodes:
        if c:
            below[(c[1:], p)].append((c, p))

    def log_probability(n):
        a, b = nodes[n]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        if len(n[0]) == op7_ctw.DEPTH:
            weight[n] = 1.0
            return own
        both = np.logaddexp(own, sum(map(log_probability, below[n]))) - math.log(2)
        weight[n] = 0.5 * math.exp(own - both)
        return both

    for n in list(nodes):
        if n[0] == b"":
            log_probability(n)

    def score(text):
        total = 0.0
        for names, bit in path(text):
            p = None
            for n in reversed(names):
                if n in weight:
                    a, b = nodes[n]
                    own = (b + 0.5) / (a + b + 1)
                    p = own if p is None else weight[n] * own + (1 - weight[n]) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_context_tree_equals_node_by_node(spark):
    texts = ["the cat sat on the mat", "the rat sat", "On The cat", "", "zz top"]
    tree = op7_ctw.grown_tree(op7_ctw.training_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    score = brute_tree(texts)
    for t in [*texts, "the cat ran", "unseen éé"]:
        key, _ = op7_ctw._keys(*op7_ctw._joined([op7_ctw.words(t)]))
        assert abs(tree.log10(key).sum() - score(t)) < 1e-3 * max(1, -score(t))
    for context in (0, ord("t") << 32 | ord(" ") << 24):
        assert abs(sum(10 ** tree.log10(np.array([context << 8 | b]))[0] for b in range(256)) - 1) < 1e-9


def test_tree_keeps_every_node(spark, monkeypatch):
    """Some 400,000 nodes of the greatest depth, which would share places in a table of fixed size; common contexts fit in no dictionary."""
    monkeypatch.setattr(op7_ctw, "CONTEXTS", 500, raising=False)
    draw = random.Random(3)
    texts = ["".join(draw.choice(string.ascii_lowercase + string.digits + "  ") for _ in range(6000)) for _ in range(9)]
    rows = list(enumerate(texts))
    score = brute_tree([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    found = {r.doc_id: r for r in op7_ctw.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any(r.held_out for r in found.values())
    for i, t in rows:
        assert abs(found[i].score - score(t)) < 1e-6 * -score(t)


def test_language_scores(docs, empty, pairs, monkeypatch):
    monkeypatch.setattr(op7_ctw, "DICTIONARY", 20)
    trained = [(i, t) for i, t in pairs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    c = collections.Counter(w for _, t in trained for w in words(t))
    c[None] = len(trained)
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, t in pairs:
        tokens = [*words(t), None]
        want[i].append((len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)))
    for r in op7_ctw.scores(docs).collect():
        assert any((r.n_tokens, r.n_known, r.train_tokens) == w[:3] and abs(r.base_score - w[3]) < 1e-6 * max(1, -w[3]) for w in want[r.doc_id])
        assert r.score < 0 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert op7_ctw.scores(empty).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="needs the larger table")
def test_held_out_texts_score_above_base(spark):
    """On texts that the model didn't learn from, it beats smoothed counts of tokens by the mean over tokens and in most texts."""
    scored = op7_ctw.scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out and n_tokens > 20")
    mean, base, better = scored.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("double"))).first()
    assert mean > base + 0.1 and better > 0.8


def test_likeness_of_repetitive_and_plain_texts():
    """Near copies of one phrase repeated past 2^15 times, and the sketch's cosine against that of the exact counts of word triples."""
    long, half = (op6_fingerprint.text_vector("a b c " * n) for n in (40_000, 20_000))
    assert op6_fingerprint.likeness(long, half) > 0.99
    rng = np.random.default_rng(6)

    def exact(a, b):
        x, y = (collections.Counter(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in (a, b))
        return sum(n * y[k] for k, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))

    words = [f"w{i}" for i in range(200)]
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = list(rng.choice(words, 600))
        b = a[: int(share * 600)] + list(rng.choice(words, 600 - int(share * 600)))
        a, b = " ".join(a), " ".join(b)
        assert abs(op6_fingerprint.likeness(op6_fingerprint.text_vector(a), op6_fingerprint.text_vector(b)) - exact(a, b)) < 0.25


def brute_components(pairs):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(pairs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = pairs[a][0] is not None and pairs[a][0] == pairs[b][0]
            if both and 100 * both >= 75 * len(sets[a] | sets[b]) or same and sets[a] == sets[b]:
                up[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for x in range(len(pairs)):
        groups[root(x)].append(pairs[x][0])
    return [(i, len(s), min((g for g in groups[root(x)] if g is not None), default=None)) for x, ((i, _), s) in enumerate(zip(pairs, sets, strict=True))]


def test_components_equal_all_pairs(docs, empty, pairs):
    found = op8_near_duplicates.near_duplicates(docs)
    assert counted(found.collect()) == counted(brute_components(pairs))
    assert op8_near_duplicates.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(docs, pairs):
    kept = op8_near_duplicates.one_of_each(docs)
    want = collections.Counter({i: 1 for i, _, c in brute_components(pairs) if i is None or i == c})
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == want


def test_one_doc_id_with_two_texts(spark):
    """A near copy of another document and a clean text under one doc_id; near copies under one doc_id; near copies without one."""
    copy, own = " ".join(f"p{i}" for i in range(80)), " ".join(f"q{i}" for i in range(80))
    twice, lone = " ".join(f"r{i}" for i in range(80)), " ".join(f"s{i}" for i in range(80))
    rows = [(1, copy), (5, copy + " more"), (5, own), (6, own + " more"), (7, twice), (7, twice + " more"), (7, twice), (None, lone), (9, lone + " more"), (10, lone + " much"), (None, copy + " less")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(op8_near_duplicates.near_duplicates(docs).collect()) == counted(brute_components(rows))
    kept = collections.Counter((r.doc_id, r.text) for r in op8_near_duplicates.one_of_each(docs).collect())
    sevens = {t: n for (i, t), n in kept.items() if i == 7}
    assert list(sevens.values()) == [1]
    assert {k: n for k, n in kept.items() if k[0] != 7} == {(1, copy): 1, (5, own): 1, (9, lone + " more"): 1, (None, lone): 1, (None, copy + " less"): 1}


def test_long_lists_and_chains(spark, monkeypatch):
    """Many documents with one passage, and a chain whose ends aren't linked themselves."""
    monkeypatch.setattr(op8_near_duplicates, "LONG_LIST", 2)
    monkeypatch.setattr(op8_near_duplicates, "STAR", 2)
    boiler = " ".join(f"b{i}" for i in range(30))
    texts = [f"{boiler} " + " ".join(f"d{n}w{i}" for i in range(20 + n % 7)) for n in range(25)]
    chain = [" ".join(f"c{i}" for i in range(k * 10, k * 10 + 100)) for k in range(6)]
    rows = list(enumerate(texts + chain + chain[:1]))
    found = op8_near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(found.collect()) == counted(brute_components(rows))


def test_hot_groups_by_leaders(spark, monkeypatch):
    """Edited copies of two texts that share half of their words, from next to nothing changed to too much: long lists are led."""
    monkeypatch.setattr(op8_near_duplicates, "LONG_LIST", 0.5)
    monkeypatch.setattr(op8_near_duplicates, "STAR", 7)
    rng = np.random.default_rng(11)
    first = [f"w{i}" for i in range(120)]
    second = first[:60] + [f"v{i}" for i in range(60)]
    rows = []
    for n in range(160):
        words = list((first, second)[n % 2])
        edits = [f"new{rng.integers(0, 30)}" for _ in range(rng.integers(0, 9))]
        for e in edits:
            words[rng.integers(0, 120)] = e
        rows.append((n, " ".join(words)))
    levels = []
    lists = op8_near_duplicates._difference_lists
    monkeypatch.setattr(op8_near_duplicates, "_difference_lists", lambda *a: levels.append(1) or lists(*a))
    found = op8_near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(found.collect()) == counted(brute_components(rows))
    assert len(levels) == op8_near_duplicates.LEVELS


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=120), st.lists(st.integers(0, 400), min_size=1, max_size=120))
def test_sketches_never_rule_out_a_link(a, b):
    x, y = (np.unique(op8_near_duplicates._mix(np.array(v, np.uint64))) for v in (a, b))
    both = len(set(a) & set(b))
    assert op8_near_duplicates.linked(x, y) == (100 * both >= 75 * len(set(a) | set(b)))
    if op8_near_duplicates.linked(x, y):
        assert op8_near_duplicates.may_link(op8_near_duplicates.parities(x), op8_near_duplicates.parities(y), len(x) + len(y))


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(re.sub("[ -]", "", m.group()))]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_base_spans_equal_plain_patterns(spark, docs, empty, pairs):
    rng = np.random.default_rng(3)
    odd = ["".join(rng.choice(list(a), rng.integers(0, 50))) for a in ("a@.1+- 2(5)%é\n", "0123456789- ", "1.25 ") for _ in range(150)]
    rows = pairs + [(10_000 + i, t) for i, t in enumerate(odd)]
    found = op9_pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = found.select("doc_id", op9_pii._listed("base"), op9_pii._listed("found")).collect()
    assert counted((r[0], r[1]) for r in got) == counted((i, ",".join(base_spans(t))) for i, t in rows)
    assert all(r[2].startswith(r[1]) for r in got)
    assert op9_pii.find(empty).count() == 0


def test_added_spans_and_redaction(spark):
    rows = [(1, "call (555) 123-4567 now"), (2, "password=36fdea71d793cf922e"), (3, "ssn 123-45-6789"), (4, "version 1.2.3 of 2024-01-02"), (5, "a@b.co x"), (6, None)]
    out = {r.doc_id: r.text for r in op9_pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "call [LOCAL_PHONE] now", 2: "password=[SECRET]", 3: "ssn [NATIONAL_ID]", 4: rows[3][1], 5: "[EMAIL] x", 6: ""}


def test_many_matches_and_clashing_names(spark):
    """100,000 addresses in one text, spans of several kinds across blocks, and columns called as the operator's own."""
    many = "é" * 700 + " ".join(f"u{i}@h{i % 97}.org" for i in range(100_000)) + " end"
    mixed = "x" * 1020 + " a@b.co +49 30 1234567 and (555) 123-4567, 10.0.0.1 " + "ö" * 3000 + " 123-45-6789 z"
    rows = [(1, many, "b1", "m1", "f1", "k"), (2, mixed, "b2", "m2", "f2", "k"), (3, "plain", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, more string, found string, _base string")
    out = {r.doc_id: r for r in op9_pii.redacted(docs).collect()}
    assert out[1].text == "é" * 700 + " ".join(["[EMAIL]"] * 100_000) + " end"
    assert out[2].text == "x" * 1020 + " [EMAIL] [PHONE] and [LOCAL_PHONE], [IP] " + "ö" * 3000 + " [NATIONAL_ID] z"
    assert [(r.base, r.more, r.found, r._base) for _, r in sorted(out.items())] == [r[2:] for r in rows]


def test_added_spans_that_touch_base_ones_go(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in range(200):
        drawn = [(bool(rng.integers(2)), int(rng.integers(0, 60 + n)), int(rng.integers(1, 12))) for _ in range(rng.integers(0, 200))]
        spans = [("secret" if added else "email", s, s + k, "", "", "") for added, s, k in drawn]
        rows.append((n, [s for s in spans if s[0] == "email"], sorted({s for s in spans if s[0] == "secret"})))
    kind = "array<struct<kind:string,start:long,end:long,text:string,before:string,after:string>>"
    found = spark.createDataFrame(rows, f"n int, base {kind}, more {kind}").select("n", op9_pii._apart(F.col("more"), F.col("base"))).collect()
    for n, got in found:
        base, more = rows[n][1:]
        assert [tuple(s) for s in got] == [m for m in more if not any(m[1] < b[2] and b[1] < m[2] for b in base)]


def test_reliabilities_follow_the_votes():
    patterns = [({"kind": "k", "regex": 1, "gazetteer": 1, "context": 1, "size": 0, "digits": 0}, 90), ({"kind": "k", "regex": 1, "gazetteer": 2, "context": 0, "size": 0, "digits": 0}, 5), ({"kind": "k", "regex": 0, "gazetteer": 0, "context": 0, "size": 1, "digits": 0}, 60)]
    model = op9_pii.fit_patterns(patterns)
    assert model.reliability["regex"][1][1] > 0.8 and model.reliability["context"][0][0] > 0.8


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 8) for i in range(60)]
    odd = [(2000, None), (2100, [None] * 8), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [0.1] * 8), (2400, [1.0, 2.0]), (3000, [1.0, -1.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").repartition(3)
    good = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in [*vectors, (2400, [1.0, 2.0]), (3000, [1.0, -1.0])]]
    want = []
    for q, v in good:
        if q % 100 == 0:
            near = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    got = op10_topk.top_k(df, F.col("vec_id") % 100 == 0, block_rows=150).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert op10_topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
