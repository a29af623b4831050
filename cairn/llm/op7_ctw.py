"""Language-model scores by context-tree weighting.

Every byte is eight binary decisions, each made in the context of the bytes before it, from none to DEPTH. A node of the
tree is a context with the bits of the byte so far; it holds how often 0 and 1 came next in the training texts. A
node's Krichevsky-Trofimov estimate and the weighted product of its children's share its weight evenly, so that the
root's probability mixes all trees of contexts; after training, each node keeps its estimate and the weight that the mixture
gives to it against its children. The counts are sums over all training texts, and the recursion over the tree runs where the counts
of two last bytes meet: first for what depth 1 gets from below, then, with depths 0 and 1 known, for the probability of every byte
after every context that the texts hold. No node is dropped. Scoring tasks get the probabilities of the most common contexts
with their bytes; texts get those of the others by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import doc_texts, slices, table, written

DEPTH = 5
#: Common contexts with their bytes whose probabilities every task gets; the others are looked up by a join.
CONTEXTS = 1 << 21
#: Frequent tokens whose counts every task gets; the others are looked up by a join.
DICTIONARY = 1 << 19
FOLDS, HELD = 7, 2
_SLICE = 1 << 20
_FLUSH = 700_000
_BUCKETS = 16


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def _joined(found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents, words joined by a space, each behind DEPTH zeros and with a zero as its end, and their ends."""
    parts = [bytes(DEPTH) + b" ".join(w) + b"\0" for w in found]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))


def _keys(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte to be predicted: its context, the last byte foremost, and then itself; and how many each document has."""
    key = np.zeros(len(raw) - DEPTH, np.int64)
    for d in range(1, DEPTH + 1):
        key = key << 8 | raw[DEPTH - d : len(raw) - d]
    key = key << 8 | raw[DEPTH:]
    sizes = np.diff(ends, prepend=0) - DEPTH
    keep = np.ones(len(raw), bool)
    begins = ends - sizes - DEPTH
    keep[(begins[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[keep[DEPTH:]], sizes


def _token_ids(found: list[list[bytes]]) -> np.ndarray:
    return np.fromiter((h for w in found for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, sum(map(len, found))).view(np.int64)


END_TOKEN = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(b"\n end of text"))))  # holds white space: no word is like it


def training_counts(docs: DataFrame, learned: Column | None = None) -> DataFrame:
    """kind, key, n, m: how often each byte followed each full context (kind 0) and how often each token occurs (kind 1), over
    the learned rows of docs (n; all of them by default) and over all of docs (m). Tasks add up what they have read before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]

        def merged(kind: int) -> pa.RecordBatch:
            keys, *times = (np.concatenate(c) for c in zip(*held[kind], strict=True))
            unique, at = np.unique(keys, return_inverse=True)
            n, m = (np.bincount(at, t).astype(np.int64) for t in times)
            held[kind] = [(unique, n, m)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), kind, np.int32)), pa.array(unique), pa.array(n), pa.array(m)], ["kind", "key", "n", "m"])

        for batch in slices(batches, 1, _SLICE):
            found = [words(t) for t in batch.column(1).to_pylist()]
            learn = batch.column(2).to_numpy(zero_copy_only=False)
            tokens = np.append(_token_ids(found), np.full(len(found), END_TOKEN))
            key, sizes = _keys(*_joined(found))
            many = np.fromiter(map(len, found), np.int64, len(found))
            for kind, keys, of in ((0, key, np.repeat(learn, sizes)), (1, tokens, np.append(np.repeat(learn, many), learn))):
                coded = pa.array(keys).dictionary_encode()
                at = coded.indices.to_numpy()
                held[kind].append((coded.dictionary.to_numpy(), np.bincount(at, of, len(coded.dictionary)), np.bincount(at)))
                if sum(len(k) for k, _, _ in held[kind]) > _FLUSH:
                    rows = merged(kind)
                    if rows.num_rows > _FLUSH // 2:
                        yield rows
                        held[kind] = []
        for kind in (0, 1):
            if held[kind]:
                yield merged(kind)

    rows = docs.select("doc_id", "text", (F.lit(True) if learned is None else learned).alias("learned"))
    made = doc_texts(rows, "learned").mapInArrow(run, "kind int, key long, n long, m long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x of a half or more."""
    shift = np.ones_like(x)
    for i in range(7):
        shift *= x + i
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1.0)


def _nodes(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes under (context, byte) counts: context with the bits so far behind a leading one, and counts of 0 and 1."""
    byte, context = key & 255, key >> 8
    names, ones = [], []
    for bit in range(8):
        names.append(context << 8 | (1 << bit | byte >> (8 - bit)))
        ones.append(byte >> (7 - bit) & 1)
    unique, at = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(at, np.tile(n, 8))
    n1 = np.bincount(at, np.concatenate(ones) * np.tile(n, 8))
    return unique, total - n1, n1


def _weighted(names: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of each node, and the weight of its own estimate. below: parents' names, and the
    weighted log probabilities of the nodes beneath."""
    own = _kt(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    beneath = np.bincount(np.searchsorted(names, below[0]), below[1], len(names))
    both = np.logaddexp(own, beneath) - math.log(2)
    return both, np.exp(own - both) / 2


def _parent(names: np.ndarray) -> np.ndarray:
    return names >> 16 << 8 | names & 255


def _deep(key: np.ndarray, n: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]:
    """The nodes of depth 2 and more under counts of full contexts: for each depth names, estimates of a one and their weights; and
    for the nodes of depth 1 above them names, counts of 0 and 1, and the log probability beneath."""
    seen = n > 0
    key, n, below, nodes = key[seen], n[seen], None, {}
    for d in range(DEPTH, 1, -1):
        names, n0, n1 = _nodes(key, n)
        total, own = _weighted(names, n0, n1, below)
        nodes[d] = names, (n1 + 0.5) / (n0 + n1 + 1), own
        below = _parent(names), total
        key, at = np.unique(_parent(key), return_inverse=True)
        n = np.bincount(at, n, len(key))
    up, at = np.unique(below[0], return_inverse=True)
    return nodes, (up, *(np.bincount(at, v, len(up)) for v in (n0, n1, below[1])))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in order of their first, key, cut only where the two last bytes of the context change."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        group = columns[0] >> 32
        cut = int(np.searchsorted(group, group[-1]))
        if cut or held and held[0][0][0] >> 32 != group[-1]:
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns], strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _grouped(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 0").select("key", "n", "m").repartition(F.shiftright("key", 32)).sortWithinPartitions("key")


class Tree:
    """The frozen mixture: dense tables of depths 0 and 1, sorted names of the deeper ones."""

    def __init__(self, shallow: list[tuple[np.ndarray, np.ndarray, np.ndarray]], deep: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.shallow, self.deep = shallow, deep

    def _node(self, depth: int, context: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the node is there, its estimate of a one, and that estimate's weight."""
        names = context << 8 | bits
        if depth < 2:
            seen, p, w = self.shallow[depth]
            return seen[names], p[names], w[names]
        known, p, w = self.deep[depth]
        if not len(known):
            return np.zeros(len(names), bool), np.full(len(names), 0.5), np.ones(len(names))
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        return known[at] == names, p[at], w[at]

    def log10(self, key: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of bytes after contexts."""
        byte, out = key & 255, np.zeros(len(key))
        for bit in range(8):
            bits = 1 << bit | byte >> (8 - bit)
            p, any_below = np.full(len(key), 0.5), np.zeros(len(key), bool)
            for d in range(DEPTH, -1, -1):
                seen, own, weight = self._node(d, key >> (8 * (DEPTH - d) + 8), bits)
                p = np.where(seen, np.where(any_below, weight * own + (1 - weight) * p, own), p)
                any_below |= seen
            out += np.log10(np.where(byte >> (7 - bit) & 1, p, 1 - p))
        return out


def shallow_nodes(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Depths 0 and 1 from training counts: which nodes are there, their estimates and weights. The driver gets at most
    256 x 255 nodes of depth 1."""
    names = ["name", "n0", "n1", "beneath"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, _ in _whole_groups(batches):
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, t)) for c, t in zip(_deep(key, n)[1], (np.int64, float, float, float), strict=True)], names)

    rows = _grouped(counts).mapInArrow(run, "name long, n0 double, n1 double, beneath double")
    top = rows.groupBy("name").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow().sort_by("name")
    names, n0, n1, beneath = (top.column(c).to_numpy() for c in names)
    shallow = []
    below = (names, beneath)
    for size in (1 << 16, 1 << 8):
        total, own = _weighted(names, n0, n1, below) if len(names) else (names, names)
        seen, p, w = np.zeros(size, bool), np.full(size, 0.5), np.ones(size)
        seen[names], p[names], w[names] = True, (n1 + 0.5) / (n0 + n1 + 1), own
        shallow.insert(0, (seen, p, w))
        up, at = np.unique(names & 255, return_inverse=True)
        below = (names & 255, total)
        names, n0, n1 = up, np.bincount(at, n0, len(up)), np.bincount(at, n1, len(up))
    return shallow


def grown_tree(counts: DataFrame) -> Tree:
    """The whole tree in one place, for small tables of counts."""
    rows = counts.where("kind = 0").select("key", "n").toArrow()
    return Tree(shallow_nodes(counts), _deep(rows.column("key").to_numpy(), rows.column("n").to_numpy())[0])


def probabilities(counts: DataFrame) -> DataFrame:
    """key, m, log: the logarithm of the probability of every byte after every context in counts, those that training never
    saw (n = 0) included. All nodes of a group of contexts are held where its keys are."""
    shallow = counts.sparkSession.sparkContext.broadcast(shallow_nodes(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, m in _whole_groups(batches):
            log = Tree(shallow.value, _deep(key, n)[0]).log10(key)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(m), pa.array(log)], ["key", "m", "log"])

    return _grouped(counts).mapInArrow(run, "key long, m long, log double")


def _most(rows: DataFrame, times: str, room: int) -> Column:
    """Whether a row is among the most common ones: those of the highest steps of a logarithmic scale of times that
    together are no more than room."""
    step = F.floor(F.log2(times) * _BUCKETS)
    least = math.inf
    for s, many in sorted(rows.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= many
        if room < 0:
            break
        least = s
    return step >= F.lit(least)


def trains(column: str = "doc_id"):
    """Rows to learn from; a row without a doc_id is one of them."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS != HELD, F.lit(True))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    The model scores the tokens of a text: its words in lower case with one space between, then the end. Null text counts as
    empty and has the end alone. Repeated rows stay and are learned from as often; an empty table gives no rows; without
    training rows every bit has probability 1/2.
    """
    spark = docs.sparkSession
    counts = written(training_counts(docs, trains()), "counts")
    contexts = written(probabilities(counts), "contexts")
    tokens = counts.where("kind = 1 and n > 0").select("key", "n")
    n_train, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = [_most(contexts, "m", CONTEXTS), _most(tokens, "n", DICTIONARY)]
    values = [contexts.select("key", "log", common[0].alias("common")), tokens.select("key", F.log10(F.col("n") + 1.0).alias("log"), common[1].alias("common"))]
    known = [v.where("common").select("key", "log").toArrow().sort_by("key") for v in values]
    frequent = spark.sparkContext.broadcast([(k.column("key").to_numpy(), k.column("log").to_numpy()) for k in known])
    schema = "row long, doc_id long, n_tokens long, n_bytes long, score double, log_known double, n_known long, kind int, key long, times long"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40

        def record(**given) -> pa.RecordBatch:
            n = len(next(iter(given.values())))
            return pa.RecordBatch.from_arrays([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

        for batch in slices(batches, 1, _SLICE):
            found = [words(t) for t in batch.column(1).to_pylist()]
            key, sizes_ = _keys(*_joined(found))
            many = np.fromiter(map(len, found), np.int64, len(found))
            token = np.append(_token_ids(found), np.full(len(found), END_TOKEN))
            n = len(found)
            rows = row + np.arange(n)
            row += n
            sums, others = [], []
            for kind, each, owner in ((0, key, np.repeat(np.arange(n), sizes_)), (1, token, np.append(np.repeat(np.arange(n), many), np.arange(n)))):
                held, logs = frequent.value[kind]
                at = np.searchsorted(held, each)
                at[at == len(held)] = 0
                hit = held[at] == each if len(held) else np.zeros(len(each), bool)
                sums.append((np.bincount(owner[hit], logs[at[hit]], n), np.bincount(owner[hit], minlength=n)))
                rare = np.stack([rows[owner[~hit]], each[~hit]])
                if rare.shape[1]:
                    rare = rare[:, np.lexsort(rare[::-1])]
                    first = np.append(True, (np.diff(rare) != 0).any(axis=0))
                    times = np.diff(np.append(np.flatnonzero(first), rare.shape[1]))
                    others.append(record(row=rare[0, first], kind=np.full(len(times), kind, np.int32), key=rare[1, first], times=times))
            yield record(row=rows, doc_id=batch.column(0), n_tokens=many + 1, n_bytes=sizes_, score=sums[0][0], log_known=sums[1][0], n_known=sums[1][1])
            yield from others

    made = written(doc_texts(docs).mapInArrow(run, schema), "scores")
    looked_up = values[0].where("not common").select(F.lit(0).alias("kind"), "key", "log").unionByName(values[1].where("not common").select(F.lit(1).alias("kind"), "key", "log"))
    rare = made.where("kind is not null").select("row", "kind", "key", "times").join(looked_up, ["kind", "key"])
    is_token = F.col("kind") == 1
    part = F.col("times") * F.col("log")
    rare = rare.groupBy("row").agg(F.sum(F.when(is_token, part)).alias("log_rare"), F.sum(F.when(is_token, F.col("times"))).alias("n_rare"), F.sum(F.when(~is_token, part)).alias("score_rare"))
    out = made.where("kind is null").join(rare, "row", "left").withColumn("score", F.col("score") + F.coalesce("score_rare", F.lit(0.0)))
    per_token = math.log10(n_train + distinct + 1)
    return out.select(
        "doc_id", (~trains()).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("log_known") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return scores(table(spark, sf_dir, "documents"))
