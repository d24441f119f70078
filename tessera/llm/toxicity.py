"""Toxicity by class-conditional Kneser-Ney models.

A word is generated along its prefixes (4, 6 and 8 bytes, the whole word); at each level a class has discounted counts
given the level before, and what the discount takes goes to the counts that both classes share (continuation counts:
in how many documents an expression is new). A text's score compares the length-normalised log-likelihoods of the two
classes, and a logistic curve, fitted on scores that the two halves of the training rows give each other, turns it into
a probability.

Counts are taken over all labelled rows whose crc32(doc_id as text) mod 3 is not 1. They stay on the executors, in
buckets that hold all nodes below a first prefix; only nodes that can change a feature come to the driver. The logistic
curve's three weights alone are fitted on at most MAX_PER_CLASS rows of each class, those with the least hash of doc_id.
Scores depend on the text alone.

Defined cases: a null text is empty; a text without words has the score of a neutral text (likelihood ratio zero).
Labels that repeat a doc_id count once, as toxic if any is; labels with a null don't count. With no toxic or no
ordinary training row the score is 0. Rows with a null doc_id are scored and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, binary, chunked, cut, id_texts, table
from tessera.llm.words import Hasher, words

MAX_PER_CLASS = 4000
CUT = 0.7
PREFIXES = (4, 6, 8)
DISCOUNT = 0.9
EVEN = 15
#: Words of a smaller ratio add nothing to the features.
LEAST = 2.0
BUCKETS = 512
_SALT = [np.uint64(0x1000193 * k + 7) for k in range(1, len(PREFIXES) + 2)]


def expressions(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of each level for all words of the texts, and the index of each word's text."""
    data, s, e, owner = words(texts)
    h = Hasher(data)
    levels = [h(s, np.minimum(e, s + n)) ^ _SALT[k] for k, n in enumerate(PREFIXES)]
    word = h(s, e)
    levels.append(word ^ _SALT[-1])
    return levels, owner


class Model:
    """By level: sorted keys, the log-likelihood ratio of each, and the ratio of what is missing below each node of the
    level before (the root before the first level)."""

    def __init__(self, keys: list[np.ndarray], llr: list[np.ndarray], miss: list[np.ndarray]):
        self.keys, self.llr, self.miss = keys, llr, miss
        self.weights: np.ndarray | None = None

    def word_ratios(self, levels: list[np.ndarray]) -> np.ndarray:
        """Log-likelihood ratio (toxic to ordinary) of each word along its prefixes."""
        out = np.zeros(len(levels[0]))
        live = np.arange(len(out))
        place = np.zeros(len(out), np.int64)
        for k in range(len(self.keys)):
            key = levels[k][live]
            if not len(self.keys[k]) or not len(live):
                break
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == key
            lost = live[~hit]
            out[lost] += self.miss[k][place[lost]]
            live, at = live[hit], at[hit]
            out[live] += self.llr[k][at]
            place[live] = at
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: logs of the length-normalised surplus of the toxic likelihood and of the share of words that
        carry it. A word that repeats the word before it counts once; EVEN words more make short texts comparable."""
        levels, owner = expressions(texts)
        word = levels[-1]
        if len(word):
            new = np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])
            levels, owner = [x[new] for x in levels], owner[new]
        r = self.word_ratios(levels)
        n = np.bincount(owner, minlength=len(texts)) + EVEN
        surplus = np.bincount(owner, np.maximum(r - LEAST, 0), len(texts)) / n
        share = np.bincount(owner, r > 2.5, len(texts)) / n
        return np.log(np.stack([surplus, share], 1) + 0.002)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        z = self.features(texts) @ self.weights[:2] + self.weights[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def count(texts: list[bytes], kind: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per level: keys, in how many texts of each of four kinds each is, the key of the level before, the bucket."""
    levels, owner = expressions(texts)
    parents = [np.zeros(len(owner), np.uint64), *levels[:-1]]
    out = []
    for key, parent in zip(levels, parents, strict=True):
        order = np.lexsort((owner, key))
        k, o = key[order], owner[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o, at = k[new], o[new], order[new]
        keys, first, inv = np.unique(k, return_index=True, return_inverse=True)
        n = np.stack([np.bincount(inv, kind[o] == c, len(keys)) for c in range(4)], 1)
        out.append((keys, n, parent[at[first]], levels[0][at[first]] % np.uint64(BUCKETS)))
    return out


def _log_ratio(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p[:, 1], 1e-12)) - np.log(np.maximum(p[:, 0], 1e-12))


def _rest(size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The share that the discount leaves to missing nodes."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size > 0, DISCOUNT * kinds / size, 1.0)


def fit(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], root: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per level (key, ratio, ratio of what is missing below) of the nodes that features can depend on.

    levels holds (sorted keys, counts of the two classes, parents) and all nodes below each first-level key; root holds
    the first level's sums and numbers of keys over all buckets. A node is needed if a word of a ratio above LEAST ends
    at it or below it, or if missing it would be taken for an unseen word of such a ratio."""
    ups, llrs, totals, misses = [], [], [], []
    for k, (_, n, parent) in enumerate(levels):
        if k == 0:
            up, size, kinds, total = np.zeros(len(n), np.int64), root[:1], root[1:], np.zeros(1)
            weight = np.maximum(1.0, size.sum(axis=1))
        else:
            m, total = len(levels[k - 1][0]), totals[-1]
            up = np.searchsorted(levels[k - 1][0], parent)
            size = np.stack([np.bincount(up, n[:, c], m) for c in (0, 1)], 1)
            kinds = np.stack([np.bincount(up, n[:, c] > 0, m) for c in (0, 1)], 1)
            weight = size.sum(axis=1)
        shared = n.sum(axis=1) / weight[up]
        top = np.maximum(n - DISCOUNT, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(size[up] > 0, (top + DISCOUNT * kinds[up] * shared[:, None]) / size[up], shared[:, None])
        ups.append(up)
        llrs.append(_log_ratio(p))
        misses.append(_log_ratio(_rest(size, kinds)))
        totals.append(total[up] + llrs[-1])
    reach = totals[-1].copy()
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(len(levels) - 1, -1, -1):
        unseen = (totals[k - 1] if k else np.zeros(1)) + misses[k]
        need = (reach > LEAST) | (unseen[ups[k]] > LEAST)
        below = misses[k + 1] if k + 1 < len(levels) else np.zeros(len(need))
        out.append((levels[k][0][need], llrs[k][need], below[need]))
        most = unseen.copy()
        np.maximum.at(most, ups[k], reach)
        reach = most
    return out[::-1]


def _logistic(f: np.ndarray, y: np.ndarray, each: list[float]) -> np.ndarray:
    """Weights of a ridge logistic regression with bias, by Newton's method. A row counts as many times as it stands
    for labelled rows of its class (each), a toxic one twice that."""
    c = np.where(y == 1, 2 * each[1], each[0])
    c = c * len(c) / c.sum()
    x = np.column_stack([f, np.ones(len(f))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + 0.1 * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


#: Columns of counts: ordinary and toxic texts of the first half, then of the second.
_COUNTS = ["n0", "n1", "n2", "n3"]
#: Each model's columns of ordinary and toxic counts: of either half, and of both.
_MODELS = [([0], [1]), ([2], [3]), ([0, 2], [1, 3])]


def _fitted(t: pa.Table, roots: list[np.ndarray]) -> pa.Table:
    """(model, level, key, llr, below) of the needed nodes of a bucket of (level, key, parent, counts) rows."""
    level = t.column("level").to_numpy()
    key, parent = (t.column(c).to_numpy().view(np.uint64) for c in ("key", "parent"))
    n = np.stack([t.column(c).to_numpy() for c in _COUNTS], 1).astype(float)
    out = []
    for m, sides in enumerate(_MODELS):
        own = np.stack([n[:, c].sum(axis=1) for c in sides], 1)
        levels = []
        for k in range(len(PREFIXES) + 1):
            at = np.flatnonzero((level == k) & (own.sum(axis=1) > 0))
            at = at[np.argsort(key[at])]
            levels.append((key[at], own[at], parent[at]))
        for k, (keys, llr, below) in enumerate(fit(levels, roots[m])):
            size = len(keys)
            out.append([np.full(size, m, np.int32), np.full(size, k, np.int32), keys.view(np.int64), llr, below])
    return pa.table({c: np.concatenate(x) for c, x in zip(("model", "level", "key", "llr", "below"), zip(*out), strict=True)})


def _models(counts: DataFrame) -> list[Model]:
    """The models of both halves and of all rows, from (bucket, level, key, parent, counts) rows of distinct keys."""
    sums = [F.sum(sum(F.col(_COUNTS[c]) for c in side)) for sides in _MODELS for side in sides]
    kinds = [F.count(F.when(sum(F.col(_COUNTS[c]) for c in side) > 0, 1)) for sides in _MODELS for side in sides]
    first = counts.where("level = 0").agg(*[c.alias(f"c{i}") for i, c in enumerate(sums + kinds)]).first()
    first = np.array([x or 0 for x in first], float).reshape(2, len(_MODELS), 2)
    roots = [first[:, m] for m in range(len(_MODELS))]
    schema = "model int, level int, key long, llr double, below double"
    found = counts.groupBy("bucket").applyInArrow(lambda t: _fitted(t, roots), schema).toArrow()
    model, level, key, llr, below = (found.column(c).to_numpy() for c in ("model", "level", "key", "llr", "below"))
    out = []
    for m, root in enumerate(roots):
        keys, ratios, misses = [], [], [_log_ratio(_rest(root[:1], root[1:]))]
        for k in range(len(PREFIXES) + 1):
            at = np.flatnonzero((model == m) & (level == k))
            at = at[np.argsort(key[at].view(np.uint64))]
            keys.append(key[at].view(np.uint64))
            ratios.append(llr[at])
            misses.append(below[at])
        out.append(Model(keys, ratios, misses[:-1]))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, level, key, parent, counts) of a stream of (half, toxic, text) rows."""
    for b in batches:
        half, toxic = (b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("half", "toxic"))
        kind = 2 * half + toxic
        at = 0
        for texts in chunked(iter(binary(b, "text")), len):
            part = slice(at, at + len(texts))
            at += len(texts)
            for k, (keys, n, up, bucket) in enumerate(count(texts, kind[part])):
                cols = [bucket.astype(np.int32), np.full(len(keys), k, np.int32), keys.view(np.int64), up.view(np.int64)]
                cols += [n[:, c].astype(np.int64) for c in range(4)]
                yield pa.record_batch([pa.array(x) for x in cols], ["bucket", "level", "key", "parent", *_COUNTS])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Model:
    """Fits the model: counts over all learnable rows, the logistic weights on at most per_class rows of each class."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max("toxic").cast("int").alias("__toxic"))
    )
    there = dict(marked.groupBy("__toxic").count().collect())
    order = [F.xxhash64("__id"), F.col("__id")]
    ids = [r for c in (0, 1) for r in marked.where(F.col("__toxic") == c).orderBy(*order).limit(per_class).collect()]
    nothing = Model([], [], [])
    if len(there) < 2:
        return nothing
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame(ids, "__id long, __toxic int"))  # at most 2 * per_class rows
    half = F.pmod(F.xxhash64("__id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    taken = [half, F.col("__toxic").alias("toxic"), "text"]
    if sum(there.values()) <= BROADCAST_ROWS:  # else a sort-merge join
        marked = F.broadcast(marked)
    every = docs.join(marked, F.col("doc_id") == F.col("__id")).select(*taken)
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    tallies = every.mapInArrow(_tally, "bucket int, level int, key long, parent long, n0 long, n1 long, n2 long, n3 long")
    counts = cut(tallies.groupBy("bucket", "level", "key").agg(F.min("parent").alias("parent"), *sums), "toxicity-counts")
    *pair, model = _models(counts)
    halves = spark.sparkContext.broadcast(pair)
    rows = docs.join(few, F.col("doc_id") == F.col("__id")).select(*taken)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, toxic = (b.column(b.schema.names.index(c)).to_pylist() for c in ("half", "toxic"))
            for part in chunked(zip(own, toxic, binary(b, "text"), strict=True), lambda r: len(r[2]) + 64):
                for h in (0, 1):
                    mine = [r for r in part if r[0] == h]
                    f = halves.value[1 - h].features([t for *_, t in mine])
                    cols = [pa.array([y for _, y, _ in mine], pa.int32()), *(pa.array(f[:, c]) for c in (0, 1))]
                    yield pa.record_batch(cols, ["toxic", "f0", "f1"])

    seen = rows.mapInArrow(cross, "toxic int, f0 double, f1 double").toArrow()
    f = np.stack([seen.column(c).to_numpy() for c in ("f0", "f1")], 1)
    y = seen.column("toxic").to_numpy()
    if len(np.unique(y)) < 2:
        return nothing
    each = [there[c] / min(per_class, there[c]) for c in (0, 1)]
    order = np.lexsort((f[:, 1], f[:, 0], y))  # the same sums for any partitioning
    model.weights = _logistic(f[order], y[order], each)
    return model


def score_toxicity(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; whole texts are scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in id_texts(batches):
            s = shared.value.scores([t for _, t in rows])
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array(s)], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns unchanged. Rows are filtered where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(names.index("text")).cast(pa.binary()).to_pylist()]
            keep = [s < CUT for rows in chunked(iter(texts), len) for s in shared.value.scores(rows)]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
