"""SimHash near-dedup with vantage-point trees.

Fingerprints are partitioned by a vantage-point tree fitted on a sample in proportion to the shards: at each node, fingerprints at Hamming
distance up to the node's threshold from its vantage point go to the near side, the others to the far side. By the
triangle inequality two linked fingerprints on different sides are both within the link radius of the boundary, so the
near-side ones there visit the far side as well; every linked pair then meets in one shard. A shard does the same again
down to small leaves, compares those in full, and emits a spanning star for each component that it finds, never all
pairs. Components of the stars are then joined over all shards.

Defined cases: texts without words have fingerprint zero, which is linked like any other; rows that repeat a doc_id
are rows of their own with the same id; a null doc_id gets its fingerprint's component (null if it is alone).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, id_texts, table
from tessera.llm.components import components

SHINGLE = 3
RADIUS = 2
#: The vantage-point tree over shards is fitted on a sample of about PER_SHARD fingerprints for each shard aimed at (one
#: in SHARD / PER_SHARD of all), and on SAMPLE at least, so that shards keep their size when the data grow.
SAMPLE, PER_SHARD = 4096, 16
#: Aim for so many fingerprints of its own in a shard.
SHARD = 50_000
LEAF = 192
SHARE = 1e-3

_LOWER = bytes(range(256)).translate(
    bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
)
_xxh = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash, unsigned, of a text's word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _xxh(joined)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    slices = (joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True))
    return majority(np.fromiter(map(_xxh, slices), np.uint64, len(starts)))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero if there are none."""
    total = np.zeros(64, np.int64)
    for part in range(0, len(h), 100_000):
        total += np.unpackbits(h[part : part + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int.from_bytes(np.packbits(total * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in id_texts(batches):
            fps = np.array([fingerprint(t, shingle) for _, t in rows], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _distance(fps: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ vantage)


def fit_tree(sample: np.ndarray, depth: int) -> list | None:
    """[vantage, threshold, near, far] or None for a shard; the vantage points are the first of the sample on a side."""
    if depth == 0 or len(sample) < 4:
        return None
    d = _distance(sample, sample[0])
    m = int(np.median(d))
    if m >= d.max():
        m = int(d.max()) - 1
    if m < 0:
        return None
    near = d <= m
    return [sample[0], m, fit_tree(sample[near][::-1], depth - 1), fit_tree(sample[~near][::-1], depth - 1)]


def route(fps: np.ndarray, tree: list | None, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, fingerprints): every fingerprint's own shard and the far sides that it visits."""

    def walk(part: np.ndarray, node: list | None, label: int) -> Iterator[tuple[int, np.ndarray]]:
        if not len(part):
            return
        if node is None:
            yield label, part
            return
        d = _distance(part, node[0])
        yield from walk(part[d <= node[1]], node[2], 2 * label)
        yield from walk(part[d > node[1] - radius], node[3], 2 * label + 1)

    yield from walk(fps, tree, 1)


def _leaf(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars of the components among few fingerprints, from all their distances."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    other = label != np.arange(len(fps))
    yield fps[other], fps[label[other]]


def shard_links(fps: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that span the components of distinct fingerprints, by a vantage-point tree."""
    stack = [fps]
    while stack:
        part = stack.pop()
        if len(part) < 2:
            continue
        if len(part) <= leaf:
            yield from _leaf(part, radius)
            continue
        best = None
        for v in part[:: max(1, len(part) // 5)][:5]:
            d = _distance(part, v)
            for m in {int(np.median(d)), int(np.median(d)) - radius - 1, 0}:
                if 0 <= m < int(d.max()):
                    sizes = int((d <= m).sum()), int((d > m - radius).sum())
                    if best is None or max(sizes) < best[0]:
                        best = max(sizes), d, m
            if best and best[0] < 0.7 * len(part):
                break
        if best is None or best[0] > 0.95 * len(part):
            # A ball that no vantage point parts: each fingerprint against the rest, in rows of bounded size.
            for k in range(0, len(part), leaf):
                near = np.bitwise_count(part[k : k + leaf, None] ^ part[None, :]) <= radius
                i, j = np.nonzero(near)
                yield _star(part[k + i], part[j], np.sort(part))
            continue
        _, d, m = best
        stack += [part[d <= m], part[d > m - radius]]


def _star(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of links among sorted nodes, as links to their smallest node."""
    i, j = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new != (up := new[new])).any():
            new = up
        label = new
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def sample_of(distinct: DataFrame, n: int, size: int) -> np.ndarray:
    """About size of the n fingerprints, those with small remainders of a hash, in the order of the hash."""
    h = F.xxhash64("fp", F.lit("sample"))
    t = distinct.where(F.pmod(h, F.lit(max(1, n))) < size).select("fp", h.alias("h")).toArrow()
    fps, order = (t.column(c).to_numpy() for c in ("fp", "h"))
    return fps.view(np.uint64)[np.argsort(order, kind="stable")]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """distinct (fp) -> (u, v) links that span the components of fingerprints within the radius."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    tree = fit_tree(sample_of(distinct, n, max(SAMPLE, PER_SHARD << depth)), depth) if depth else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, part in route(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), tree, radius):
                yield pa.record_batch(
                    [pa.array(np.full(len(part), label, np.int64)), pa.array(part.view(np.int64))], ["shard", "fp"]
                )

    def link(t: pa.Table) -> pa.Table:
        fps = np.unique(t.column("fp").to_numpy().view(np.uint64))
        found = list(shard_links(fps, radius))
        a = np.concatenate([x for x, _ in found]) if found else fps[:0]
        b = np.concatenate([y for _, y in found]) if found else fps[:0]
        u, v = _star(a, b, fps)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "u long, v long")


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    fps = cut(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    return labelled(fps, lambda distinct: fingerprint_links(distinct, radius))


def labelled(fps: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, fp, component_id) of fps (doc_id, fp): links gives (u, v) links of the distinct fingerprints."""
    counted = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    distinct = cut(counted, "distinct-fingerprints")
    roots = components(links(distinct))
    in_part = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", "n", F.coalesce("root", "fp").alias("root")
    )
    least = in_part.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = cut(in_part.join(least, "root").select("fp", "n", "component_id"), "components")
    # A fingerprint with a share of SHARE or more of the rows would fill a partition; there are at most 1 / SHARE of them.
    total = label.agg(F.sum("n").alias("s")).first()["s"] or 0
    hot = F.col("n") >= max(1.0, total * SHARE)
    few, rest = F.broadcast(label.where(hot).drop("n")), label.where(~hot).drop("n")
    found = fps.join(few, "fp").unionByName(fps.join(few, "fp", "left_anti").join(rest, "fp"))
    return found.select("doc_id", "fp", "component_id")


def fp_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the smallest of its component; of rows that repeat a doc_id all stay or go
    together, rows without a doc_id stay."""
    gone = simhash_components(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")
