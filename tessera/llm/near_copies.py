"""Near copies: SimHash near-dedup with the settings for whole texts, 5-word shingles and a similarity of 0.8 or more.

A text is the set of its 5-word shingles (ASCII case folded, split at white space), as 64-bit hashes; texts of equal sets
are one node. Vantage-point trees (``simhash_dedup``) link SimHash fingerprints of the sets within RADIUS bits, and the exact
Jaccard similarity of the sets decides on each link. A radius that covers a similarity of 0.8 would prune nothing, so the
links beyond RADIUS are found in an exact way: in an order of shingles that is the same for all texts, two sets of
similarity 0.8 or more share one of the first n // 5 + 1 shingles of each (n being the set's size). An equi-join on those
prefixes finds every pair; set sizes, the places of the shared shingle and bitmaps of the sets' parities rule pairs out
without loss, and the sizes of whole intersections decide.

The order puts shingles last that are frequent in a sample of about SAMPLE_DOCS documents (at most FREQUENT shingles), so
passages that many texts share are no prefix of texts that hold more than them. Any order gives the same result.

A large group of near copies isn't compared in full: links of the trees, and of each node with the one at the centre
of most of its prefix shingles, come first; then only nodes of different components are compared.

Defined cases: a text of up to five words is one shingle; texts without words (null or empty) are equal; rows that repeat a
doc_id stay or go together; rows without a doc_id stay, but link others; an empty table gives no rows; very long texts are
read whole; of equally similar documents the smallest doc_id stays. Other columns, whatever their names, are carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, id_texts, limited, remove
from tessera.llm.components import components
from tessera.llm.decontaminate import shingles
from tessera.llm.simhash_dedup import _LOWER, fingerprint_links, labelled, majority
from tessera.llm.words import Hasher

SHINGLE = 5
#: Bits within which the trees link fingerprints.
RADIUS = 2
SAMPLE_DOCS = 10_000
FREQUENT = 500_000
#: Longs of the bitmap that rules pairs out.
MAPS = 4
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed longs."""
    data = np.frombuffer(b"\n" + b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    firsts = np.cumsum([1] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, firsts)
    word = Hasher(data)(starts, ends)
    h = shingles(word, shingle).view(np.int64)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > shingle:
            out.append(np.unique(h[a : b - shingle + 1]))
        else:
            out.append(shingles(word[a:b], b - a).view(np.int64) if b > a else h[:0])
    return out


def prefixes(sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The first n // 5 + 1 shingles of each set of n: by how frequent they are, then by hash."""
    keys, times = frequent
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token = np.concatenate([*sets, np.zeros(0, np.int64)])
    rank = np.zeros(len(token), np.int64)
    if len(keys) and len(token):
        at = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
        rank = np.where(keys[at] == token, times[at], 0)
    token = token[np.lexsort((token, rank, owner))]
    ends = np.cumsum(size)
    return [token[e - n : e - n + n // 5 + 1] if n else token[:0] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """MAPS longs for each set: bit k is the parity of the number of its shingles that fall on k. Bits that differ between
    two sets are at most as many as shingles that only one of them has."""
    size = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate([*sets, np.zeros(0, np.int64)])
    place = np.repeat(np.arange(len(sets)), size) * 64 * MAPS + (token.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * MAPS)
    odd = np.bincount(place, minlength=len(sets) * 64 * MAPS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(sets), MAPS)


def _ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(s) for s in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in id_texts(batches):
            sets = shingle_sets([t for _, t in rows])
            columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array(_ids(sets)), _lists(sets)]
            yield pa.record_batch(columns, ["doc_id", "node", "set"])

    return _source(docs).mapInArrow(run, "doc_id long, node long, set array<long>")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, rows of the sample with each): at most FREQUENT, those in most rows of the sample."""
    total = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, total // SAMPLE_DOCS))) == 0)
    seen = cut(_sets(sample).select(F.explode("set").alias("token")).groupBy("token").count().where("count > 1"), "near-frequent")
    least = 2
    held = 0
    for r in sorted(seen.groupBy(F.least("count", F.lit(1000)).alias("c")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > FREQUENT:
            least = r["c"] + 1
            break
    t = seen.where(F.col("count") >= least).limit(FREQUENT).toArrow()
    remove(docs.sparkSession, seen._tessera_path)
    keys, times = (t.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(keys)
    return keys[order], times[order]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fp, n, prefix, bitmap): node identifies the set, fp is its fingerprint, n its size."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))  # at most FREQUENT pairs of longs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in id_texts(batches):
            sets = shingle_sets([t for _, t in rows])
            fps = np.array([majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)
            columns = [
                pa.array([i for i, _ in rows], pa.int64()), pa.array(_ids(sets)), pa.array(fps),
                pa.array([len(s) for s in sets], pa.int32()), _lists(prefixes(sets, frequent.value)),
                *(pa.array(np.ascontiguousarray(x)) for x in bitmaps(sets).T),
            ]
            yield pa.record_batch(columns, ["doc_id", "node", "fp", "n", "prefix", *_BITS])

    bits = "".join(f", {c} long" for c in _BITS)
    return _source(docs).mapInArrow(run, f"doc_id long, node long, fp long, n int, prefix array<long>{bits}")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (u, v) of nodes at similarity 0.8 or more: 9 times the common shingles are 4 times both sizes or more.
    Each u's set is sent once to each of its v, each v's set once; reps (node, doc_id) names a row with the set."""
    at = reps.withColumnRenamed("doc_id", "rep")
    routes = cut(pairs.join(at.withColumnRenamed("node", "u"), "u").select("u", "v", "rep"), "near-routes")
    centres = cut(pairs.select("v").distinct().join(at.withColumnRenamed("node", "v"), "v").select("v", "rep"), "near-centres")
    rows = _sets(docs)

    def sets(of: DataFrame, key: str) -> DataFrame:
        return rows.join(limited(of), (rows["node"] == of[key]) & rows["doc_id"].eqNullSafe(of["rep"]))

    right = cut(sets(centres, "v").groupBy("v").agg(F.first("set").alias("sv")), "near-sets")
    left = sets(routes, "u").select("u", "v", F.col("set").alias("su"))
    common = F.size(F.array_intersect("su", "sv"))
    similar = 9 * common >= 4 * (F.size("su") + F.size("sv"))
    links = cut(left.join(right, "v").where(similar).select("u", "v"), name)
    for done in (routes, centres, right):
        remove(docs.sparkSession, done._tessera_path)
    return links


_BITS = [f"b{k}" for k in range(MAPS)]
#: Sets of similarity 0.8 differ in at most a ninth of their sizes' sum; bitmaps don't differ in more.
_LIKE = f"9 * ({' + '.join(f'bit_count(u{b} ^ v{b})' for b in _BITS)}) <= nu + nv"
#: Of a shared shingle's places in two sets: shingles before and after it can be common only as far as both sets have them.
_CAN = "9 * (least(pu, pv) + least(nu - pu, nv - pv)) >= 4 * (nu + nv)"


def _tree_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of nodes (node, fp) whose fingerprints the vantage-point trees link."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    same = nodes.join(first, "fp").where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    a, b = (first.select(F.col("fp").alias(f"f{c}"), F.col("first").alias(c)) for c in ("u", "v"))
    links = fingerprint_links(first, RADIUS).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    return same.union(links.join(a, "fu").join(b, "fv").select("u", "v"))


def near_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, node, fp, n, prefix) of docs -> links (u, v) that span the components of similar nodes."""
    same = [F.first(c).alias(c) for c in ("n", "fp", *_BITS)]
    nodes = cut(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *same), "near-nodes")
    reps = nodes.select("node", "doc_id")
    # One row of each node: the others hold the same set.
    sets = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = sets.select("node", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    shared = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posts = cut(postings.join(shared, "token"), "near-postings")
    # The centre of a shingle's nodes is the one whose shingles the most nodes share: the least edited of near copies.
    weights = posts.groupBy("node").agg(F.sum("df").alias("w"))
    centre = posts.select("token", "node").join(weights, "node").groupBy("token").agg(F.max(F.struct("w", "node")).alias("best"))
    near = posts.join(centre.select("token", F.col("best.node").alias("lo")), "token")
    a = near.where("node != lo").select("token", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("pos").alias("pu"))
    b = near.where("node = lo").select("token", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("pos").alias("pv"))
    seen = a.join(b, "token").where(F.expr(_CAN)).groupBy("u", "v").agg(F.count("*").alias("c"), F.first("nu").alias("n"))
    # The best centre alone, if a quarter of the prefix is shared with it; what that leaves out is compared below.
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("c"), "v"))
    best = seen.where("20 * c >= n").withColumn("place", place).where("place = 1").select("u", "v")
    sides = [
        nodes.select(F.col("node").alias(y), F.col("n").alias(f"n{y}"), *(F.col(c).alias(f"{y}{c}") for c in _BITS)) for y in ("u", "v")
    ]
    stars = best.union(_tree_links(nodes.select("node", "fp"))).distinct()
    stars = cut(stars.join(sides[0], "u").join(sides[1], "v").where(F.expr(_LIKE)).select("u", "v"), "near-stars")
    links = _verified(stars, reps, docs, "near-links")
    known = components(links)
    of = nodes.join(known, "node", "left").select("node", F.coalesce("root", "node").alias("c"), *_BITS)
    part = posts.select("token", "node", "n", "pos").join(of, "node")
    mixed = part.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    part = cut(part.join(mixed, "token"), "near-parts")
    remove(docs.sparkSession, posts._tessera_path)
    names = {"node": "", "n": "n", "pos": "p", "c": "c"}
    a, b = (
        part.select("token", *(F.col(c).alias(f"{x}{y}") for c, x in names.items()), *(F.col(c).alias(f"{y}{c}") for c in _BITS))
        for y in ("u", "v")
    )
    pairs = a.join(b, "token").where((F.col("cu") > F.col("cv")) & F.expr(_CAN) & F.expr(_LIKE))
    # Common shingles up to the end of the shorter-reaching prefix are all counted here, the rest lies behind a prefix.
    full = F.expr("9 * (c + greatest(nu - floor(nu / 5), nv - floor(nv / 5)) - 1) >= 4 * (nu + nv)")
    pairs = pairs.groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("c")).where(full).select("u", "v")
    tested = stars.union(stars.select("v", "u"))
    rest = cut(pairs.join(tested, ["u", "v"], "left_anti"), "near-pairs")
    remove(docs.sparkSession, part._tessera_path)
    return links.union(_verified(rest, reps, docs, "near-links"))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): fp identifies the shingle set; component_id is the smallest doc_id reachable over
    pairs of similarity 0.8 or more, itself included."""
    rows = cut(_rows(docs), "near-rows")
    fps = rows.select("doc_id", F.col("node").alias("fp"))
    return labelled(fps, lambda distinct: near_links(docs, rows))


def keep_one_near(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the smallest of its component of near copies."""
    found = near_components(docs).where(F.col("doc_id") != F.col("component_id"))
    gone = limited(cut(found.select("doc_id").distinct(), "near-gone"))
    return docs.join(gone, "doc_id", "left_anti")
