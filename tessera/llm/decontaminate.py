"""Benchmark decontamination by SimHash windows of the size of the items.

Words are folded (case, punctuation). An item of n words is compared with every window of n words of a document. A
window is screened by the share of its 5-word shingles that any item has: at similarity 0.8 two windows of one size
share 8/9 of their shingles, so the screen loses nothing. Windows that pass get a SimHash fingerprint; tables of the
items' 16-bit blocks find all item fingerprints of that size within RADIUS (one of the four blocks then differs in at most
RADIUS // 4 bits), and exact weighted-shingle similarity (sum of least counts over sum of largest) decides. Shared shingles
bound it from above for all candidates at once; the best bounds of a text and item are evaluated first, until no other can
be better. radius=64 leaves the fingerprints out of it: what passes the screen is verified.

The benchmark's size is checked: up to PART_BYTES of item text are handed to the workers at once. More is done in parts of
that size, one after another, each over all documents, and no part is kept on the driver.

Defined cases: items and texts that are null or without words match nothing; an item of fewer than five words is one
shingle and matches equal windows; rows that repeat a doc_id or an item_id give a row each; null ids are carried; of equally
similar windows the first counts; without documents or items there are no rows; very long texts are read whole, in blocks
of bounded size. Other columns, whatever their names, are ignored by find_leaks and carried by keep_uncontaminated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import binary, chunked, cut, id_texts, prepare, table
from tessera.llm.words import Hasher, mix, words

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 22
BLOCKS = 4
PART_BYTES = 16_000_000
#: Entries of the arrays that candidates are found and verified in.
CELLS = 2_000_000


def shingles(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; entry i starts at word i."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    return mix(out)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(majority: np.ndarray) -> np.ndarray:
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()


def numbered(rows: np.ndarray) -> np.ndarray:
    """Rows of shingles as sorted keys of (shingle, how often it came before in the row), so that common keys count as many
    times as both rows have a shingle."""
    rows = np.sort(rows, axis=1)
    place = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    before = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return np.sort(mix(rows + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the sum of least counts of two arrays of numbered shingles."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(axis=1)


class Blocks:
    """Fingerprints by the values of their BLOCKS blocks of bits."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.tables = fps, []
        for part in self._split(fps):
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.tables.append((values, np.append(first, len(part)), order))

    @staticmethod
    def _split(fps: np.ndarray) -> list[np.ndarray]:
        step = 64 // BLOCKS
        return [(fps >> np.uint64(k * step)) & np.uint64((1 << step) - 1) for k in range(BLOCKS)]

    def within(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index in fps, index in the tables) of all pairs of fingerprints within the radius."""
        n, out = len(self.fps), []
        rows = max(1, CELLS // max(1, n))
        for at in range(0, len(fps), rows):
            some = fps[at : at + rows]
            hit = np.zeros(len(some) * n, bool)
            for part, (values, first, order) in zip(self._split(some), self.tables, strict=True):
                i, k = np.nonzero(np.bitwise_count(part[:, None] ^ values[None, :]) <= radius // BLOCKS)
                size = first[k + 1] - first[k]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                hit[np.repeat(i, size) * n + order[np.repeat(first[k], size) + inside]] = True
            i, j = np.divmod(np.flatnonzero(hit), n)
            near = np.bitwise_count(some[i] ^ self.fps[j]) <= radius
            out.append((at + i[near], j[near]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


class ItemIndex:
    """Items by their number of words: ids, tables of fingerprints, and each item's shingles."""

    def __init__(self, ids: list, texts: list[bytes], radius: int = RADIUS):
        self.radius = radius
        by: dict[int, list] = {}
        data, s, e, owner = words(texts)
        word = Hasher(data)(s, e)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                by.setdefault(int(b - a), []).append((ids[i], shingles(word[a:b], min(SHINGLE, int(b - a)))))
        self.groups = {}
        for n, items in sorted(by.items()):
            fps = np.concatenate([_pack((_bits(h).sum(0) * 2 > len(h))[None, :]) for _, h in items])
            self.groups[n] = ([i for i, _ in items], Blocks(fps), np.stack([h for _, h in items]))
        full = [hs.ravel() for n, (_, _, hs) in self.groups.items() if n >= SHINGLE]
        self.known = np.unique(np.concatenate(full)) if full else np.zeros(0, np.uint64)
        # Of each size: by number of a known shingle, the items that hold it.
        self.holders = {}
        for n, (_, _, hs) in self.groups.items():
            if n >= SHINGLE:
                number = np.searchsorted(self.known, hs)
                item = np.broadcast_to(np.arange(len(hs))[:, None], hs.shape)
                pair = np.unique(number.ravel() * len(hs) + item.ravel())
                self.holders[n] = (np.searchsorted(pair // len(hs), np.arange(len(self.known) + 1)), pair % len(hs))

    def near(self, fps: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of a fingerprint, index of an item of n words) of all pairs within the radius."""
        if self.radius >= 64:
            i, j = np.divmod(np.arange(len(fps) * len(self.groups[n][0])), len(self.groups[n][0]))
            return i, j
        return self.groups[n][1].within(fps, self.radius)

    def _shared(self, n: int, number: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For candidates (window starts[i], item j of n words): how many places of the window hold a shingle of the item.
        number: of each place of the text's block, the number of its shingle among the known ones, or -1."""
        first, items = self.holders[n]
        m, out = n - SHINGLE + 1, np.zeros(len(i), np.int64)
        for item_at in range(0, len(self.groups[n][0]), width := max(1, CELLS // (len(number) + 1))):
            mine = np.flatnonzero((j >= item_at) & (j < item_at + width))
            if not len(mine):
                continue
            held = np.zeros((len(number) + 1, min(width, len(self.groups[n][0]) - item_at)), np.int32)
            place = np.flatnonzero(number >= 0)
            size = first[number[place] + 1] - first[number[place]]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            item = items[np.repeat(first[number[place]], size) + inside] - item_at
            row = np.repeat(place, size)
            ok = (item >= 0) & (item < held.shape[1])
            held[row[ok] + 1, item[ok]] = 1
            sums = np.cumsum(held, axis=0, dtype=np.int32)
            a = starts[i[mine]]
            out[mine] = sums[a + m, j[mine] - item_at] - sums[a, j[mine] - item_at]
        return out

    def _best(self, n: int, h: np.ndarray, text: np.ndarray, start: np.ndarray, j: np.ndarray, shared: np.ndarray, best: dict) -> None:
        """Evaluates candidates (text, window start, item) in the order of their bounds, until none can be better."""
        m = n - SHINGLE + 1
        need = math.ceil(m * 2 * SIMILAR / (1 + SIMILAR) - 1e-9)
        keep = shared >= need
        text, start, j, shared = (x[keep] for x in (text, start, j, shared))
        order = np.lexsort((start, -shared, j, text))
        text, start, j, shared = (x[order] for x in (text, start, j, shared))
        while len(text):
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (j[1:] != j[:-1])
            lead = np.flatnonzero(new)
            for at in range(0, len(lead), step := max(1, CELLS // (2 * m))):
                some = lead[at : at + step]
                windows = numbered(h[start[some][:, None] + np.arange(m)])
                both = common(windows, numbered(self.groups[n][2][j[some]]))
                for x, c in zip(some.tolist(), both.tolist(), strict=True):
                    key, sim = (int(text[x]), n, int(j[x])), c / (2 * m - c)
                    old = best.get(key, (0.0, 0))
                    if sim >= SIMILAR and (sim > old[0] or sim == old[0] and int(start[x]) < old[1]):
                        best[key] = (sim, int(start[x]))
            group = np.cumsum(new) - 1
            top = np.array([best.get((int(text[x]), n, int(j[x])), (0.0, 0))[0] for x in lead])
            left = ~new & (shared / (2 * m - shared) >= top[group])
            # A window as good as the best one counts only if it comes before it.
            tie = np.array([best.get((int(text[x]), n, int(j[x])), (0.0, 1 << 62))[1] for x in lead])
            left &= (shared / (2 * m - shared) > top[group]) | (start < tie[group])
            text, start, j, shared = (x[left] for x in (text, start, j, shared))

    def matches(self, texts: list[bytes]) -> list[tuple[int, object, float, int, int]]:
        """(index of the text, item id, similarity, first word of the window, words) of the best window of each pair."""
        data, s, e, owner = words(texts)
        word = Hasher(data)(s, e)
        first = np.searchsorted(owner, np.arange(len(texts)))
        best: dict[tuple[int, int, int], tuple[float, int]] = {}
        for n in (n for n in self.groups if n < SHINGLE):
            h = shingles(word, n)
            for j, item in enumerate(self.groups[n][2]):
                for a in np.flatnonzero(h == item[0]):
                    if owner[a] == owner[a + n - 1]:
                        best.setdefault((int(owner[a]), n, j), (1.0, int(a)))
        h = shingles(word, SHINGLE)
        if len(h) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = (self.known[at] == h) & (owner[: len(h)] == owner[SHINGLE - 1 :])
            if hit.any():
                self._windows(h, hit, np.where(hit, at, -1), owner, best)
        return [
            (t, self.groups[n][0][j], sim, int(a - first[t]), n) for (t, n, j), (sim, a) in sorted(best.items())
        ]

    def _windows(self, h: np.ndarray, hit: np.ndarray, number: np.ndarray, owner: np.ndarray, best: dict) -> None:
        sums = np.concatenate([[0], np.cumsum(hit)])
        sizes = [n for n in self.groups if n >= SHINGLE]
        reach = max(sizes) // 9 + 1
        zone = np.zeros(len(h) + 1, np.int64)
        where = np.flatnonzero(hit)
        np.add.at(zone, np.maximum(where - reach, 0), 1)
        np.add.at(zone, np.minimum(where + reach + 1, len(h)), -1)
        places = np.flatnonzero(np.cumsum(zone[:-1]) > 0)
        index = np.full(len(h), -1, np.int64)
        index[places] = np.arange(len(places))
        done = 0
        while done < len(places):  # bit sums of a bounded number of places at once
            end = min(len(places), done + 100_000)
            while end < len(places) and places[end] == places[end - 1] + 1:
                end += 1
            part = places[done:end]
            bits = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(h[part]), axis=0, dtype=np.int32)])
            for n in sizes:
                m = n - SHINGLE + 1
                s = part[part + m <= len(h)]
                s = s[sums[s + m] - sums[s] >= math.ceil(m * 2 * SIMILAR / (1 + SIMILAR) - 1e-9)]
                s = s[owner[s] == owner[s + n - 1]]
                if len(s):
                    z = index[s] - done
                    fps = _pack((bits[z + m] - bits[z]) * 2 > m)
                    for w in range(0, len(s), rows := max(1, CELLS // len(self.groups[n][0]))):
                        i, j = self.near(fps[w : w + rows], n)
                        if len(i):
                            low, high = int(s[w]), int(s[min(len(s), w + rows) - 1]) + m
                            own = s[w : w + rows]
                            shared = self._shared(n, number[low:high], own - low, i, j)
                            self._best(n, h, owner[own[i]], own[i], j, shared, best)
            done = end


def indexes(benchmark: DataFrame, item_id: str, text: str, radius: int) -> tuple[int, Iterator[ItemIndex]]:
    """The number of parts of bounded size that the benchmark has, and their indexes, one at a time."""
    b = benchmark.select(F.col(item_id).alias("i"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    size = b.agg(F.sum(F.octet_length("t") + F.lit(64)).alias("s")).first()["s"] or 0
    parts = math.ceil(size / PART_BYTES)

    def each() -> Iterator[ItemIndex]:
        for p in range(parts):
            rows = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()
            rows = sorted(rows, key=lambda r: (r["i"] is None, r["i"], r["t"]))
            yield ItemIndex([r["i"] for r in rows], [bytes(r["t"]) for r in rows], radius)

    return parts, each()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each pair at similarity 0.8 or more.

    Lazy if the benchmark is of one part; else each part's rows are written to the shared folder."""
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    parts, each = indexes(benchmark, item_id, text, radius)
    for index in each:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows in id_texts(batches):
                found = shared.value.matches([t for _, t in rows])
                cols = [[rows[t][0] for t, *_ in found], *([f[k] for f in found] for k in range(1, 5))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        part = source.mapInArrow(run, schema)
        if parts > 1:
            part = cut(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs in which no item is found, all columns unchanged."""
    prepare(docs.sparkSession)
    parts, each = indexes(benchmark, "item_id", "text", radius)
    for index in each:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                at = 0
                for texts in chunked(iter(binary(b, "text")), len):
                    for t, *_ in shared.value.matches(texts):
                        keep[at + t] = False
                    at += len(texts)
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if parts > 1:
            docs = cut(docs, "uncontaminated")
            shared.destroy()
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
