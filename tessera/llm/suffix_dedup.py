"""Suffix-array dedup of repeated byte strings by prefix-free parsing.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or the same document and an
earlier start). The steps, all over the whole corpus:

1. Documents are dealt into groups by doc_id. Each group parses its texts into phrases at rolling-hash triggers and
   sends the hashes of its distinct phrases to dictionary buckets.
2. A dictionary bucket tells each group which of its phrases the corpus has more than once, as bits.
3. A window of LENGTH bytes can only be repeated if all phrases within it are. The group cuts the windows left over into
   pieces that share their least hash of 32 bytes (their key), keeps one of its equal pieces (later ones are repeats),
   and sends the others to the bucket of their key. Equal windows have equal keys and so meet in one bucket.
4. A bucket merges equal pieces, and sorts the suffixes of the distinct ones by prefix-free parsing: suffix order of the
   dictionary and of the parse combine into corpus order. Neighbours with LENGTH equal bytes are one class, of which the
   earliest stays. The runs of repeated windows go back to their groups.
5. The group removes what the returned runs cover.

Hashes only select and route; which bytes go is decided by comparing bytes. A bucket's or group's size follows from
the numbers of groups and buckets, which grow with the corpus; equal pieces are merged before they are sent, so copies
of a text cost one piece for each group.

Defined cases: null is the empty text. Rows that repeat a doc_id are documents of their own in the order of their texts;
rows without a doc_id come after all others. Texts shorter than LENGTH bytes stay whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunked, table
from tessera.llm.pfp import corpus_order, equal_neighbours, inner_phrases, rolling

LENGTH = 100
GROUP_BYTES = 8_000_000
DICTIONARY_BYTES = 16_000_000
BUCKET_BYTES = 2_000_000
#: Arrays over so many bytes of text stay in a core's cache.
PART_BYTES = 500_000
#: A piece has at most so many windows.
PIECE = 2048
_KEY_DOUBLINGS = 5
_C = np.uint64(0xD6E8FEB86659FD93)
LAST = 2**63 - 1


class Group:
    """The documents of one group in corpus order."""

    def __init__(self, t: pa.Table, parse: bool = True):
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = t.column("doc_id").to_pylist()
        self.texts = [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
        self.dups, run = [], 0
        for k, i in enumerate(self.ids):
            run = run + 1 if k and i == self.ids[k - 1] else 0
            self.dups.append(run)

        self.chunks, at = [], 0  # (first document, bytes, offsets, phrases) of parts of bounded size
        for texts in chunked(iter(self.texts), len, PART_BYTES) if parse else ():
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            data = np.frombuffer(b"".join(texts), np.uint8)
            self.chunks.append((at, data, offsets, inner_phrases(data, offsets)))
            at += len(texts)

    def dictionary(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, bucket, more than once here) of the distinct phrases, by bucket, then hash."""
        hs = [h for *_, (_, _, h) in self.chunks]
        keys, n = np.unique(np.concatenate(hs) if hs else np.zeros(0, np.uint64), return_counts=True)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return keys[order], bucket[order], n[order] > 1

    def pieces(self, repeated: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
        """(document, start, bytes, key) of the pieces of windows that can be repeated; repeated: sorted hashes."""
        for at, data, offsets, (s, e, h) in self.chunks:
            n = len(data)
            first, end = offsets[:-1], offsets[1:]
            long = end - first >= LENGTH
            if not long.any():
                continue
            steps = np.bincount(first[long], minlength=n + 1) - np.bincount(end[long] - LENGTH + 1, minlength=n + 1)
            if len(repeated):
                there = repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h
            else:
                there = np.zeros(len(h), bool)
            once = ~there & (e - s <= LENGTH)
            low, high = np.maximum(e[once] - LENGTH, 0), s[once] + 1
            stop = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))
            live = (np.cumsum(steps) > 0) & (stop <= 0)
            places = np.flatnonzero(live)
            if not len(places):
                continue
            apart = np.ones(len(places), bool)
            apart[1:] = places[1:] != places[:-1] + 1
            key = _keys(data, places, apart)
            new = apart
            new[1:] |= key[1:] != key[:-1]
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(places)]])
            more = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(head, tail, strict=True) if b - a > PIECE] or [head[:0]])
            head = np.union1d(head, more).astype(np.int64)
            tail = np.concatenate([head[1:], [len(places)]]) - 1
            a, b = places[head], places[tail] + LENGTH
            owner = np.searchsorted(offsets, a, side="right") - 1
            raw = data.tobytes()
            for d, x, y, v in zip(owner.tolist(), a.tolist(), b.tolist(), key[head].tolist(), strict=True):
                o = int(offsets[d])
                yield at + d, x - o, raw[x:y], v


def _keys(data: np.ndarray, places: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The keys of the windows at places; apart marks the first of each run of neighbours. Only the runs are hashed."""
    head = np.flatnonzero(apart)
    size = np.diff(np.append(head, len(places))) + LENGTH - 1
    shift = np.cumsum(size) - size
    total = int(size.sum())
    step = np.ones(total, np.int64)
    step[0] = places[0]
    step[shift[1:]] = places[head[1:]] - (places[head[:-1]] + size[:-1] - 1)
    part = data[np.cumsum(step)]
    at = np.arange(len(places)) + np.repeat((LENGTH - 1) * np.arange(len(head)), np.diff(np.append(head, len(places))))
    return _least(rolling(part, _KEY_DOUBLINGS) * _C, LENGTH - 2**_KEY_DOUBLINGS + 1)[at]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    step = 1
    out = h
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if width > step:
        out = np.minimum(out[: len(h) - width + 1], out[width - step :][: len(h) - width + 1])
    return out


def _pack5(h: np.ndarray) -> bytes:
    return (h >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def phrase_rows(t: pa.Table, buckets: int) -> pa.Table:
    """Step 1: (b, k, hashes, multi) for each dictionary bucket that the group has phrases for."""
    k = t.column("k")[0].as_py() if t.num_rows else 0
    keys, bucket, multi = Group(t).dictionary(buckets)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(b, x, y) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
    return pa.table(
        {
            "b": pa.array([b for b, *_ in rows], pa.int32()),
            "k": pa.array([k] * len(rows), pa.int32()),
            "hashes": pa.array([_pack5(keys[x:y]) for _, x, y in rows], pa.binary()),
            "multi": pa.array([np.packbits(multi[x:y]).tobytes() for _, x, y in rows], pa.binary()),
        }
    )


def repeat_bits(t: pa.Table) -> pa.Table:
    """Step 2: (k, b, bits): which of each group's phrases in this bucket the corpus has more than once."""
    hs = [_unpack5(x) for x in t.column("hashes").to_pylist()]
    multi = [
        np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)) for h, m in zip(hs, t.column("multi").to_pylist(), strict=True)
    ]
    _, inv, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
    again = (n > 1) | (np.bincount(inv, np.concatenate(multi), len(n)) > 0)
    cuts = np.cumsum([len(h) for h in hs])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(again[inv], cuts)]
    return pa.table({"k": t.column("k"), "b": t.column("b"), "bits": pa.array(bits, pa.binary())})


def _repeated(group: Group, bits: dict[int, bytes], buckets: int) -> np.ndarray:
    """The sorted hashes of a group's repeated phrases."""
    keys, bucket, _ = group.dictionary(buckets)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    keep = [np.zeros(0, bool)] + [
        np.unpackbits(np.frombuffer(bits[b], np.uint8), count=y - x).astype(bool)
        for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))
        if y > x
    ]
    return np.sort(keys[np.concatenate(keep)])


def _own_pieces(group: Group, repeated: np.ndarray, buckets: int) -> tuple[dict[int, list], list]:
    """Distinct pieces by bucket, and the repeats among them, as (document, start, bytes)."""
    seen: set[bytes] = set()
    by: dict[int, list] = {}
    repeats = []
    for d, a, raw, key in group.pieces(repeated):
        if raw in seen:
            repeats.append((d, a, raw))
        else:
            seen.add(raw)
            by.setdefault((key >> 20) % buckets, []).append((d, a, raw))
    return by, repeats


def piece_rows(texts: pa.Table, bits: pa.Table, buckets: int, dictionary: int) -> pa.Table:
    """Step 3: (p, k, own, ids, dups, docs, starts, lens, raw) for each bucket that the group has pieces for. The row
    with own=True lists the group's repeats of its own pieces; its bucket only hands them on."""
    k = texts.column("k")[0].as_py() if texts.num_rows else 0
    group = Group(texts)
    known = dict(zip(bits.column("b").to_pylist(), bits.column("bits").to_pylist(), strict=True))
    by, repeats = _own_pieces(group, _repeated(group, known, dictionary), buckets)
    ps = sorted(by)
    lists = [by[p] for p in ps] + [repeats] * bool(repeats)
    of = lambda f, kind: pa.array([np.array([f(x) for x in xs], kind).tobytes() for xs in lists], pa.binary())
    return pa.table(
        {
            "p": pa.array(ps + [k % buckets] * bool(repeats), pa.int32()),
            "k": pa.array([k] * len(lists), pa.int32()),
            "own": pa.array([False] * len(ps) + [True] * bool(repeats), pa.bool_()),
            "ids": of(lambda x: LAST if group.ids[x[0]] is None else group.ids[x[0]], np.int64),
            "dups": of(lambda x: group.dups[x[0]], np.int32),
            "docs": of(lambda x: x[0], np.int32),
            "starts": of(lambda x: x[1], np.int64),
            "lens": of(lambda x: len(x[2]), np.int32),
            "raw": pa.array([b"".join(x[2] for x in xs) for xs in lists[: len(ps)]] + [b""] * bool(repeats), pa.binary()),
        }
    )


def _runs(gone: np.ndarray, piece: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last offset) of the maximal runs of windows that go; windows are in order of piece and offset."""
    g = np.flatnonzero(gone)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1] + 1) | (piece[g[1:]] != piece[g[:-1]])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(g)]]) - 1 if len(g) else head
    return piece[g[head]], offset[g[head]], offset[g[tail]]


def repeated_windows(pieces: list[bytes], order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (piece, first, last offset) of the windows of distinct pieces that also start earlier: in a document of
    lower order, or in the same one at a lower place; a piece starts at its place ``starts``."""
    data = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    lens = np.array([len(x) for x in pieces], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    windows = lens - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = offsets[piece] + offset
    by = corpus_order(data[:-8], offsets, places)
    fresh = ~equal_neighbours(data, places[by], LENGTH)
    # Earliest of each class: documents and places as one number (a bucket has fewer than 2^23 documents).
    when = ((order[piece] << 40) | (starts[piece] + offset))[by]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(by)))
    gone = np.zeros(len(piece), bool)
    gone[by] = when != np.repeat(np.minimum.reduceat(when, first), size)
    return _runs(gone, piece, offset)


def bucket_rows(t: pa.Table) -> pa.Table:
    """Step 4: (k, docs, starts, ends): what goes from each group's documents, as far as this bucket knows."""
    rows, out = [], []
    for r in sorted(t.to_pylist(), key=lambda r: r["k"]):
        if not r["own"]:
            rows.append(r)
        else:
            starts = np.frombuffer(r["starts"], np.int64)
            out.append((r["k"], r["docs"], starts.tobytes(), (starts + np.frombuffer(r["lens"], np.int32)).tobytes()))
    if rows:
        arr = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        lens, ids = arr("lens", np.int32), arr("ids", np.int64)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in ids])
        ids, dups, docs, starts = (
            np.concatenate(x) for x in (ids, arr("dups", np.int32), arr("docs", np.int32), arr("starts", np.int64))
        )
        contents: list[bytes] = []
        for r, ls in zip(rows, lens, strict=True):
            ends = np.cumsum(ls)
            contents += [r["raw"][a:b] for a, b in zip((ends - ls).tolist(), ends.tolist(), strict=True)]
        owner: set[bytes] = set()
        distinct, copies = [], []
        for x in np.lexsort((starts, dups, ids)).tolist():
            (copies if contents[x] in owner else distinct).append(x)
            owner.add(contents[x])
        d, c = np.array(distinct), np.array(copies, np.int64)
        # Distinct pieces are in corpus order of their starts already; documents get dense ranks.
        fresh = np.ones(len(d), np.int64)
        fresh[1:] = (ids[d[1:]] != ids[d[:-1]]) | (dups[d[1:]] != dups[d[:-1]])
        which, first, last = repeated_windows([contents[x] for x in distinct], np.cumsum(fresh), starts[d])
        which = np.concatenate([d[which], c])
        first = np.concatenate([first, np.zeros(len(c), np.int64)])
        last = np.concatenate([last, np.array([len(contents[x]) - LENGTH for x in copies], np.int64)])
        by = np.argsort(row[which], kind="stable")
        which, first, last = which[by], first[by], last[by]
        edges = np.searchsorted(row[which], np.arange(len(rows) + 1))
        for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                w = which[a:b]
                begin, end = starts[w] + first[a:b], starts[w] + last[a:b] + LENGTH
                out.append((rows[r]["k"], docs[w].tobytes(), begin.tobytes(), end.tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], ["k", "docs", "starts", "ends"])


def cleaned(texts: pa.Table, back: pa.Table, full: bool) -> pa.Table:
    """Step 5: what is left of the group's documents."""
    group = Group(texts, parse=False)
    d, a, b = (
        np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in back.column(c).to_pylist())])
        for c, kind in (("docs", np.int32), ("starts", np.int64), ("ends", np.int64))
    )
    order = np.lexsort((a, d))
    spans: dict[int, list] = {}
    for k, start, end in zip(d[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        held = spans.setdefault(k, [])
        if held and start <= held[-1][1]:
            held[-1][1] = max(held[-1][1], end)
        else:
            held.append([start, end])
    out: list[list] = [[] for _ in range(6)]
    for k, text in enumerate(group.texts):
        mine = spans.get(k, [])
        kept, at = [], 0
        for start, end in mine:
            kept.append(text[at:start])
            at = end
        left = b"".join([*kept, text[at:]])
        row = (group.ids[k], len(text), len(text) - len(left), len(mine), hashlib.sha256(left).hexdigest(), left)
        for c, v in zip(out, row, strict=True):
            c.append(v)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    wide = 6 if full else 5
    return pa.table([pa.array(c, k) for c, k in zip(out[:wide], kinds, strict=False)], names[:wide])


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", full: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, with full=True, kept: the remaining bytes."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    groups, dictionary, buckets = (max(1, math.ceil(total / x)) for x in (GROUP_BYTES, DICTIONARY_BYTES, BUCKET_BYTES))
    dealt = source.withColumn("k", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    phrases = dealt.groupBy("k").applyInArrow(
        lambda t: phrase_rows(t, dictionary), "b int, k int, hashes binary, multi binary"
    )
    bits = phrases.groupBy("b").applyInArrow(repeat_bits, "k int, b int, bits binary")
    pieces = dealt.groupBy("k").cogroup(bits.groupBy("k")).applyInArrow(
        lambda t, b: piece_rows(t, b, buckets, dictionary),
        "p int, k int, own boolean, ids binary, dups binary, docs binary, starts binary, lens binary, raw binary",
    )
    runs = pieces.groupBy("p").applyInArrow(bucket_rows, "k int, docs binary, starts binary, ends binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full
    return dealt.groupBy("k").cogroup(runs.groupBy("k")).applyInArrow(lambda t, b: cleaned(t, b, full), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), full=False)


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT rid, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM d),
k AS (SELECT rid, doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS k FROM g),
w AS (SELECT rid, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
x AS (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh
      FROM w WHERE n > 1),
y AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS island FROM x),
spans AS (SELECT rid, min(s) AS a, max(s) + 100 AS b FROM y GROUP BY rid, island),
parts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM spans),
kept AS (SELECT d.rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
                string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS left_hex
         FROM parts JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_hex, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
