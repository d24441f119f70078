"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is read here: pieces with scores and types, the algorithm, byte fallback, and the normaliser.
From it a tokenizers pipeline is rebuilt: normaliser, metaspace marker, unigram scores or the merges that BPE scores
imply, byte fallback, and the decoder. Texts are encoded in batches, by ``threads`` threads. Ids are always those of the
rebuilt pipeline. Unless ``verify`` is off, the sentencepiece library encodes each text too, at some two fifths of the whole
cost, and ``parity`` tells whether its ids are the same.

Defined cases: null and empty texts have no ids and decode to the empty text; very long texts are one encoding; repeated
rows and null ids are rows like others; an empty table gives no rows. Input columns named like an output column are left
out, all others are carried.
"""

from __future__ import annotations

import os
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import chunked, prepare, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
HIDDEN = "\U0010ffff"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BATCH_BYTES = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, other kinds as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """What encoding needs of a SentencePiece model: pieces [(text, score, type)], bpe, byte_fallback, and the
    normaliser's charsmap, dummy_prefix and squeeze (remove_extra_whitespaces)."""
    out = {"pieces": [], "bpe": False, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True}
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            out["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            out["bpe"] = spec.get(3, 1) == 2
            out["byte_fallback"] = bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1))}
    return out


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score of the joined piece first."""
    known = {p for p, _, kind in pieces if kind in (NORMAL, USER)}
    found = []
    for number, (p, score, kind) in enumerate(pieces):
        if kind == NORMAL:
            for k in range(1, len(p)):
                if p[:k] in known and p[k:] in known:
                    found.append((-score, number, k, p[:k], p[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: dict, normalise: bool = True):
    """A tokenizers.Tokenizer equal to the model; normalise=False takes texts that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
    if model["bpe"]:
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(pieces)}, merges=merges_of(pieces), unk_token=pieces[unknown][0],
            fuse_unk=True, byte_fallback=model["byte_fallback"],
        )
    else:
        # Pieces that no text matches get a name that no text has; bytes keep theirs, for the fallback, at a low score.
        low = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - 1000
        named = [
            (p, s) if kind in (NORMAL, USER) else (p, low) if kind == BYTE else (f"{HIDDEN}{i}", low)
            for i, (p, s, kind) in enumerate(pieces)
        ]
        core = models.Unigram(named, unknown, model["byte_fallback"])
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model["dummy_prefix"] else []
    steps.append(normalizers.Replace(" ", MARK))
    if normalise:
        out.normalizer = normalizers.Sequence(steps)
    parts = [decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " ")]
    out.decoder = decoders.Sequence(parts + ([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []))
    return out


def short_decoder(model: dict):
    """(decoder, finish): tokens are joined by the decoder without its last steps, which finish does with str.replace at a
    fraction of their cost; the same text as build's decoder."""
    from tokenizers import decoders

    def finish(joined: str) -> str:
        out = joined.replace(MARK, " ")
        return out[1:] if model["dummy_prefix"] and out.startswith(" ") else out

    return decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()]), finish


def little(ids: list[int]) -> bytes:
    """Ids as 32-bit little-endian numbers."""
    out = array("i", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def _loaded(path: str, threads: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    model = parse_model(data)
    # Where the normaliser only sets markers, str.replace does that at a fraction of the pipeline's cost.
    marks_only = model["dummy_prefix"] and not model["charsmap"] and not model["squeeze"]
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)
    fast = build(model, normalise=not marks_only)
    fast.decoder, finish = short_decoder(model)
    return fast, plain, marks_only, finish


def encode_documents(
    docs: DataFrame, text: str = "text", model: str = MODEL, threads: int | None = None, ids: bool = True, verify: bool = True
) -> DataFrame:
    """docs with ids (array of int), n_tokens, decoded, round_trip (decoded equals the text) and parity (null unless
    verify) added.

    model is a path that all executors can open, or a file that was handed out with addFile. threads is the number
    of CPUs that a task is given (spark.task.cpus) unless stated; more of them slow the other tasks of an executor.
    ids=False leaves the arrays and texts out and gives ids_sha256 (of the ids as 32-bit little-endian numbers)."""
    import hashlib

    prepare(docs.sparkSession)
    threads = threads or int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))
    extra = ["ids", "n_tokens", "decoded"] if ids else ["n_tokens", "ids_sha256"]
    kinds = "ids array<int>, n_tokens long, decoded string" if ids else "n_tokens long, ids_sha256 string"
    kept = [k for k, c in enumerate(docs.columns) if c not in (*extra, "round_trip", "parity")]
    at = docs.columns.index(text)
    fields = [docs.schema.fields[k] for k in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [kinds, "round_trip boolean, parity boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model if os.path.exists(model) else SparkFiles.get(os.path.basename(model))
        fast, plain, marks_only, finish = _loaded(path, threads)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            start = 0
            for rows in chunked(iter(texts), len, BATCH_BYTES):
                ready = [MARK + t.replace(" ", MARK) if t else t for t in rows] if marks_only else rows
                encoded = fast.encode_batch_fast(ready, add_special_tokens=False)
                out = [e.ids for e in encoded]
                same = [plain.encode(t) == x for t, x in zip(rows, out, strict=True)] if verify else [None] * len(rows)
                decoded = [finish(fast.decode(x, skip_special_tokens=False)) for x in out]
                cols = [b.column(c).slice(start, len(rows)) for c in kept]
                n = pa.array([len(x) for x in out], pa.int64())
                if ids:
                    cols += [pa.array(out, pa.list_(pa.int32())), n, pa.array(decoded)]
                else:
                    digest = [hashlib.sha256(little(x)).hexdigest() for x in out]
                    cols += [n, pa.array(digest)]
                cols += [pa.array([t == d for t, d in zip(rows, decoded, strict=True)]), pa.array(same, pa.bool_())]
                start += len(rows)
                yield pa.record_batch(cols, [*(b.schema.names[c] for c in kept), *extra, "round_trip", "parity"])

    return docs.mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, ids=False).drop("text")
