"""Edit-aware token counts.

A document's text is cut into leaves at places where the tokenizer's pattern always has a pre-token boundary: before a
single space between two letters. Token counts of the leaves are the bottom row of a segment tree. An edit re-encodes
only the leaves that it touches and the leaf that holds the characters around it on which a boundary depends (one
before, two after); subtree sums above changed leaves are updated. Counts equal those of encoding the edited text whole.

Edits are (start, end, replacement) in code points of the original text. They are applied from the last to the first;
an edit that overlaps one further back, or is out of range, is clipped to what is left.

Defined cases: null and empty texts have no leaves and count 0; null edits and edits with a null start are none, a null
end is the start and a null replacement is empty; rows repeat as in the input, null ids included; an empty table gives no
rows; very long texts are whole trees; of edits that start at one place the shorter comes first. Columns are carried, but
for the text, the edits, stored trees and input columns named like an output column, which are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import prepare, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 512
BEFORE, AFTER = 1, 2
Edit = tuple[int, int, str]


@lru_cache(maxsize=2)
def encoder(path: str):
    """The counting function of a vocabulary of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda s: len(encode(s))


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of the leaves and the text's end."""
    out, n = [0], len(text)
    at = text.find(" ", leaf)
    while at > 0:
        if at + 1 < n and text[at - 1].isalpha() and text[at + 1].isalpha():
            out.append(at)
            at = text.find(" ", at + leaf)
        else:
            at = text.find(" ", at + 1)
    return [*out, n] if n else [0]


class TokenTree:
    """Leaf lengths in code points and a heap-ordered segment tree of token sums."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.text, self.count, self.encoded = text, count, 0
        self._build()

    @classmethod
    def resume(cls, text: str, leaf_chars: list[int], sums: list[int], count: Callable[[str], int]) -> TokenTree:
        """The stored tree of a text: nothing is encoded until edits come."""
        tree = cls.__new__(cls)
        tree.text, tree.count, tree.encoded, tree.sums = text, count, 0, list(sums)
        tree.cap = len(tree.sums) // 2
        tree.ends = list(accumulate(leaf_chars))
        tree.starts = [0, *tree.ends[:-1]] if tree.ends else []
        if (tree.ends[-1] if tree.ends else 0) != len(text):
            raise ValueError("the stored leaves are of another text")
        return tree

    def _build(self) -> None:
        c = cuts(self.text)
        self.starts, self.ends = c[:-1], c[1:]
        self.cap = 1
        while self.cap < len(self.starts):
            self.cap *= 2
        self.sums = [0] * (2 * self.cap)
        for i, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            self.sums[self.cap + i] = self._count(self.text[a:b])
        for k in range(self.cap - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def _count(self, part: str) -> int:
        self.encoded += len(part)
        return self.count(part)

    @property
    def total(self) -> int:
        return self.sums[1]

    def _set(self, i: int, value: int) -> None:
        k = self.cap + i
        self.sums[k] = value
        while k > 1:
            k //= 2
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def _leaf(self, at: int) -> int:
        """The leaf that holds a place of the text before any edit."""
        low, high = 0, len(self.starts) - 1
        while low < high:
            mid = (low + high) // 2
            if self.ends[mid] > at:
                high = mid
            else:
                low = mid + 1
        return low

    def apply(self, edits: list[Edit]) -> None:
        """Applies edits and counts the touched leaves anew; the count of a run of touched leaves goes to its first."""
        n = len(self.text)
        plan, limit = [], n
        for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
            end = min(max(end, start, 0), limit)
            start = min(max(start, 0), end)
            plan.append((start, end, new))
            limit = start
        if not plan:
            return
        if not n:
            self.text = "".join(new for *_, new in reversed(plan))
            self._build()
            return
        plan.reverse()
        groups: list[list] = []  # [first leaf, last leaf, edits]
        for e in plan:
            first, last = self._leaf(max(0, e[0] - AFTER)), self._leaf(min(n - 1, e[1] + BEFORE - 1))
            if groups and first <= groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], last)
                groups[-1][2].append(e)
            else:
                groups.append([first, last, [e]])
        parts, lens, done = [], [b - a for a, b in zip(self.starts, self.ends, strict=True)], 0
        for first, last, es in groups:
            a, b = self.starts[first], self.ends[last]
            pieces, at = [], a
            for start, end, new in es:
                pieces += [self.text[at:start], new]
                at = end
            part = "".join([*pieces, self.text[at:b]])
            parts += [self.text[done:a], part]
            done = b
            self._set(first, self._count(part))
            lens[first] = len(part)
            for i in range(first + 1, last + 1):
                self._set(i, 0)
                lens[i] = 0
        self.text = "".join([*parts, self.text[done:]])
        self.starts, self.ends, at = [], [], 0
        for k in lens:
            self.starts.append(at)
            at += k
            self.ends.append(at)


_DIGITS = re.compile(r"[0-9]{4,}")


def redactions(text: str) -> list[Edit]:
    """The query's edits: each run of four or more digits becomes <num>, and a heading is set before the text."""
    return [(0, 0, "# Document\n"), *((m.start(), m.end(), "<num>") for m in _DIGITS.finditer(text))]


def count_edited(
    docs: DataFrame,
    edits: str | Callable[[str], list[Edit]],
    text: str = "text",
    ranks: str = RANKS,
    trees: bool = False,
    stored: tuple[str, str] | None = None,
) -> DataFrame:
    """docs without the text, and with n_leaves, n_tokens, n_edits, n_tokens_edited and n_chars_reencoded added; with
    trees=True also edited_text, leaf_chars and tree (the segment tree after the edits).

    edits is a column of array<struct<start, end, replacement>>, or a function of the text. stored names the columns of
    leaf_chars and tree of an earlier run, whose edited_text the text is: only what the edits touch is encoded then. A row
    whose stored tree is null is encoded whole. Input columns named like an output column are left out."""
    prepare(docs.sparkSession)
    names = ["n_leaves", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_reencoded"]
    kinds = [pa.int64()] * 5
    added = [f"{c} long" for c in names]
    if trees:
        names += ["edited_text", "leaf_chars", "tree"]
        kinds += [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        added += ["edited_text string", "leaf_chars array<int>", "tree array<int>"]
    drop = {text, *names, *(stored or ())} | ({edits} if isinstance(edits, str) else set())
    kept = [c for c in docs.columns if c not in drop]
    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + added
    columns = docs.columns

    def one(t: str, given, leaves=None, sums=None) -> tuple:
        tree = TokenTree(t, encoder(ranks)) if leaves is None or sums is None else TokenTree.resume(t, leaves, sums, encoder(ranks))
        before, leaves, tree.encoded = tree.total, len(tree.starts), 0
        if callable(edits):
            todo = edits(t)
        else:
            rows = [e for e in given or [] if e is not None and e["start"] is not None]
            todo = [(e["start"], e["start"] if e["end"] is None else e["end"], e["replacement"] or "") for e in rows]
        tree.apply(todo)
        out = leaves, before, len(todo), tree.total, tree.encoded
        if trees:
            out += tree.text, [b - a for a, b in zip(tree.starts, tree.ends, strict=True)], tree.sums
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(columns.index(text)).to_pylist()
            given = [None] * len(texts) if callable(edits) else b.column(columns.index(edits)).to_pylist()
            old = [b.column(columns.index(c)).to_pylist() for c in stored] if stored else [[None] * len(texts)] * 2
            for at in range(0, max(1, len(texts)), 256):
                part = slice(at, at + 256)
                rows = zip(texts[part], given[part], old[0][part], old[1][part], strict=True)
                found = [one(t or "", g, leaves, sums) for t, g, leaves, sums in rows]
                cols = [b.column(columns.index(c)).slice(at, 256) for c in kept]
                cols += [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch(cols, [*kept, *names])

    return docs.mapInArrow(run, ", ".join(schema))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(table(spark, sf_dir, "documents").select("doc_id", "text"), redactions)
