"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base patterns (email, ip, card, phone) are matched in linear time and always stay. The field scores whole candidate
segments (digit grouping, checksums, separators, cue words around them) and decodes the best sequence of entities and
other tokens by dynamic programming, so that boundaries and kinds are chosen jointly. An entity has at most MAX_TOKENS
tokens, so decoding is linear in the text. It is trained on generated sentences. Segments that touch a base span are no
candidates.

Tokens that no candidate segment can cover are other tokens in every sequence, so only windows around the places that a
candidate must hold are cut into tokens: ``@`` or the word ``at`` for an email, a run of digits and separators with four
digits or more for the other kinds. Windows reach as far as any candidate and its cue words, so the result is that of
decoding the whole text.

Defined cases: null is the empty text; offsets are code points, ends exclusive; rows repeat as in the input, those that
repeat a doc_id or have none included; an empty table gives no rows; very long texts are read whole, in linear time; of
equally good sequences the one with fewer entities at the end wins. Only the two named columns are read, so other
columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunked, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its test, by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p) < 4 and int(p) < 256 or int(p[-18:]) < 256 and not p[:-18].strip("0") for p in m.group().split(".")):
                    out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the field -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\d")
_BRACKETS = "()[]<>-_+%"
#: All that the candidates of kinds made of digits consist of, from the first token one can start with.
_NUMERIC = re.compile(r"[0-9(+](?:[0-9()\-./+]|\s(?=[0-9()\-./+]))*")
#: What each email candidate holds, and what must follow: one label, then a dot in any notation. A label of 200
#: characters or more isn't looked through here.
_AT = re.compile(r"@|(?<![^\W\d_])[aA][tT](?![^\W\d_])")
_AFTER = re.compile(
    r"[\s()\[\]<>_+%-]*+(?:[^\s.]{200}|[^\s.]{0,200}?dot|[^\s.]{0,200}+[\s()\[\]<>_+%-]*+(?:\.|dot))", re.IGNORECASE
)
CUES = {
    "email": ("mail", "email", "e", "contact", "write", "reach", "inbox"),
    "ip": ("ip", "host", "server", "address", "addr", "client", "from"),
    "card": ("card", "visa", "mastercard", "amex", "pay", "credit", "debit", "payment"),
    "phone": ("call", "tel", "phone", "mobile", "fax", "cell", "ring", "sms", "dial"),
}
_CUE = {w: kind for kind, ws in CUES.items() for w in ws}
TOPS = ("com", "org", "net", "edu", "io", "de", "fr", "es", "uk")


def tokens_of(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]


def _cue(tokens: list, i: int) -> str:
    for t, *_ in reversed(tokens[max(0, i - 3) : i]):
        if (kind := _CUE.get(t.lower())) is not None:
            return kind
    return "none"


def segments(text: str, tokens: list) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments (first token, end token, kind, whole-span features)."""
    out = []
    n = len(tokens)
    for i, (t, a, _) in enumerate(tokens):
        if t.isdigit() or t in "+(":
            digits, groups, seps = "", [], set()
            for j in range(i, min(n, i + MAX_TOKENS)):
                u, ua, ub = tokens[j]
                if j > i and ua - tokens[j - 1][2] > 1:
                    break
                if j > i and ua > tokens[j - 1][2]:
                    seps.add(" ")
                if u.isdigit() and u.isascii():
                    digits += u
                    groups.append(u)
                elif u in "()-./+" and (u != "+" or j == i):
                    seps.add(u)
                    continue
                else:
                    break
                if len(digits) > 19:
                    break
                if len(digits) < 7 and len(groups) < 4:
                    continue
                shape = "-".join(str(len(g)) for g in groups[:6])
                follow = text[ub : ub + 1]
                feats = [
                    "bias", f"digits{len(digits)}", f"groups{min(len(groups), 6)}", f"seps{''.join(sorted(seps))}",
                    f"shape{shape}", f"cue_{_cue(tokens, i)}", f"first_{t if t in '+(' else ('0' if t[0] == '0' else 'd')}",
                    f"luhn{len(digits) >= 13 and luhn(digits)}",
                    f"quad{len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)}",
                    f"follow{'d' if follow.isalnum() else '.' if follow in '.-/' and follow else 'o'}",
                    f"before{'d' if a and (text[a - 1].isalnum() or text[a - 1] in '.-/$#') else 'o'}",
                ]
                kinds = [k for k, ok in (("ip", len(groups) == 4 and len(digits) <= 12), ("card", 13 <= len(digits) <= 19), ("phone", 7 <= len(digits) <= 15)) if ok]
                out += [(i, j + 1, k, feats) for k in kinds]
        elif t[0].isalnum() and (i == 0 or tokens[i - 1][2] < a or tokens[i - 1][0] in "<([:,;"):
            at = dots = spaces = 0
            spelled = stop = parted = False
            last = "label"  # what the last token besides brackets was
            for j in range(i + 1, min(n, i + MAX_TOKENS)):
                u, ua, ub = tokens[j]
                low = u.lower()
                gap = ua > tokens[j - 1][2]
                spaces += gap
                parted = last == "label" and (parted or gap)
                if low in ("at", "@") and not at:
                    at, spelled, last = j, spelled or low == "at", "mark"
                elif low in (".", "dot"):
                    dots += bool(at) and last == "label"
                    spelled = spelled or low == "dot"
                    # A dot that ends a sentence: a space behind it and none before.
                    stop = stop or (low == "." and not gap and j + 1 < n and tokens[j + 1][1] > ub)
                    last = "mark"
                elif u[0].isalnum():
                    if at and dots and j > at + 1 and tokens[j - 1][0].lower() in (".", "dot", ")", "]"):
                        feats = [
                            "bias", f"dots{min(dots, 4)}", f"spelled{spelled}", f"spaces{min(spaces, 8)}",
                            f"local{min(at - i, 4)}", f"tail{min(len(u), 5)}{u.isalpha()}", f"cue_{_cue(tokens, i)}",
                            f"pair{spelled}{low in TOPS}", f"stop{stop}", f"stop{stop}{low in TOPS}",
                            f"more{j + 2 < n and tokens[j + 1][0].lower() in ('.', 'dot') and tokens[j + 1][1] - ub <= 1 and tokens[j + 2][1] - tokens[j + 1][2] <= 1 and tokens[j + 2][0].isalpha()}",
                        ]
                        out.append((i, j + 1, "email", feats))
                    if spaces and not at or parted:
                        break
                    last = "label"
                elif u not in _BRACKETS:
                    break
    return out


def _either(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Field:
    """Weights of segment features by kind, and of an entity right after another."""

    def __init__(self) -> None:
        self.w: dict[str, float] = defaultdict(float)

    def _score(self, kind: str, feats: list[str]) -> float:
        w = self.w
        return sum(w.get(f"{kind}|{f}", 0.0) for f in feats)

    def _lattice(self, n: int, segs: list) -> list[list]:
        """By end token: (start, kind, score, segment number)."""
        ends: list[list] = [[] for _ in range(n + 1)]
        for s, (i, j, kind, feats) in enumerate(segs):
            ends[j].append((i, kind, self._score(kind, feats), s))
        return ends

    def decode(self, n: int, segs: list) -> list[int]:
        """Numbers of the segments of the best sequence; labels are 0 (other token) and 1 (an entity just ended)."""
        ends = self._lattice(n, segs)
        touch = self.w.get("touch", 0.0)
        best = [[-1e18, -1e18] for _ in range(n + 1)]
        back: list[list] = [[None, None] for _ in range(n + 1)]
        best[0][0] = 0.0
        for t in range(1, n + 1):
            y = 0 if best[t - 1][0] >= best[t - 1][1] else 1
            best[t][0], back[t][0] = best[t - 1][y], (t - 1, y, None)
            for i, _, score, s in ends[t]:
                a, b = best[i][0] + score, best[i][1] + score + touch
                if max(a, b) > best[t][1]:
                    best[t][1], back[t][1] = max(a, b), (i, int(b > a), s)
        out, t, y = [], n, 0 if best[n][0] >= best[n][1] else 1
        while t > 0:
            t, y, s = back[t][y]
            if s is not None:
                out.append(s)
        return out[::-1]

    def gradient(self, n: int, segs: list, gold: set[int], grad: dict[str, float]) -> float:
        """Adds the gradient of the log-likelihood of the gold segments; returns the log-likelihood."""
        ends = self._lattice(n, segs)
        touch = self.w.get("touch", 0.0)
        starts: list[list] = [[] for _ in range(n + 1)]
        for j, row in enumerate(ends):
            for i, _, score, s in row:
                starts[i].append((j, score, s))
        al = [[-math.inf, -math.inf] for _ in range(n + 1)]
        al[0][0] = 0.0
        for t in range(1, n + 1):
            al[t][0] = _either(*al[t - 1])
            for i, _, score, _s in ends[t]:
                al[t][1] = _either(al[t][1], _either(al[i][0], al[i][1] + touch) + score)
        be = [[-math.inf, -math.inf] for _ in range(n)] + [[0.0, 0.0]]
        for t in range(n - 1, -1, -1):
            for y in (0, 1):
                be[t][y] = be[t + 1][0]
                for j, score, _s in starts[t]:
                    be[t][y] = _either(be[t][y], be[j][1] + score + touch * y)
        z = _either(*al[n])
        truth = 0.0
        gold_ends = {segs[s][1] for s in gold}
        for j, row in enumerate(ends):
            for i, kind, score, s in row:
                p = math.exp(_either(al[i][0], al[i][1] + touch) + score + be[j][1] - z)
                p1 = math.exp(al[i][1] + touch + score + be[j][1] - z)
                d = (s in gold) - p
                grad["touch"] += (s in gold and i in gold_ends) - p1
                truth += (score + touch * (i in gold_ends)) * (s in gold)
                for f in segs[s][3]:
                    grad[f"{kind}|{f}"] += d
        return truth - z


_WORDS = "the of then order about please and note that number was sent today room total invoice see page items we is for with".split()
_PLACES = "home noon work once night least hand dawn sea ten school first last it him them that me dusk table".split()


def examples(count: int = 1000, seed: int = 11) -> Iterator[tuple[str, list[Span]]]:
    """Generated sentences with their personal data: all kinds in several notations, and look-alikes."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + num(r.choice((12, 14, 14, 14, 17)))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"0{num(2)} {num(4)} {num(4)}", f"{a} {b} {c}"))

    def email() -> str:
        who, at, top = r.choice(("jo.lee", "ann", "max22", "k_r", "oi.78", "info")), r.choice(("mail", "corp", "example", "uni")), r.choice(("com", "org", "net", "de"))
        plain = (f"{who}@{at}.{top}", f"{who}(at){at}.{top}", f"{who} (at) {at}.{top}", f"{who} at {at}.{top}", f"{who} [at] {at}.{top}")
        said = r.choice((*plain, f"{who} at {at} dot {top}", f"{who} [at] {at} [dot] {top}", f"{who} (at) {at} (dot) {top}", f"{who} @ {at}.{top}"))
        return r.choice((said, said, said, said.title(), said.upper()))

    def prose() -> str:
        """An ordinary 'at', before the end of a sentence as often as not."""
        verb, where = r.choice(("look", "met", "arrived", "stay", "aimed", "sold", "good", "was")), r.choice(_WORDS + _PLACES)
        end, then = r.choice((".", ".", ",", ". .", "")), r.choice(_WORDS)
        return r.choice((f"{verb} at {where}{end} {then}", f"{verb} at {where}{end} {then.title()}", f"{verb} at {where}.", f"{verb} at {where} {then}. {then}"))

    octet = lambda: str(r.randrange(256))
    makers = {
        "email": email, "phone": phone, "ip": lambda: r.choice((".", ".", ". "))[:1].join(octet() for _ in range(4)),
        "card": lambda: (lambda s: r.choice((s, grouped(s, " "), grouped(s, "-"), grouped(s, "."))))(card()),
        "none": lambda: r.choice((
            f"20{num(2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"v{num(1)}.{num(1)}.{num(2)}.{num(4)}", num(8), f"#{num(9)}",
            f"{num(3)}.{num(3)}.{num(3)},{num(2)}", num(16), f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}", f"{r.randrange(1, 24)}:{num(2)}:{num(2)}",
            f"{num(2)} / {num(4)}", "look at it dot by dot", prose(), prose(), prose(), prose(), prose(), f"{num(5)}-{num(5)}-{num(5)}", f"{num(4)} {num(4)}", f"{num(2)}.{num(2)}.20{num(2)}", f"x = {num(3)}.{num(4)}", f"{num(12)}", f"300.{octet()}.999.{octet()}",
        )),
    }
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            text += " ".join(r.choice(_WORDS) for _ in range(r.randrange(1, 5))) + " "
            kind = r.choice(("email", "ip", "card", "phone", "none", "none"))
            if kind != "none" and r.random() < 0.4:
                text += r.choice(CUES[kind]) + r.choice((" ", ": "))
            s = makers[kind]()
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice((" ", ". ", ", "))
        yield text, spans


@lru_cache(maxsize=1)
def trained(rounds: int = 40, rate: float = 0.5, ridge: float = 0.002) -> Field:
    """Fits the field by gradient ascent (Adagrad) on the generated sentences."""
    field, data = Field(), []
    for text, spans in examples():
        tokens = tokens_of(text, 0, len(text))
        segs = segments(text, tokens)
        want = set(spans)
        gold = {s for s, (i, j, k, _) in enumerate(segs) if (k, tokens[i][1], tokens[j - 1][2]) in want}
        data.append((len(tokens), segs, gold))
    past: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        grad: dict[str, float] = defaultdict(float)
        for n, segs, gold in data:
            if segs:
                field.gradient(n, segs, gold, grad)
        for f, g in grad.items():
            g = g / len(data) - ridge * field.w[f] / 10
            past[f] += g * g
            field.w[f] += rate * g / past[f] ** 0.5
    field.w = dict(field.w)
    return field


def _back(text: str, at: int, count: int) -> int:
    """The start of the count-th token before at, which is where a token starts."""
    size = 16 * count
    while True:
        low = max(0, at - size)
        starts = [m.start() for m in _TOKEN.finditer(text, low, at)]
        if len(starts) > count:  # the first one may be cut
            return starts[-count]
        if low == 0:
            return 0
        size *= 4


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text, at ends of tokens, that hold all candidate segments and the cue words before them."""
    found: list[list[int]] = []
    for m in _NUMERIC.finditer(text):
        if m.end() - m.start() >= 4 and sum(map(m.group().count, "0123456789")) >= 4:
            found.append([_back(text, m.start(), 3), m.end()])
    last = None
    for m in _AT.finditer(text):
        if _AFTER.match(text, m.end()):
            end = m.end()
            for t in islice(_TOKEN.finditer(text, end), MAX_TOKENS + 2):
                end = t.end()
            if last and m.start() <= last[1]:
                last[1] = end
            else:
                found.append(last := [_back(text, m.start(), MAX_TOKENS + 3), end])
    start = end = -1
    for a, b in sorted(found):
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = max(end, b)
    if end >= 0:
        yield start, end


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """The field's spans that touch no base span, by kind, then start."""
    out: list[Span] = []
    busy = np.zeros(len(text) + 1, bool) if base else None
    for _, s, e in base:
        busy[s:e] = True
    for a, b in windows(text):
        tokens = tokens_of(text, a, b)
        segs = segments(text, tokens)
        if busy is not None:
            segs = [x for x in segs if not busy[tokens[x[0]][1] : tokens[x[1] - 1][2]].any()]
        if segs:
            for n in field.decode(len(tokens), segs):
                i, j, kind, _ = segs[n]
                out.append((kind, tokens[i][1], tokens[j - 1][2]))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are those of the base spans."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), (t or "" for t in b.column(1).to_pylist()), strict=True)
            for rows in chunked(pairs, lambda r: len(r[1]) + 64):
                cols: list[list] = [[] for _ in range(8)]
                for i, t in rows:
                    base = base_spans(t)
                    more = added_spans(t, base, field)
                    both = sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))
                    counts = [sum(k == kind for k, *_ in base) for kind in KINDS]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    for c, v in zip(cols, (i, *counts, digest, joined(both), len(more)), strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
