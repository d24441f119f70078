"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix_dedup(docs, length=100):
    """docs: (doc_id, text) in corpus order -> (doc_id, n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), []
    for i, t in docs:
        t = (t or "").encode() if not isinstance(t, bytes) else t
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            g = t[s : s + length]
            if g in seen:
                gone[s : s + length] = [True] * length
            seen.add(g)
        left = bytes(b for b, x in zip(t, gone) if not x)
        out.append((i, len(t), sum(gone), sum(x and not (k and gone[k - 1]) for k, x in enumerate(gone)), sha(left)))
    return out


def line_dedup(docs, min_chars=20, min_docs=3):
    """docs: (doc_id, text) -> (doc_id, n_lines, n_dropped, kept text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held[key(line)].add(i)
    top = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(fps, radius=2):
    """fps: (doc_id, fingerprint) -> component id (smallest doc_id) by fingerprint."""
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {f: least.get(root(f)) for f in distinct}


def norm_words(text):
    text = re.sub("[À-ÖØ-Þ]", lambda m: chr(ord(m[0]) + 32), text or "")
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.translate(LOWER))


def leaks(docs, items, similar=0.8):
    """(doc_id, item_id) pairs with an item-sized window of weighted 5-shingle similarity 0.8 or more."""
    out = set()
    grams = lambda w: collections.Counter(tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4)))
    for j, item in items:
        w = norm_words(item)
        if w:
            s = grams(w)
            for i, t in docs:
                v = norm_words(t)
                for a in range(len(v) - len(w) + 1):
                    both = sum((grams(v[a : a + len(w)]) & s).values())
                    if both / (2 * sum(s.values()) - both) >= similar:
                        out.add((i, j))
                        break
    return out
