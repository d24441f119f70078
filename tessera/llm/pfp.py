"""Prefix-free parsing and suffix order of a set of byte strings, with numpy.

Triggers are places where a rolling hash of WIDTH bytes falls in one of PERIOD classes. Phrases run from trigger to
trigger and share the trigger's bytes with the next phrase, so no proper suffix of a phrase that is longer than a
trigger is a prefix of another. Sorting the suffixes of the distinct phrases (the dictionary) and the suffixes of the
sequence of phrases (the parse) gives the order of all suffixes of the strings: first by the rest of the phrase, then
by the parse that follows.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.words import Hasher

WIDTH = 8
PERIOD_BITS = 4
_B = 0x9E3779B97F4A7C15
_C = np.uint64(0xD6E8FEB86659FD93)


def rolling(data: np.ndarray, doublings: int) -> np.ndarray:
    """Hashes of the 2**doublings bytes from each place, modulo 2^64."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, step = _B, 1
    for _ in range(doublings):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % 2**64, step * 2
    return h


def triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, string) of the triggers that lie within one string; string i is data[offsets[i]:offsets[i + 1]]."""
    h = rolling(data, WIDTH.bit_length() - 1)
    t = np.flatnonzero((h * _C) >> np.uint64(64 - PERIOD_BITS) == 0)
    owner = np.searchsorted(offsets, t, side="right") - 1
    inside = t + WIDTH <= offsets[owner + 1]
    return t[inside], owner[inside]


def inner_phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the phrases between two triggers of one string."""
    t, owner = triggers(data, offsets)
    same = owner[1:] == owner[:-1] if len(t) else np.zeros(0, bool)
    s, e = t[:-1][same], t[1:][same] + WIDTH
    return s, e, Hasher(data)(s, e)


def _refine(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of items by (group, key), and for each in that order its new group: the old one's number plus how many of
    the old group's items have smaller keys."""
    order = np.argsort((group << 32) | key)
    g, k = group[order], key[order]
    index = np.arange(len(order))
    fresh = np.ones(len(order), bool)
    fresh[1:] = g[1:] != g[:-1]
    apart = fresh.copy()
    apart[1:] |= k[1:] != k[:-1]
    base = index[fresh][np.cumsum(fresh) - 1]
    return order, g + (index[apart][np.cumsum(apart) - 1] - base)


def suffix_ranks(first: np.ndarray, covered: int, left: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of terminated sequences by prefix doubling; equal suffixes share a rank.

    first: keys that order by the first ``covered`` symbols; left: how many symbols each suffix has. A rank is the
    number of smaller suffixes plus one, so only suffixes that are still tied and not at their end are sorted again."""
    n = len(first)
    rank = np.ones(n, np.int64)
    order = np.argsort(first)
    k = first[order]
    apart = np.ones(n, bool)
    apart[1:] = k[1:] != k[:-1]
    rank[order] = np.flatnonzero(apart)[np.cumsum(apart) - 1] + 1
    size = np.bincount(rank, minlength=n + 2)
    live = np.flatnonzero((size[rank] > 1) & (left > covered))
    while len(live):
        order, new = _refine(rank[live], rank[live + covered])
        live = live[order]
        rank[live] = new
        covered *= 2
        tied = np.ones(len(live), bool)
        tied[:-1] = new[1:] == new[:-1]
        tied[-1:] = False
        tied[1:] |= new[1:] == new[:-1]
        live = live[tied & (left[live] > covered)]
    return rank


def corpus_order(data: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The order of the suffixes at some places of the strings data[offsets[i]:offsets[i + 1]]: a permutation of
    places in which suffixes with a common beginning are neighbours."""
    n_strings = len(offsets) - 1
    t, owner = triggers(data, offsets)
    # A phrase from each string's start to its first trigger, between triggers, and from the last trigger to the end.
    s = np.concatenate([offsets[:-1], t])
    own = np.concatenate([np.arange(n_strings), owner])
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    twice = np.zeros(len(s), bool)  # a string that starts with a trigger needs no phrase before it
    twice[:-1] = (own[:-1] == own[1:]) & (s[:-1] == s[1:])
    s, own = s[~twice], own[~twice]
    last = np.ones(len(s), bool)
    last[:-1] = own[1:] != own[:-1]
    e = np.empty(len(s), np.int64)
    e[:-1] = s[1:] + WIDTH
    e[last] = offsets[own[last] + 1]
    h = Hasher(data)(s, e) ^ last.astype(np.uint64)
    _, first, phrase = np.unique(h, return_index=True, return_inverse=True)
    # The dictionary: distinct phrases one after the other, each ended by a symbol below all bytes.
    size = (e - s)[first] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    which = np.repeat(np.arange(len(first)), size)
    inner = np.arange(at[-1]) - at[which]
    code = np.zeros(at[-1] + 8, np.uint64)
    body = inner < size[which] - 1
    code[: at[-1]][body] = data[(s[first][which] + inner)[body]].astype(np.uint64) + np.uint64(1)
    left = size[which] - inner
    key = np.zeros(at[-1], np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(left > k, code[k : k + at[-1]], np.uint64(0))
    dictionary = suffix_ranks(key.view(np.int64), 7, left)
    # The parse: phrases by their rank in the dictionary, each string's parse ended by rank 0.
    rank = dictionary[at[:-1]][phrase]
    ends = np.flatnonzero(last)
    count = np.diff(np.concatenate([[-1], ends]))
    left_p = np.repeat(np.cumsum(count), count) - np.arange(len(rank))
    parse = suffix_ranks(rank, 1, left_p)
    follow = np.zeros(len(rank), np.int64)
    follow[:-1][~last[:-1]] = parse[1:][~last[:-1]]
    i = np.searchsorted(s, places, side="right") - 1
    alpha = dictionary[at[phrase[i]] + (places - s[i])]
    return np.argsort((alpha << 32) | follow[i], kind="stable")


def equal_neighbours(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each place equal those from the place before it in the list."""
    n = len(data) - 7
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(len(places), bool)
    same[:1] = False
    live = np.flatnonzero(same)
    for k in [*range(0, length - 7, 8), length - 8]:
        live = live[word[places[live] + k] == word[places[live - 1] + k]]
    out = np.zeros(len(places), bool)
    out[live] = True
    return out
