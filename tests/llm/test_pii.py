import hashlib
import itertools
import random
import re
import time
from collections import defaultdict

import pytest

from tessera.llm.pii import KINDS, Field, added_spans, base_spans, examples, find_pii, joined, luhn, segments, tokens_of, trained

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_against_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("ab@@..-+ 0123459()%é\n") for _ in range(r.randrange(40)))
        assert base_spans(t) == plain(t), t
    t = "x 4111 1111 1111 1111, +1 (555) 010-9999 a.b@c.d.e 10.0.0.256 10.0.0.255 0000.1.2.3"
    assert base_spans(t) == plain(t) and len(plain(t)) == 5


def test_field_on_unseen_sentences():
    field, right = trained(), 0
    data = list(examples(200, seed=99))
    for text, spans in data:
        tokens = tokens_of(text, 0, len(text))
        segs = segments(text, tokens)
        got = {(segs[s][2], tokens[segs[s][0]][1], tokens[segs[s][1] - 1][2]) for s in field.decode(len(tokens), segs)}
        right += got == set(spans)
    assert right / len(data) > 0.9


def test_added_spans_touch_no_base_span():
    t = "call +1 (826) 555-4081 190.137.223.204 now, or jo at mail dot com"
    base = base_spans(t)
    more = added_spans(t, base, trained())
    assert ("phone", 5, 22) in more and any(k == "email" for k, *_ in more)
    assert not any(a < e and s < b for _, a, b in more for _, s, e in base)


def test_query_rows(spark):
    texts = [None, "", "no data", "mail a@b.co", "é" * 10 + " 10.1.2.3", "7" * 200_000, "a@" * 50_000, "+1(" * 20_000, "1 " * 100_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "mail a@b.co", "x"), (None, "x", "x")], "doc_id long, text string, spans string")
    got = find_pii(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "x" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = plain(t) if len(t) < 1000 else base_spans(t)
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, *_ in base) for x in ("email", "ip", "card", "phone")]
        assert set(filter(None, joined(base).split(","))) <= set(r["spans"].split(","))
    assert find_pii(df.limit(0)).count() == 0


def whole(text, base, field):
    """The field's spans from decoding the whole text at once."""
    tokens = tokens_of(text, 0, len(text))
    segs = [x for x in segments(text, tokens) if not any(a < tokens[x[1] - 1][2] and tokens[x[0]][1] < b for _, a, b in base)]
    out = [(segs[s][2], tokens[segs[s][0]][1], tokens[segs[s][1] - 1][2]) for s in field.decode(len(tokens), segs)]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def test_windows_lose_nothing():
    r, field, added = random.Random(3), trained(), 0
    parts = ["at", "At", "AT", "@", "dot", "Dot", ".", " ", " ", "  ", "\n", "a", "mail", "com", "jo", "lee", "x1", "7", "12", "555", "0199", "4111", "(", ")", "+", "-", "[", "_", "%", "/", ",", "card", "call", "\u0663", "\u00e9", "\u00b2", "is", "we"]
    kinds = [t for t, _ in examples(300, seed=5)]
    for k in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(60)))
        if k % 3 == 0:
            t += " " + r.choice(kinds) + " ".join(r.choice(parts) for _ in range(20)) + r.choice(kinds)
        base = base_spans(t)
        got = added_spans(t, base, field)
        assert got == whole(t, base, field), t
        added += len(got)
    assert added > 500


@pytest.mark.parametrize("said", ["jo.lee(at)corp.org", "ann (at) mail.com", "max22 at uni.net", "Ann At Mail Dot Com", "JO [AT] CORP [DOT] DE"])
def test_spelled_addresses(said):
    for t in (said, f"please write to {said} and wait", f"the note: {said}, then the order"):
        a = t.index(said)
        assert ("email", a, a + len(said)) in added_spans(t, base_spans(t), trained())


def test_ordinary_at_is_no_address():
    for t in ("We met at home. Then the order came.", "look at the house and the dog. Then go", "he was good at it. It was noon.", "stay at sea. call me"):
        assert added_spans(t, [], trained()) == []


def test_long_texts_take_linear_time():
    r = random.Random(4)
    n = 1_000_000
    sparse = ["".join(r.choice("abcdefgh12") for _ in range(n)), "7" * n, "a1b2" * (n // 4), " " * n + "at" + " " * n + "x.y", "at " * (n // 3), "(" * n]
    dense = ["12 " * 40_000, "1at" * 40_000, "a at b.c " * 20_000]  # every token starts candidates
    for t in sparse + dense:
        start = time.perf_counter()
        added_spans(t, [], trained())
        assert time.perf_counter() - start < 10, t[:40]


def random_field(r, n):
    segs = []
    for _ in range(r.randrange(1, 7)):
        i = r.randrange(n)
        segs.append((i, r.randrange(i + 1, n + 1), r.choice(KINDS), [f"f{r.randrange(4)}", "bias"]))
    field = Field()
    field.w.update({f"{k}|{f}": r.uniform(-2, 2) for k in KINDS for f in ("bias", "f0", "f1", "f2", "f3")} | {"touch": r.uniform(-2, 2)})
    return field, segs


def sequences(field, segs):
    """(score, numbers of the segments) of every set of segments that don't overlap."""
    for k in range(len(segs) + 1):
        for chosen in itertools.combinations(range(len(segs)), k):
            parts = sorted(segs[s][:2] for s in chosen)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(parts)):
                touching = sum(a[1] == b[0] for a, b in itertools.pairwise(parts))
                yield sum(field._score(segs[s][2], segs[s][3]) for s in chosen) + touching * field.w["touch"], set(chosen)


def test_decoding_against_enumeration_and_gradient_against_differences():
    import math

    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(1, 9)
        field, segs = random_field(r, n)
        every = list(sequences(field, segs))
        best = max(x for x, _ in every)
        got = set(field.decode(n, segs))
        assert math.isclose(next(x for x, c in every if c == got), best, abs_tol=1e-9)
        gold = r.choice(every)[1]
        grad = defaultdict(float)
        value = field.gradient(n, segs, gold, grad)
        like = lambda: next(x for x, c in sequences(field, segs) if c == gold) - math.log(sum(math.exp(x) for x, _ in sequences(field, segs)))
        assert math.isclose(value, like(), abs_tol=1e-9)
        for f in list(field.w):
            old = field.w[f]
            field.w[f] = old + 1e-5
            up = like()
            field.w[f] = old - 1e-5
            down = like()
            field.w[f] = old
            assert abs((up - down) / 2e-5 - grad[f]) < 1e-5
