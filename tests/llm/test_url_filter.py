import numpy as np

from tessera.llm.url_filter import GRAMS, LABELLED, RULES, filter_urls, fit, grams, probabilities, rule_columns

URLS = [
    "https://News.Example.ORG/es/1", "http://example.org/en/12?x", "http://a.example.org/en/2", "http://example.com/fr/9#t",
    "http://x.com/de/", "http://forg/es/", "http://com", "http://org", "no url", "", None, "a://b://c/d", "://host.org/",
    "http://user@h.com:80/fr/x", "HTTP://É.COM/de/é", "http://notexample.org/es/", "http://cheap-pills.example.net/",
    "http://x.net/a\nb?c",
]


def plain(url):
    """(host, path, rule, verdict by rule)."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))]
    best = max(
        (r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])),
        key=lambda r: len(r[0] + r[1]), default=None,
    )
    return host, path, best and best[0] + best[1], best and best[2]


def test_against_plain_version(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] + [(None, URLS[0], "z")], "page_id long, url string, host string")
    got = filter_urls(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[0] if r["page_id"] is None else URLS[r["page_id"]]
        host, path, rule, verdict = plain(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == (verdict or ("block" if r["p_block"] >= 0.5 else "allow"))
    assert filter_urls(df.limit(0)).count() == 0


def plain_grams(host, path):
    return sorted((m, x[k : k + n]) for m, x in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in GRAMS for k in range(len(x) - n + 1))


def test_grams_against_a_plain_version():
    urls = [("a.b", "/x"), ("", ""), ("é漢😀.com", "/\ud800y"), ("aaa", "aaa"), ("x" * 50, "/" * 9)]
    idx, owner = grams([h for h, _ in urls], [p for _, p in urls])
    kinds = {}
    for k, (h, p) in enumerate(urls):
        mine = idx[owner == k]
        assert len(mine) == len(plain_grams(h, p))
        alone, _ = grams([h], [p])
        assert sorted(mine) == sorted(alone)
        kinds |= {g: None for g in plain_grams(h, p)}
    assert 0.97 * len(kinds) <= len(set(idx.tolist())) <= len(kinds)


def test_long_urls_and_chunks(monkeypatch):
    from tessera.llm import url_filter

    w = fit(list(LABELLED))
    hosts, paths = ["casino.com", "x" * 500_000, "", "library.org"], ["/", "/y", "", "/z" * 200_000]
    whole = probabilities(w, hosts, paths)
    monkeypatch.setattr(url_filter, "CHUNK_CHARS", 1)
    assert np.array_equal(whole, probabilities(w, hosts, paths)) and whole[0] > 0.5
    assert probabilities(w, [], []).tolist() == []


def accuracy(rows, fold_of, folds):
    right = 0
    for f in range(folds):
        w = fit([r for r in rows if fold_of(r) != f])
        test = [r for r in rows if fold_of(r) == f]
        p = probabilities(w, [h for h, *_ in test], [p for _, p, _ in test])
        right += sum((x >= 0.5) == bool(b) for x, (*_, b) in zip(p, test, strict=True))
    return right / len(rows)


def test_cross_validated_accuracy():
    rows = list(LABELLED)
    hosts = sorted({h for h, *_ in rows})
    at = {h: k % 5 for k, h in enumerate(hosts)}
    assert accuracy(rows, lambda r: at[r[0]], 5) >= 0.85
    assert not fit([]).any()


def test_labelled_table_as_a_dataframe(spark):
    labelled = spark.createDataFrame([(f"http://{h}{p}", b) for h, p, b in LABELLED] + [(None, 1), ("x", None)], "url string, blocked int")
    df = spark.createDataFrame([(1, "http://casino-sun.co/x"), (2, "http://library-moon.co/x")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in filter_urls(df, labelled=labelled).collect()} == {1: "block", 2: "allow"}


def test_of_rules_of_one_length_the_later_wins(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.bc", "/x")], "h string, p string")
    rules = (("bc", "/x", "allow"), ("a.bc", "/", "block"), ("bc", "/", "allow"))
    assert tuple(df.select(*rule_columns(F.col("h"), F.col("p"), rules)).first()) == ("a.bc/", "block")
    rules = (("a.bc", "/", "block"), ("bc", "/x/", "allow"), ("a.bc", "/", "allow"))
    assert tuple(df.select(*rule_columns(F.col("h"), F.col("p"), rules)).first()) == ("a.bc/", "allow")
