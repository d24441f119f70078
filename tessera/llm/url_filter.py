"""URL filter: allow and block rules, and a logistic regression on hashed character n-grams of host and path.

The regression is fitted on the driver from a small labelled URL table (url, blocked 0/1); at most MAX_LABELLED rows of
it are used, the first by url. Rules come first: a rule fits its host and all subdomains if the url's path starts with
the rule's path, and the longest rule wins.

Defined cases: a url that is null or has no ``://`` has an empty host and path, and its verdict is that of the bias alone;
urls of any length are judged whole; rows repeat as they do in the input, null page_ids included; of rules of one length
that fit, the later one of the table wins; an empty table gives no rows. Input columns named host, path, rule, verdict or
p_block are left out, all others are carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, chunked, prepare, table

DIMS = 1 << 14
GRAMS = (3, 4, 5)
MAX_LABELLED = 5000
CHUNK_CHARS = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Words of unwanted and of ordinary sites. Both kinds get the same hosts and paths around them, so that only words tell.
UNWANTED = (
    "casino poker betting jackpot roulette lottery pills pharmacy viagra steroids loans payday adult xxx porn escort webcams "
    "warez crack keygen torrent replica spam clickbait malware phishing adware followers backlinks popunder"
).split()
ORDINARY = (
    "news library university museum weather recipes history science travel music sports health garden school journal film "
    "books forum maps photo theatre law energy climate research family kitchen language council railway"
).split()
AROUND = ("online", "best", "my", "daily", "world", "free", "club", "hub", "zone", "top", "city", "central")
ENDINGS = ("com", "net", "org", "info", "co.uk", "de", "io", "example")
PATHS = ("/", "/index.html", "/2021/05/17/a-day", "/en/about", "/p/48213", "/shop/cart", "/tag/{w}", "/{w}-guide.html")


def made_names(n: int = 60) -> list[str]:
    """Names of two to four syllables that mean nothing, as most sites have."""
    out, x = [], 1
    for k in range(n):
        name = ""
        for _ in range(2 + k % 3):
            x = x * 16807 % 2147483647
            name += "bdfgklmnprstvz"[x % 14] + "aeiou"[x // 14 % 5] + ("", "n", "r", "s", "")[x // 70 % 5]
        out.append(name)
    return out


def labelled_urls() -> tuple[tuple[str, str, int], ...]:
    """The small labelled URL table that the query is trained on: (host, path, blocked), by rule from the words above.
    Unknown names stand on the ordinary side; an ordinary host with an unwanted word in its path is blocked too."""
    out = []
    for blocked, own in ((1, UNWANTED), (0, [*ORDINARY, *made_names()])):
        for i, w in enumerate(own):
            for j in range(8):
                a, end = AROUND[(i + 5 * j) % len(AROUND)], ENDINGS[(3 * i + j) % len(ENDINGS)]
                name = (w, f"{a}-{w}", f"{w}-{a}", f"{a}{w}", f"{w}{a}", f"{w}{i + 2}", f"{w}.{a}", f"{a}.{w}")[j]
                host = ("", "www.", "m.", "")[(i + j) % 4] + f"{name}.{end}"
                out.append((host, PATHS[(i + j) % len(PATHS)].format(w=w), blocked))
                if not blocked and j % 4 == 0:
                    out.append((host, ("/buy-{w}", "/{w}/go")[j // 4].format(w=UNWANTED[(i + 7 * j) % len(UNWANTED)]), 1))
    return tuple(out)


LABELLED = labelled_urls()


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are a driver-side parameter of bounded size."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, index of its url) of all character n-grams of ^host$ and ^path$, a host's apart from a path's."""
    marked = [f"^{s}$" for s in (*hosts, *paths)]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(chars))
    found, whose = [], []
    for size in GRAMS:
        at = np.flatnonzero(left >= size)
        h = np.where(owner[at] < len(hosts), np.uint64(size), np.uint64(size + 64))
        for k in range(size):
            h = (h ^ chars[at + k]) * _PRIME
            h ^= h >> np.uint64(32)
        found.append((h % np.uint64(DIMS)).astype(np.int64))
        whose.append(owner[at] % max(1, len(hosts)))
    return np.concatenate(found), np.concatenate(whose)


def _scale(owner: np.ndarray, n: int) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))


def fit(rows: list[tuple[str, str, int]], steps: int = 1500, rate: float = 4.0, ridge: float = 3e-5) -> np.ndarray:
    """Weights (the last is the bias) of the regression on the n-gram shares of each url, by gradient descent."""
    w = np.zeros(DIMS + 1)
    if not rows:
        return w
    idx, owner = grams([h for h, *_ in rows], [p for _, p, _ in rows])
    share = _scale(owner, len(rows))[owner]
    y = np.array([b for *_, b in rows], float)
    for _ in range(steps):
        z = np.bincount(owner, w[idx] * share, len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-z)) - y
        w[:-1] -= rate * (np.bincount(idx, err[owner] * share, DIMS) / len(rows) + ridge * w[:-1])
        w[-1] -= rate * err.mean()
    return w


def probabilities(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability of block of each url; urls are worked on in chunks, as one may be very long."""
    out = [np.zeros(0)]
    for part in chunked(zip(hosts, paths, strict=True), lambda r: len(r[0]) + len(r[1]) + 8, CHUNK_CHARS):
        idx, owner = grams([h for h, _ in part], [p for _, p in part])
        z = np.bincount(owner, w[idx], len(part)) * _scale(owner, len(part)) + w[-1]
        out.append(1 / (1 + np.exp(-z)))
    return np.concatenate(out)


def filter_urls(
    pages: DataFrame, url: str = "url", rules: tuple = RULES, labelled: DataFrame | tuple = LABELLED, cut: float = 0.5
) -> DataFrame:
    """pages with host, path, rule, verdict and p_block (the model's probability of block) added."""
    prepare(pages.sparkSession)
    if isinstance(labelled, DataFrame):
        few = labelled.select(
            host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.col("blocked").cast("int").alias("b")
        )
        rows = [tuple(r) for r in few.where("b IS NOT NULL").orderBy("h", "p", "b").limit(MAX_LABELLED).collect()]
    else:
        rows = list(labelled)[:MAX_LABELLED]
    w = fit(rows)

    @F.pandas_udf("double")
    def p_block(host, path):
        import pandas as pd

        return pd.Series(probabilities(w, host.tolist(), path.tolist()))

    base = pages.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    rule, verdict = rule_columns(F.col("__host"), F.col("__path"), rules)
    scored = base.withColumn("__p", p_block("__host", "__path"))
    return scored.select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "p_block")],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("__p") >= cut, "block").otherwise("allow")).alias("verdict"),
        F.col("__p").alias("p_block"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
