import random

import pytest

from tessera.llm import token_counts
from tessera.llm.token_counts import RANKS, TokenTree, count_edited, encoder, redactions

count = encoder(RANKS)


def test_trees_against_whole_encoding(monkeypatch):
    monkeypatch.setattr(token_counts.cuts, "__defaults__", (4,))
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice(["a", "the", " ", "  ", "é", "1", "23", "'s", "\n", "!?", " a b", " dog"]) for _ in range(r.randrange(30)))
        tree = TokenTree(t, count)
        assert tree.total == count(t)
        for _ in range(2):
            old = tree.text
            edits = [(r.randrange(-1, len(old) + 2), r.randrange(-1, len(old) + 3), r.choice(["", " ", "x", " y z ", "\n"])) for _ in range(r.randrange(4))]
            tree.apply(edits)
            assert tree.total == count(tree.text) == sum(tree.sums[tree.cap :]), (old, edits)


def test_edits_give_the_edited_text_and_touch_few_leaves():
    t = "some words go here " * 2000
    tree = TokenTree(t, count)
    tree.encoded = 0
    tree.apply([(5, 10, "WORDS"), (20_000, 20_000, "new ")])
    assert tree.text == t[:5] + "WORDS" + t[10:20_000] + "new " + t[20_000:]
    assert tree.total == count(tree.text) and tree.encoded < 3000


def test_query_rows(spark):
    texts = [None, "", "call 12345 or 99", "word " * 50_000, "漢" * 3000, "a" * 50_000, "12345" * 3]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(2, texts[2], 5), (None, "x y", 5)], "doc_id long, text string, n_leaves_before int")
    got = count_edited(df, redactions, trees=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "x y" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        edited, at = "", 0
        for a, b, new in redactions(t):
            edited, at = edited + t[at:a] + new, b
        edited += t[at:]
        assert r["edited_text"] == edited and (r["n_tokens"], r["n_tokens_edited"]) == (count(t), count(edited))
        assert sum(r["leaf_chars"]) == len(edited) and r["tree"][1] == count(edited) and r["n_leaves_before"] == 5
    assert count_edited(df.limit(0), redactions).count() == 0


def test_edits_as_a_column(spark):
    rows = [(1, "abc def", [(0, 3, "x"), None, (None, 2, "y"), (3, None, None)]), (2, "abc", None), (3, None, [(0, 9, "hi")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start: int, end: int, replacement: string>>")
    got = {r["doc_id"]: r for r in count_edited(df, "edits", trees=True).collect()}
    assert [got[k]["edited_text"] for k in (1, 2, 3)] == ["x def", "abc", "hi"]
    assert all(r["n_tokens_edited"] == count(r["edited_text"]) for r in got.values())


def test_stored_trees_encode_edits_alone(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(4000)), "one two", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = count_edited(df, redactions, trees=True).select("doc_id", "edited_text", "leaf_chars", "tree")
    again = lambda t: [(len(t) // 2, min(len(t), len(t) // 2 + 3), "new 12 words"), (len(t), len(t), " end")]
    got = count_edited(first, again, "edited_text", trees=True, stored=("leaf_chars", "tree")).collect()
    assert len(got) == 4
    for x in got:
        assert x["n_tokens_edited"] == count(x["edited_text"]) == x["tree"][1] and x["edited_text"].endswith(" end")
        assert x["n_chars_reencoded"] < 3000
    long = next(x for x in got if x["doc_id"] == 0)
    assert len(long["edited_text"]) > 15_000
    with pytest.raises(ValueError):
        TokenTree.resume("longer than it was", [3], [1, 1], count)


def test_columns_named_like_outputs_are_left_out(spark):
    df = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id long, text string, n_tokens int, tree string")
    got = count_edited(df, redactions, trees=True)
    assert got.columns.count("n_tokens") == got.columns.count("tree") == 1 and got.first()["n_tokens"] == count("a b")
    assert count_edited(df, redactions).first()["tree"] == "x"
