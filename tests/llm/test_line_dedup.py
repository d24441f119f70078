import random

import brute
from tessera.llm.line_dedup import LineRuns, dedup_lines, line_hashes

SCHEMA = "doc_id long, text string"
LONG = "this line is long enough"


def run(spark, rows, schema=SCHEMA, **kw):
    df = dedup_lines(spark.createDataFrame(rows, schema), **kw)
    return sorted(
        ((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=lambda r: (r[0] is None, r)
    )


def want(rows, **kw):
    return sorted(brute.line_dedup(rows, **kw), key=lambda r: (r[0] is None, r))


def make(r, n=60):
    pool = [f"{r.choice(['Ä', 'x'])} shared line number {k} of many" for k in range(12)] + ["short", "", "  pad  ", "É" * 20, "e" * 19]
    pad = lambda s: r.choice(["", " ", "\t", "\x0b"]) + (s.upper() if r.random() < 0.3 else s) + r.choice(["", "\r", "  "])
    return [(i, "\n".join(pad(r.choice(pool)) for _ in range(r.randrange(8)))) for i in range(n)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = make(random.Random(seed))
        assert run(spark, rows) == want(rows)


def test_batches_and_compaction_change_nothing(spark):
    rows = make(random.Random(3))
    runs = LineRuns(spark, fan=2)
    assert run(spark, rows, runs=runs, batches=5) == want(rows)
    assert len(runs.levels) > 1 and all(len(level) <= 2 for level in runs.levels)


def test_defined_cases(spark):
    rows = [(1, LONG), (2, LONG), (2, LONG), (3, LONG + "\n" + LONG), (4, None), (5, ""), (None, LONG), (6, "a\n\n")]
    got = run(spark, rows)
    assert got == want(rows)
    assert (3, 2, 0, LONG + "\n" + LONG) in got and got.count((2, 1, 1, "")) == 2 and (None, 1, 0, LONG) in got
    assert run(spark, []) == []


def test_very_long_document(spark):
    lines = [f"line {k:05d} that two others have too" for k in range(3000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(reversed(lines))), (3, "\n".join(lines[1:]))]
    assert run(spark, rows) == want(rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, LONG, "x", 7) for i in range(4)], SCHEMA + ", h1 string, n_docs int")
    assert sorted(r["n_dropped"] for r in dedup_lines(df).collect()) == [0, 1, 1, 1]


def test_columns_named_like_outputs_are_left_out(spark):
    df = spark.createDataFrame([(i, LONG, "held") for i in range(4)], "doc_id long, text string, kept_text string")
    got = dedup_lines(df)
    assert got.columns.count("kept_text") == 1 and sorted(r["kept_text"] for r in got.collect()) == ["", "", "", LONG]


def test_main_path_is_native(spark):
    plan = line_hashes(spark.createDataFrame([(1, LONG)], SCHEMA), "doc_id", "text", 20)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
