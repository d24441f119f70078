import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog
from tessera.sources import Axis, PieceTable, boxes_2d, cells_per_axis, from_rows, geometry, insert_guard, row_columns, synth_pieces, to_rows
from tessera.sources.pieces import number_pieces
from tessera.streaming import stream_mapping


def test_piece_table_checks(spark):
    df = spark.createDataFrame([(0, 1, 2.0, "s", 3)], "piece long, lo int, hi double, s string, value int")
    t = PieceTable.of(df, [("[)", "lo", "hi")], dtype="double")
    assert (t.ndim, t.nnz(), t.bounds, t.dtype.simpleString()) == (1, 1, ("[)",), "double")
    for axes, kw in (([("[)", "lo")], {}), ([("X", "lo", "hi")], {}), ([("P", "lo", "hi")], {}), ([("P", "zz")], {}), ([("P", "s")], {}), ([("P", "lo")], {"piece": "no"})):
        with pytest.raises(ValueError):
            PieceTable.of(df, axes, **kw)


def test_validate_finite_and_metadata(spark, tmp_path):
    rows = [(0, 1.0, 2.0, 1.0), (1, 3.0, 2.0, 1.0), (2, float("nan"), 2.0, 1.0), (2, None, 2.0, 1.0)]
    t = PieceTable.of(spark.createDataFrame(rows, "piece long, lo double, hi double, value double"), [("(]", "lo", "hi")])
    assert t.validate() == {"null": 1, "nan": 1, "inverted": 1, "repeated_ids": 1}
    assert t.finite().nnz() == 2
    t.tagged().write.parquet(str(tmp_path / "t"))
    assert PieceTable.untagged(spark.read.parquet(str(tmp_path / "t"))).bounds == ("(]",)
    got = PieceTable.from_table(spark, str(tmp_path / "t"), {"piece": "piece", "x": "lo + 1", "value": "value"}, [("P", "x")])
    assert got.nnz() == 4
    assert [tuple(r) for r in number_pieces(spark.createDataFrame([("b",), ("a",)], "k string")).collect()] == [(0, "a"), (1, "b")]


def test_rows(spark):
    t = from_rows(spark, [{"lo0": "1.23456", "lo1": None, "hi1": 3}, {"lo0": "x", "lo1": 1, "hi1": 2, "value": ""}], ["P", "[)"])
    assert [tuple(r) for r in to_rows(t).collect()] == [(1.235, 0.0, 3.0, 1.0), (0.0, 1.0, 2.0, 0.0)]
    assert row_columns(["P", "[)"]) == [("coord0", "lo0"), ("lo1", "lo1"), ("hi1", "hi1"), ("value", "value")]
    assert from_rows(spark, [], ["P"]).nnz() == 0
    assert geometry(t).first()["shape_kind"] == "line"


@pytest.mark.parametrize("bounds,free", [("[)", 2), ("[]", 1), ("()", 2)])
def test_insert_guard(spark, bounds, free):
    make = lambda rows: from_rows(spark, [{"lo0": a, "hi0": b} for a, b in rows], [bounds])
    assert insert_guard(make([(2, 4), (9, 8), (1, 3)]), make([(0, 2), (5, 6)])).count() == free


def test_synth(spark):
    t = synth_pieces(spark, 300, ["[)", "P"], [64.0, 32.0], 0.5, 7)
    rows = [tuple(r) for r in t.df.orderBy("piece").collect()]
    side = cells_per_axis(300, 2)
    assert len({r[0] for r in rows}) == 300 and side == math.ceil(600**0.5)
    cells = {(math.floor(r[1] / (64 / side)), math.floor(r[3] / (32 / side))) for r in rows}
    assert len(cells) == 300 and all(r[1] <= r[2] for r in rows)
    assert rows == [tuple(r) for r in synth_pieces(spark, 300, ["[)", "P"], [64.0, 32.0], 0.5, 7).df.repartition(7).orderBy("piece").collect()]
    assert synth_pieces(spark, 0, ["P"], [1.0]).nnz() == 0 and boxes_2d(spark, 5, 4.0, 4.0).ndim == 2
    for bad in ((-1, ["P"], [1.0], 0), (1, ["P"], [1.0], 2), (1, ["P"], [], 0), (1, ["X"], [1.0], 0)):
        with pytest.raises(ValueError):
            synth_pieces(spark, *bad)
    with pytest.raises(ValueError):
        synth_pieces(spark, 50, ["P"], [1.0], side=3)


def test_stream_mapping(spark, tmp_path):
    spark.range(20).selectExpr("id", "id * 0.5D AS at").coalesce(2).write.parquet(str(tmp_path / "in"))
    ranges = spark.createDataFrame([(1, 0.0, 3.0), (2, 2.5, 4.0)], "r long, lo double, hi double")
    stream = spark.readStream.schema("id long, at double").parquet(str(tmp_path / "in"))
    q = stream_mapping(stream, ranges, "at", "lo", "hi", 1.0).writeStream.format("memory").queryName("mapped").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["id"], r["r"]) for r in spark.sql("SELECT id, r FROM mapped").collect())
    assert got == sorted((k, r) for k in range(20) for r, a, b in ((1, 0, 3), (2, 2.5, 4)) if a <= k / 2 < b)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalogue_against_sql(spark, data_dir, name):
    got = catalog.QUERIES[name](spark, data_dir).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_axis_is_frozen():
    assert Axis("[]", "a", "b").closed_right and Axis("P", "a").point
