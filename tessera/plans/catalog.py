"""The engine's queries over the benchmark tables, each with SQL that states the result independently (plain
comparison joins, running sums over breakpoints)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import coalesce, contract, contract_algebra, contract_rows, mapping, overlap_exists
from tessera.sources import Axis, PieceTable, from_rows, insert_guard, synth_pieces, to_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Days since 1970-01-01 and microseconds since then, without the session's time zone.
DAY = "cast(datediff(cast({0} AS date), date'1970-01-01') AS long)"
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0})"
DAY_SQL = "date_diff('day', DATE '1970-01-01', {0}::DATE)"
MINUTE_US, DAY_US = 60_000_000, 86_400_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    """A table's projection: output name = SQL expression."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def day(c: str) -> str:
    return DAY.format(c)


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """One piece for each combination of keys, valued by its number of rows; the keys number the piece."""
    return df.groupBy(*keys).agg(F.count("*").alias("value"))


def pieces(df: DataFrame, axes: list[Axis], piece: str | tuple[str, ...]) -> PieceTable:
    return PieceTable.of(df, axes, "value", piece)


# --- mapping ---------------------------------------------------------------------------------------------------------


@query('SELECT c_custkey AS "C_piece", s_suppkey AS "S_piece" FROM customer JOIN supplier ON c_nationkey = s_nationkey')
def map_pp_1d(spark, sf_dir):
    c = load(spark, sf_dir, "customer", piece="c_custkey", i="c_nationkey")
    s = load(spark, sf_dir, "supplier", piece="s_suppkey", i="s_nationkey")
    return mapping({"C": c, "S": s}, ["C", "S"], ["i[C] == i[S]"])


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "lineitem", piece="l_orderkey * 10 + l_linenumber", p="l_partkey", s="l_suppkey")


@query(
    'SELECT a.l_orderkey * 10 + a.l_linenumber AS "A_piece", b.l_orderkey * 10 + b.l_linenumber AS "B_piece" '
    "FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey"
)
def map_pp_2d(spark, sf_dir):
    t = _lines(spark, sf_dir)
    return mapping({"A": t, "B": t}, ["A", "B"], ["p[A] == p[B]", "s[A] == s[B]"])


def _months(spark, sf_dir) -> DataFrame:
    """Months in which there are orders: piece = months since year 0, lo and hi in days."""
    m = load(spark, sf_dir, "orders", y="year(o_orderdate)", m="month(o_orderdate)").distinct()
    return m.select(
        F.expr("y * 12 + m - 1").cast("long").alias("piece"),
        F.expr("cast(datediff(make_date(y, m, 1), date'1970-01-01') AS long)").alias("lo"),
        F.expr("cast(datediff(make_date(y + m div 12, m % 12 + 1, 1), date'1970-01-01') AS long)").alias("hi"),
    )


MONTHS_SQL = """months AS (
  SELECT y * 12 + m - 1 AS piece, date_diff('day', DATE '1970-01-01', make_date(y, m, 1)) AS lo,
         date_diff('day', DATE '1970-01-01', (make_date(y, m, 1) + INTERVAL 1 MONTH)::DATE) AS hi
  FROM (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders))"""
ORDERS_SQL = "o AS (SELECT o_orderkey AS piece, " + DAY_SQL.format("o_orderdate") + " AS d FROM orders)"


def _orders(spark, sf_dir, days: int) -> DataFrame:
    o = load(spark, sf_dir, "orders", piece="o_orderkey", lo=day("o_orderdate"))
    return o.withColumn("hi", F.col("lo") + days)


@query(
    f'WITH {MONTHS_SQL}, {ORDERS_SQL} SELECT o.piece AS "O_piece", months.piece AS "M_piece" FROM o JOIN months '
    "ON d < hi AND lo < d + 30"
)
def map_ii_1d(spark, sf_dir):
    return mapping(
        {"O": _orders(spark, sf_dir, 30), "M": _months(spark, sf_dir)}, ["O", "M"], ["lo[O] < hi[M]", "lo[M] < hi[O]"]
    )


@query(
    f'WITH {MONTHS_SQL}, {ORDERS_SQL} SELECT o.piece AS "O_piece", months.piece AS "M_piece" FROM o JOIN months '
    "ON d <= hi AND lo <= d + 5"
)
def map_ii_1d_closed(spark, sf_dir):
    """Ends that touch count: closed ranges of whole days."""
    return mapping(
        {"O": _orders(spark, sf_dir, 5), "M": _months(spark, sf_dir)}, ["O", "M"], ["lo[O] <= hi[M]", "lo[M] <= hi[O]"]
    )


@query(
    "WITH d AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS piece FROM events) "
    'SELECT event_id AS "E_piece", piece AS "D_piece" FROM events JOIN d '
    "ON piece * 86400000000 <= epoch_us(ts) AND epoch_us(ts) < (piece + 1) * 86400000000"
)
def map_pi_1d(spark, sf_dir):
    e = load(spark, sf_dir, "events", piece="event_id", at=MICROS.format("ts"))
    d = e.select(F.expr(f"at div {DAY_US}").alias("piece")).distinct()
    d = d.withColumns({"lo": F.col("piece") * DAY_US, "hi": (F.col("piece") + 1) * DAY_US})
    return mapping({"E": e, "D": d}, ["E", "D"], ["lo[D] <= at[E]", "at[E] < hi[D]"])


@query(
    'SELECT s_suppkey AS "S_piece", c_custkey AS "C_piece" FROM supplier JOIN customer ON s_acctbal < c_acctbal + 50 '
    "AND c_acctbal < s_acctbal + 50 AND s_nationkey < c_nationkey + 1 AND c_nationkey < s_nationkey + 2"
)
def map_ii_2d(spark, sf_dir):
    s = load(spark, sf_dir, "supplier", piece="s_suppkey", x_lo="s_acctbal", x_hi="s_acctbal + 50", n_lo="s_nationkey", n_hi="s_nationkey + 2")
    c = load(spark, sf_dir, "customer", piece="c_custkey", x_lo="c_acctbal", x_hi="c_acctbal + 50", n_lo="c_nationkey", n_hi="c_nationkey + 1")
    return mapping(
        {"S": s, "C": c}, ["S", "C"], ["x_lo[S] < x_hi[C]", "x_lo[C] < x_hi[S]", "n_lo[S] < n_hi[C]", "n_lo[C] < n_hi[S]"]
    )


@query(
    'SELECT a.event_id AS "A_piece", b.event_id AS "B_piece" FROM events a JOIN events b ON a.user_id = b.user_id '
    "AND epoch_us(a.ts) < epoch_us(b.ts) + 600000000 AND epoch_us(b.ts) < epoch_us(a.ts) + 600000000"
)
def map_pi_2d(spark, sf_dir):
    e = load(spark, sf_dir, "events", piece="event_id", u="user_id", lo=MICROS.format("ts"))
    e = e.withColumn("hi", F.col("lo") + 10 * MINUTE_US)
    return mapping({"A": e, "B": e}, ["A", "B"], ["u[A] == u[B]", "lo[A] < hi[B]", "lo[B] < hi[A]"])


def _parts(spark, sf_dir):
    return load(spark, sf_dir, "part", piece="p_partkey", s="p_size", s_hi="p_size + 5", k="p_partkey % 50", k_hi="p_partkey % 50 + 5")


def _quantities(spark, sf_dir):
    return load(spark, sf_dir, "lineitem", piece="cast(l_quantity AS long)").distinct().withColumns(
        {"lo": F.col("piece"), "hi": F.col("piece") + 1}
    )


_PARTS_SQL = (
    "WITH a AS (SELECT p_partkey AS piece, p_size AS s, p_size + 5 AS s_hi, p_partkey % 50 AS k, p_partkey % 50 + 5 AS k_hi FROM part), "
    "q AS (SELECT DISTINCT l_quantity::BIGINT AS piece FROM lineitem) "
)


@query(
    _PARTS_SQL + 'SELECT a.piece AS "A_piece", q.piece AS "B_piece" FROM a JOIN q ON s < k_hi AND k < s_hi '
    "AND s < q.piece + 1 AND q.piece < s_hi AND k < q.piece + 1 AND q.piece < k_hi"
)
def map_diag_ii_i(spark, sf_dir):
    return mapping(
        {"A": _parts(spark, sf_dir), "B": _quantities(spark, sf_dir)},
        ["A", "B"],
        ["s[A] < k_hi[A]", "k[A] < s_hi[A]", "s[A] < hi[B]", "lo[B] < s_hi[A]", "k[A] < hi[B]", "lo[B] < k_hi[A]"],
    )


@query(
    _PARTS_SQL + 'SELECT a.piece AS "A_piece", q.piece AS "B_piece" FROM a JOIN q ON s <= q.piece AND q.piece < s_hi '
    "AND k <= q.piece AND q.piece < k_hi"
)
def map_diag_ii_p(spark, sf_dir):
    return mapping(
        {"A": _parts(spark, sf_dir), "B": _quantities(spark, sf_dir)},
        ["A", "B"],
        ["s[A] <= lo[B]", "lo[B] < s_hi[A]", "k[A] <= lo[B]", "lo[B] < k_hi[A]"],
    )


@query(
    'SELECT c_custkey AS "C_piece", s_suppkey AS "S_piece", n_nationkey::BIGINT AS "N_piece" FROM customer '
    "JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON c_nationkey = n_nationkey"
)
def map_pp_triple_1d(spark, sf_dir):
    c = load(spark, sf_dir, "customer", piece="c_custkey", i="c_nationkey")
    s = load(spark, sf_dir, "supplier", piece="s_suppkey", i="s_nationkey")
    n = load(spark, sf_dir, "nation", piece="n_nationkey", i="n_nationkey")
    return mapping({"C": c, "S": s, "N": n}, ["C", "S", "N"], ["i[C] == i[S]", "i[C] == i[N]"])


@query(
    'SELECT a.l_orderkey * 10 + a.l_linenumber AS "A_piece", b.l_orderkey * 10 + b.l_linenumber AS "B_piece", '
    'c.l_orderkey * 10 + c.l_linenumber AS "C_piece" FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey '
    "AND a.l_suppkey = b.l_suppkey JOIN lineitem c ON a.l_partkey = c.l_partkey AND a.l_suppkey = c.l_suppkey"
)
def map_pp_triple_2d(spark, sf_dir):
    t = _lines(spark, sf_dir)
    where = ["p[A] == p[B]", "s[A] == s[B]", "p[A] == p[C]", "s[A] == s[C]"]
    return mapping({"A": t, "B": t, "C": t}, ["A", "B", "C"], where)


def _first_orders(spark, sf_dir) -> DataFrame:
    """Each customer's first 60 days, with the nation as a range."""
    o = load(spark, sf_dir, "orders", piece="o_custkey", d=day("o_orderdate")).groupBy("piece").agg(F.min("d").alias("lo"))
    c = load(spark, sf_dir, "customer", piece="c_custkey", n_lo="c_nationkey", n_hi="c_nationkey + 1")
    return o.withColumn("hi", F.col("lo") + 60).join(c, "piece")


def _quarters(spark, sf_dir) -> DataFrame:
    q = _months(spark, sf_dir).withColumn("q", F.expr("piece div 3"))
    return q.groupBy(F.col("q").alias("piece")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


FIRST_SQL = (
    "f AS (SELECT o_custkey AS piece, min(" + DAY_SQL.format("o_orderdate") + ") AS lo, any_value(c_nationkey) AS n FROM orders "
    "JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)"
)
QUARTERS_SQL = "quarters AS (SELECT piece // 3 AS piece, min(lo) AS lo, max(hi) AS hi FROM months GROUP BY piece // 3)"


@query(
    f"WITH {MONTHS_SQL}, {QUARTERS_SQL}, {FIRST_SQL} "
    'SELECT m.piece AS "M_piece", q.piece AS "Q_piece", f.piece AS "F_piece" FROM f JOIN months m ON f.lo < m.hi AND m.lo < f.lo + 60 '
    "JOIN quarters q ON f.lo < q.hi AND q.lo < f.lo + 60 AND m.lo < q.hi AND q.lo < m.hi"
)
def map_ii_triple_1d(spark, sf_dir):
    frames = {"M": _months(spark, sf_dir), "Q": _quarters(spark, sf_dir), "F": _first_orders(spark, sf_dir)}
    where = [f"lo[{a}] < hi[{b}]" for a in "MQF" for b in "MQF" if a != b]
    return mapping(frames, ["M", "Q", "F"], where)


@query(
    f"WITH {MONTHS_SQL}, {QUARTERS_SQL}, {FIRST_SQL}, "
    "mr AS (SELECT piece * 100 + r_regionkey AS piece, lo, hi, r_regionkey * 5 AS n_lo, r_regionkey * 5 + 5 AS n_hi FROM months, region), "
    "qn AS (SELECT piece * 100 + n_nationkey AS piece, lo, hi, n_nationkey AS n_lo, n_nationkey + 1 AS n_hi FROM quarters, nation) "
    'SELECT m.piece AS "M_piece", q.piece AS "Q_piece", f.piece AS "F_piece" FROM f JOIN mr m ON f.lo < m.hi AND m.lo < f.lo + 60 '
    "AND n < m.n_hi AND m.n_lo < n + 1 JOIN qn q ON f.lo < q.hi AND q.lo < f.lo + 60 AND m.lo < q.hi AND q.lo < m.hi "
    "AND n < q.n_hi AND q.n_lo < n + 1 AND m.n_lo < q.n_hi AND q.n_lo < m.n_hi"
)
def map_ii_triple_2d(spark, sf_dir):
    r = load(spark, sf_dir, "region", r="r_regionkey")
    n = load(spark, sf_dir, "nation", n="n_nationkey")
    m = _months(spark, sf_dir).crossJoin(F.broadcast(r)).selectExpr("piece * 100 + r AS piece", "lo", "hi", "r * 5 AS n_lo", "r * 5 + 5 AS n_hi")
    q = _quarters(spark, sf_dir).crossJoin(F.broadcast(n)).selectExpr("piece * 100 + n AS piece", "lo", "hi", "n AS n_lo", "n + 1 AS n_hi")
    where = [f"{x}lo[{a}] < {x}hi[{b}]" for x in ("", "n_") for a in "MQF" for b in "MQF" if a != b]
    return mapping({"M": m, "Q": q, "F": _first_orders(spark, sf_dir)}, ["M", "Q", "F"], where)


@query(
    'SELECT 0::BIGINT AS "B_piece", l_orderkey * 10 + l_linenumber AS "L_piece" FROM lineitem '
    "WHERE l_quantity < 16 AND l_extendedprice < 16000 AND l_quantity >= 0 AND l_extendedprice >= 0"
)
def map_box(spark, sf_dir):
    box = spark.createDataFrame([(0, 0.0, 16.0, 0.0, 16000.0)], "piece long, x_lo double, x_hi double, y_lo double, y_hi double")
    points = load(spark, sf_dir, "lineitem", piece="l_orderkey * 10 + l_linenumber", x="l_quantity", y="l_extendedprice")
    return mapping(
        {"B": box, "L": points}, ["B", "L"], ["x_lo[B] <= x[L]", "x[L] < x_hi[B]", "y_lo[B] <= y[L]", "y[L] < y_hi[B]"], "theta"
    )


@query(
    'SELECT o_orderkey AS "O_piece", l_orderkey * 10 + l_linenumber AS "L_piece" FROM orders JOIN lineitem ON o_orderkey = l_orderkey '
    f"AND {DAY_SQL.format('o_orderdate')} < {DAY_SQL.format('l_shipdate')} + 7 "
    f"AND {DAY_SQL.format('l_shipdate')} < {DAY_SQL.format('o_orderdate')} + 90"
)
def map_bio(spark, sf_dir):
    o = load(spark, sf_dir, "orders", piece="o_orderkey", c="o_orderkey", lo=day("o_orderdate"), hi=f"{day('o_orderdate')} + 90")
    s = load(spark, sf_dir, "lineitem", piece="l_orderkey * 10 + l_linenumber", c="l_orderkey", lo=day("l_shipdate"), hi=f"{day('l_shipdate')} + 7")
    return mapping({"O": o, "L": s}, ["O", "L"], ["c[O] == c[L]", "lo[O] < hi[L]", "lo[L] < hi[O]"])


@query(
    "WITH w AS (SELECT a * 9 + b * 3 + c AS piece, a - 1 AS x, b - 1 AS y, c - 1 AS z FROM range(3) r(a), range(3) s(b), range(3) t(c)) "
    'SELECT s_suppkey AS "M_piece", p_partkey AS "I_piece", piece AS "W_piece" FROM supplier, part, w '
    "WHERE p_size >= s_suppkey % 50 + x - 0.5 AND p_size < s_suppkey % 50 + x + 0.5 "
    "AND p_partkey % 100 >= s_nationkey * 4 + y - 0.5 AND p_partkey % 100 < s_nationkey * 4 + y + 0.5 "
    "AND floor(p_retailprice - 900) >= floor(s_acctbal / 100) + z - 0.5 AND floor(p_retailprice - 900) < floor(s_acctbal / 100) + z + 0.5"
)
def map_ptcloud(spark, sf_dir):
    """Points of one cloud at 27 offsets from points of another, in three dimensions."""
    m = load(spark, sf_dir, "supplier", piece="s_suppkey", x="s_suppkey % 50", y="s_nationkey * 4", z="floor(s_acctbal / 100)")
    i = load(spark, sf_dir, "part", piece="p_partkey", x="p_size", y="p_partkey % 100", z="floor(p_retailprice - 900)")
    w = spark.range(27).selectExpr(
        "id AS piece", *[f"(id div {9 // 3**k}) % 3 - 1.5D AS {d}_lo" for k, d in enumerate("xyz")], *[f"(id div {9 // 3**k}) % 3 - 0.5D AS {d}_hi" for k, d in enumerate("xyz")]
    )
    where = [p for d in "xyz" for p in (f"{d}[I] >= {d}[M] + {d}_lo[W]", f"{d}[I] < {d}[M] + {d}_hi[W]")]
    return mapping({"M": m, "W": w, "I": i}, ["M", "I", "W"], where)


def _small(spark, sf_dir):
    n = load(spark, sf_dir, "nation", piece="n_nationkey", k="n_nationkey", r="n_regionkey")
    return n, load(spark, sf_dir, "region", piece="r_regionkey", k="r_regionkey")


@query('SELECT n_nationkey::BIGINT AS "N_piece", r_regionkey::BIGINT AS "R_piece" FROM nation, region WHERE n_nationkey < r_regionkey')
def map_ineq(spark, sf_dir):
    n, r = _small(spark, sf_dir)
    return mapping({"N": n, "R": r}, ["N", "R"], ["k[N] < k[R]"])


@query('SELECT n_nationkey::BIGINT AS "N_piece", r_regionkey::BIGINT AS "R_piece" FROM nation, region WHERE n_regionkey <> r_regionkey')
def map_ne(spark, sf_dir):
    n, r = _small(spark, sf_dir)
    return mapping({"N": n, "R": r}, ["N", "R"], ["r[N] != k[R]"])


@query(
    'SELECT a.n_nationkey::BIGINT AS "A_piece", b.n_nationkey::BIGINT AS "B_piece" FROM nation a, nation b '
    "WHERE 2 * a.n_nationkey - 1 = b.n_nationkey + 3 AND a.n_nationkey / (b.n_regionkey + 1) < -b.n_regionkey + 10"
)
def map_arith(spark, sf_dir):
    n, _ = _small(spark, sf_dir)
    return mapping({"A": n, "B": n}, ["A", "B"], ["2 * k[A] - 1 == k[B] + 3", "k[A] / (r[B] + 1) < -r[B] + 10"])


@query('SELECT a.n_nationkey::BIGINT AS "A_piece", b.n_nationkey::BIGINT AS "B_piece" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey')
def map_selfjoin(spark, sf_dir):
    n, _ = _small(spark, sf_dir)
    return mapping({"A": n, "B": n}, ["A", "B"], ["r[A] == r[B]"])


@query('SELECT n_nationkey::BIGINT AS "N_piece" FROM nation WHERE n_nationkey <= n_regionkey * 5')
def map_one_axis(spark, sf_dir):
    n, _ = _small(spark, sf_dir)
    return mapping({"N": n}, ["N"], ["k[N] <= r[N] * 5"])


@query('SELECT p_partkey AS "P_piece", q AS "Q_piece" FROM part JOIN (SELECT DISTINCT l_quantity::BIGINT AS q FROM lineitem) ON p_size = q')
def map_reduce_pp_1d(spark, sf_dir):
    p = load(spark, sf_dir, "part", piece="p_partkey", k="p_size")
    q = load(spark, sf_dir, "lineitem", piece="cast(l_quantity AS long)").distinct().withColumn("k", F.col("piece"))
    return mapping({"P": p, "Q": q}, ["P", "Q"], ["k[P] == k[Q]"])


@query(
    "WITH e AS (SELECT event_id, epoch_us(ts) AS t FROM events), d AS (SELECT DISTINCT t // 86400000000 AS piece FROM e) "
    'SELECT event_id AS "E_piece", piece AS "D_piece" FROM e JOIN d ON t < (piece + 1) * 86400000000 '
    "AND piece * 86400000000 < t + 3600000000"
)
def map_reduce_ii_1d(spark, sf_dir):
    e = load(spark, sf_dir, "events", piece="event_id", lo=MICROS.format("ts"))
    d = e.select(F.expr(f"lo div {DAY_US}").alias("piece")).distinct()
    d = d.withColumns({"lo": F.col("piece") * DAY_US, "hi": (F.col("piece") + 1) * DAY_US})
    return mapping({"E": e.withColumn("hi", F.col("lo") + 60 * MINUTE_US), "D": d}, ["E", "D"], ["lo[E] < hi[D]", "lo[D] < hi[E]"])


@query('SELECT l_orderkey * 10 + l_linenumber AS "L_piece", p_partkey AS "P_piece" FROM lineitem JOIN part ON l_partkey = p_partkey')
def map_matmul_pp(spark, sf_dir):
    p = load(spark, sf_dir, "part", piece="p_partkey", k="p_partkey")
    lines = load(spark, sf_dir, "lineitem", piece="l_orderkey * 10 + l_linenumber", k="l_partkey")
    return mapping({"L": lines, "P": p}, ["L", "P"], ["k[L] == k[P]"])


@query(
    f"WITH {MONTHS_SQL}, {QUARTERS_SQL}, {ORDERS_SQL} "
    'SELECT o.piece AS "O_piece", q.piece AS "Q_piece" FROM o JOIN quarters q ON d < q.hi AND q.lo < d + 1'
)
def map_matmul_ii(spark, sf_dir):
    frames = {"O": _orders(spark, sf_dir, 1), "Q": _quarters(spark, sf_dir)}
    return mapping(frames, ["O", "Q"], ["lo[O] < hi[Q]", "lo[Q] < hi[O]"])


# --- contraction -----------------------------------------------------------------------------------------------------


def swept(pieces_sql: str, names: tuple[str, str] = ("i_lo", "i_hi"), by: str = "") -> str:
    """SQL for the disjoint form of ranges that overlap: running sums of what starts and ends at each breakpoint."""
    key, part, ref = (f"{by}, ", f"PARTITION BY {by} ", f"{by}, ") if by else ("", "", "")
    return f"""WITH {pieces_sql},
delta AS (SELECT {key}lo AS b, value AS v FROM p UNION ALL SELECT {key}hi, -value FROM p),
step AS (SELECT {key}b, sum(v) AS v FROM delta GROUP BY {ref}b),
run AS (SELECT {key}b, lead(b) OVER ({part}ORDER BY b) AS e, sum(v) OVER ({part}ORDER BY b) AS v FROM step)
SELECT {key}b AS {names[0]}, e AS {names[1]}, v::BIGINT AS value FROM run WHERE e IS NOT NULL AND v <> 0"""


def cells(t: PieceTable) -> DataFrame:
    """An output's coordinates and value."""
    return t.df.select(*dict.fromkeys(c for a in t.axes for c in a.columns), F.col(t.value).cast("long").alias("value"))


RANGE, DOT = (lambda n: Axis("[)", f"{n}_lo", f"{n}_hi")), (lambda n: Axis("P", f"{n}_at"))


def _order_days(spark, sf_dir, length: int = 1) -> DataFrame:
    """Orders by day and nation: i = [day, day + length), j = nation."""
    o = load(spark, sf_dir, "orders", c="o_custkey", i_lo=day("o_orderdate"))
    c = load(spark, sf_dir, "customer", c="c_custkey", j_at="c_nationkey")
    return counted(o.join(c, "c"), "i_lo", "j_at").withColumn("i_hi", F.col("i_lo") + length)


def _month_axis(spark, sf_dir, value: str = "piece % 12 + 1") -> PieceTable:
    m = _months(spark, sf_dir).select("piece", F.col("lo").alias("i_lo"), F.col("hi").alias("i_hi"), F.expr(value).alias("value"))
    return pieces(m, [RANGE("i")], "piece")


def _nation_axis(spark, sf_dir) -> PieceTable:
    n = load(spark, sf_dir, "nation", piece="n_nationkey", j_at="n_nationkey", value="n_regionkey + 1")
    return pieces(n, [DOT("j")], "piece")


_DAYS_SQL = f"od AS (SELECT {DAY_SQL.format('o_orderdate')} AS d, c_nationkey AS n, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
# A day lies in one month, so a piece of a day with a month is that day, cut where the month ends.
_DAYS_BY_MONTH = "FROM od JOIN months ON d < hi AND lo < d + {k}"


def _flag(k: int, value: str) -> str:
    return (
        f"{MONTHS_SQL}, {_DAYS_SQL}, p AS (SELECT greatest(d, lo) AS lo, least(d + {k}, hi) AS hi, {value} AS value "
        + _DAYS_BY_MONTH.format(k=k)
        + ")"
    )


@query(swept(_flag(3, "c * (piece % 12 + 1) * (n_regionkey + 1)").replace("FROM od JOIN", "FROM od JOIN nation ON n = n_nationkey JOIN")))
def con_ij_i_j__i(spark, sf_dir):
    """Flagship: orders by day and nation, times months, times nations, summed to disjoint days."""
    t = pieces(_order_days(spark, sf_dir, 3), [RANGE("i"), DOT("j")], ("i_lo", "j_at"))
    return cells(contract("ij,i,j->i", t, _month_axis(spark, sf_dir), _nation_axis(spark, sf_dir)))


@query(swept(_flag(3, "c * (piece % 12 + 1)").replace("c_nationkey AS n, ", "0 AS n, ")))
def con_i_i__i(spark, sf_dir):
    t = counted(load(spark, sf_dir, "orders", i_lo=day("o_orderdate")), "i_lo").withColumn("i_hi", F.col("i_lo") + 3)
    return cells(contract("i,i->i", pieces(t, [RANGE("i")], "i_lo"), _month_axis(spark, sf_dir)))


@query(
    "WITH a AS (SELECT c_nationkey AS i, count(*) AS v FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS i, count(*) AS v "
    "FROM supplier GROUP BY ALL) SELECT i AS i_at, (a.v * b.v)::BIGINT AS value FROM a JOIN b USING (i)"
)
def con_p_p__p(spark, sf_dir):
    a = counted(load(spark, sf_dir, "customer", i_at="c_nationkey"), "i_at")
    b = counted(load(spark, sf_dir, "supplier", i_at="s_nationkey"), "i_at")
    return cells(contract("i,i->i", pieces(a, [DOT("i")], "i_at"), pieces(b, [DOT("i")], "i_at")))


@query(
    "WITH a AS (SELECT c_nationkey AS i, count(*) AS v FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS i, count(*) AS v "
    "FROM supplier GROUP BY ALL) SELECT i AS i_at, (a.v * b.v * (n_regionkey + 1))::BIGINT AS value FROM a JOIN b USING (i) JOIN nation ON i = n_nationkey"
)
def con_i_i_i__i(spark, sf_dir):
    a = counted(load(spark, sf_dir, "customer", i_at="c_nationkey"), "i_at")
    b = counted(load(spark, sf_dir, "supplier", i_at="s_nationkey"), "i_at")
    return cells(contract_algebra("y(i) = A(i) * B(i) * N(i)", {"A": pieces(a, [DOT("i")], "i_at"), "B": pieces(b, [DOT("i")], "i_at"), "N": _nation_axis(spark, sf_dir)}))


@query(
    f"WITH {MONTHS_SQL}, o AS (SELECT DISTINCT {DAY_SQL.format('o_orderdate')} AS d FROM orders) "
    'SELECT greatest(d, lo) AS i_lo, least(d, hi) AS i_hi, (piece % 12 + 1)::BIGINT AS value FROM o JOIN months ON d <= hi AND lo <= d'
)
def con_closed_touch(spark, sf_dir):
    """Closed ranges of no length meet the closed ends of months: nothing overlaps in length, so nothing is merged."""
    d = load(spark, sf_dir, "orders", i_lo=day("o_orderdate")).distinct().withColumns({"i_hi": F.col("i_lo"), "value": F.lit(1)})
    m = _month_axis(spark, sf_dir)
    closed = [Axis("[]", "i_lo", "i_hi")]
    return cells(contract("i,i->i", pieces(d, closed, "i_lo"), PieceTable(m.df, tuple(closed), m.value, m.piece)))


@query(
    "SELECT l_quantity::BIGINT AS i_lo, l_quantity::BIGINT + 1 AS i_hi, sum(l_linenumber)::BIGINT AS value FROM lineitem GROUP BY ALL"
)
def con_ij_j__i(spark, sf_dir):
    a = counted(load(spark, sf_dir, "lineitem", i_lo="cast(l_quantity AS long)", j_at="l_linenumber"), "i_lo", "j_at")
    a = a.withColumn("i_hi", F.col("i_lo") + 1)
    b = load(spark, sf_dir, "lineitem", piece="l_linenumber", j_at="l_linenumber", value="l_linenumber").distinct()
    return cells(contract("ij,j->i", pieces(a, [RANGE("i"), DOT("j")], ("i_lo", "j_at")), pieces(b, [DOT("j")], "piece")))


@query(
    f"WITH {MONTHS_SQL}, od AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS j, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey) "
    "SELECT n AS i_at, j // 3 AS k_lo, j // 3 + 1 AS k_hi, count(*)::BIGINT AS value FROM od GROUP BY ALL"
)
def con_ij_jk__ik(spark, sf_dir):
    """Orders by nation and month, times months by quarter."""
    o = load(spark, sf_dir, "orders", c="o_custkey", j_at="year(o_orderdate) * 12 + month(o_orderdate) - 1")
    c = load(spark, sf_dir, "customer", c="c_custkey", i_at="c_nationkey")
    a = counted(o.join(c, "c"), "i_at", "j_at")
    b = _months(spark, sf_dir).selectExpr("piece", "piece AS j_at", "piece div 3 AS k_lo", "piece div 3 + 1 AS k_hi", "1 AS value")
    return cells(contract("ij,jk->ik", pieces(a, [DOT("i"), DOT("j")], ("i_at", "j_at")), pieces(b, [DOT("j"), RANGE("k")], "piece")))


@query(
    f"WITH {MONTHS_SQL}, {QUARTERS_SQL}, a AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, c_nationkey AS n, count(*) AS v "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT months.lo AS i_lo, months.hi AS i_hi, n AS j_at, "
    "(a.v * (n_regionkey + 1))::BIGINT AS value FROM a JOIN months ON m = months.piece JOIN quarters q ON months.piece // 3 = q.piece JOIN nation ON n = n_nationkey"
)
def con_ij_ij__ij(spark, sf_dir):
    o = load(spark, sf_dir, "orders", c="o_custkey", piece="cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS long)")
    c = load(spark, sf_dir, "customer", c="c_custkey", j_at="c_nationkey")
    m = _months(spark, sf_dir).select("piece", F.col("lo").alias("i_lo"), F.col("hi").alias("i_hi"))
    a = counted(o.join(c, "c"), "piece", "j_at").join(m, "piece")
    n = load(spark, sf_dir, "nation", j_at="n_nationkey", value="n_regionkey + 1")
    b = _quarters(spark, sf_dir).select("piece", F.col("lo").alias("i_lo"), F.col("hi").alias("i_hi")).crossJoin(F.broadcast(n))
    axes = [RANGE("i"), DOT("j")]
    return cells(contract("ij,ij->ij", pieces(a, axes, ("piece", "j_at")), pieces(b, axes, ("piece", "j_at"))))


@query(
    "SELECT l_quantity::BIGINT AS i_lo, l_quantity::BIGINT + 1 AS i_hi, p_size AS j_lo, p_size + 1 AS j_hi, sum(l_linenumber)::BIGINT AS value "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
)
def con_ijk_k__ij(spark, sf_dir):
    """Lines by quantity, part size and line number, times line numbers."""
    p = load(spark, sf_dir, "part", p="p_partkey", j_lo="p_size")
    a = load(spark, sf_dir, "lineitem", p="l_partkey", i_lo="cast(l_quantity AS long)", k_at="l_linenumber").join(p, "p")
    a = counted(a, "i_lo", "j_lo", "k_at").withColumns({"i_hi": F.col("i_lo") + 1, "j_hi": F.col("j_lo") + 1})
    b = load(spark, sf_dir, "lineitem", piece="l_linenumber", k_at="l_linenumber", value="l_linenumber").distinct()
    return cells(contract("ijk,k->ij", pieces(a, [RANGE("i"), RANGE("j"), DOT("k")], ("i_lo", "j_lo", "k_at")), pieces(b, [DOT("k")], "piece")))


@query(
    swept(
        "e AS (SELECT epoch_us(ts) AS t FROM events), d AS (SELECT DISTINCT t // 86400000000 AS k FROM e), "
        "p AS (SELECT greatest(t, k * 86400000000) AS lo, least(t + 300000000, (k + 1) * 86400000000) AS hi, 1 AS value FROM e JOIN d "
        "ON t < (k + 1) * 86400000000 AND k * 86400000000 < t + 300000000)"
    )
)
def con_ij_i__i_coalesce(spark, sf_dir):
    """Five minutes from each event, by kind, within days; summed where they overlap."""
    e = load(spark, sf_dir, "events", piece="event_id", i_lo=MICROS.format("ts"), j_at="pmod(hash(event_type), 1000)")
    a = e.withColumns({"i_hi": F.col("i_lo") + 5 * MINUTE_US, "value": F.lit(1)})
    d = e.select(F.expr(f"i_lo div {DAY_US}").alias("piece")).distinct()
    d = d.withColumns({"i_lo": F.col("piece") * DAY_US, "i_hi": (F.col("piece") + 1) * DAY_US, "value": F.lit(1)})
    return cells(contract("ij,i->i", pieces(a, [RANGE("i"), DOT("j")], "piece"), pieces(d, [RANGE("i")], "piece")))


@query("SELECT sum(a.c * b.c)::BIGINT AS value FROM (SELECT c_nationkey n, count(*) c FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey n, count(*) c FROM supplier GROUP BY 1) b USING (n) HAVING count(*) > 0")
def con_scalar(spark, sf_dir):
    a = counted(load(spark, sf_dir, "customer", i_at="c_nationkey"), "i_at")
    b = counted(load(spark, sf_dir, "supplier", i_at="s_nationkey"), "i_at")
    return cells(contract("i,i->", pieces(a, [DOT("i")], "i_at"), pieces(b, [DOT("i")], "i_at")))


@query("SELECT n_nationkey AS i_at, n_regionkey AS j_at, 1::BIGINT AS value FROM nation")
def con_transpose(spark, sf_dir):
    n = load(spark, sf_dir, "nation", piece="n_nationkey", j_at="n_regionkey", i_at="n_nationkey", value="1")
    return cells(contract("ji->ij", pieces(n, [DOT("j"), DOT("i")], "piece")))


@query(swept("p AS (SELECT p_size AS lo, p_size + 5 AS hi, count(*) AS value FROM part GROUP BY ALL)"))
def con_project(spark, sf_dir):
    """One operand: the dropped index is summed away, and overlapping ranges are merged."""
    p = load(spark, sf_dir, "part", i_lo="p_size", j_at="p_partkey % 100")
    p = counted(p, "i_lo", "j_at").withColumn("i_hi", F.col("i_lo") + 5)
    return cells(contract("ij->i", pieces(p, [RANGE("i"), DOT("j")], ("i_lo", "j_at"))))


@query(
    swept(
        "g AS (SELECT p_size AS a, p_partkey % 50 AS b, count(*) AS value FROM part GROUP BY ALL), "
        "p AS (SELECT greatest(a, b) AS lo, least(a + 5, b + 5) AS hi, value FROM g WHERE a < b + 5 AND b < a + 5)"
    )
)
def con_diag(spark, sf_dir):
    p = load(spark, sf_dir, "part", i_lo="p_size", k_lo="p_partkey % 50")
    p = counted(p, "i_lo", "k_lo").withColumns({"i_hi": F.col("i_lo") + 5, "k_hi": F.col("k_lo") + 5})
    return cells(contract("ii->i", pieces(p, [RANGE("i"), RANGE("k")], ("i_lo", "k_lo"))))


# --- coalescing, sources and sinks -----------------------------------------------------------------------------------


@query(swept("p AS (SELECT epoch_us(ts) // 60000000 AS lo, epoch_us(ts) // 60000000 + 30 AS hi, count(*) AS value FROM events GROUP BY ALL)"))
def coalesce_1d(spark, sf_dir):
    e = counted(load(spark, sf_dir, "events", i_lo=f"{MICROS.format('ts')} div {MINUTE_US}"), "i_lo").withColumn("i_hi", F.col("i_lo") + 30)
    return cells(coalesce(pieces(e, [RANGE("i")], "i_lo")))


@query(
    "WITH p AS (SELECT p_size AS x, floor(p_retailprice - 900)::BIGINT // 4 AS y, count(*) AS value FROM part GROUP BY ALL), "
    "bx AS (SELECT DISTINCT unnest([x, x + 3]) AS b FROM p), by_ AS (SELECT DISTINCT unnest([y, y + 2]) AS b FROM p), "
    "cx AS (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM bx), cy AS (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM by_) "
    "SELECT cx.lo AS x_lo, cx.hi AS x_hi, cy.lo AS y_lo, cy.hi AS y_hi, sum(value)::BIGINT AS value FROM cx, cy, p "
    "WHERE x <= cx.lo AND cx.hi <= x + 3 AND y <= cy.lo AND cy.hi <= y + 2 GROUP BY ALL HAVING sum(value) <> 0"
)
def coalesce_2d(spark, sf_dir):
    p = counted(load(spark, sf_dir, "part", x_lo="p_size", y_lo="floor(p_retailprice - 900) div 4"), "x_lo", "y_lo")
    p = p.withColumns({"x_hi": F.col("x_lo") + 3, "y_hi": F.col("y_lo") + 2})
    return cells(coalesce(pieces(p, [RANGE("x"), RANGE("y")], ("x_lo", "y_lo"))))


@query("SELECT l_quantity::BIGINT AS i_lo, l_quantity::BIGINT + 1 AS i_hi, count(*)::BIGINT AS value FROM lineitem GROUP BY ALL")
def coalesce_noop(spark, sf_dir):
    q = counted(load(spark, sf_dir, "lineitem", i_lo="cast(l_quantity AS long)"), "i_lo").withColumn("i_hi", F.col("i_lo") + 1)
    return cells(coalesce(pieces(q, [RANGE("i")], "i_lo")))


@query(
    "WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events) SELECT count(*) > 0 AS overlap FROM "
    "(SELECT t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e) WHERE gap < 60000000"
)
def overlap_found(spark, sf_dir):
    e = load(spark, sf_dir, "events", piece="event_id", i_lo=MICROS.format("ts"), j_at="user_id", value="1")
    e = e.withColumn("i_hi", F.col("i_lo") + MINUTE_US)
    return overlap_exists(pieces(e, [RANGE("i"), DOT("j")], "piece"))


@query("SELECT DISTINCT l_quantity::BIGINT AS piece, l_quantity::BIGINT AS i_lo, l_quantity::BIGINT + 1 AS i_hi, 1 AS value FROM lineitem WHERE l_quantity NOT IN (SELECT p_size FROM part WHERE p_retailprice > 999)")
def insert_free(spark, sf_dir):
    """Unit ranges of quantities that share nothing with the unit ranges of the sizes of dear parts."""
    new = load(spark, sf_dir, "lineitem", piece="cast(l_quantity AS long)").distinct()
    held = load(spark, sf_dir, "part", piece="cast(p_size AS long)", price="p_retailprice").where("price > 999").select("piece").distinct()
    tables = [pieces(d.selectExpr("piece", "piece AS i_lo", "piece + 1 AS i_hi", "1 AS value"), [RANGE("i")], "piece") for d in (new, held)]
    return insert_guard(*tables)


@query("SELECT round(x.lo0, 3) AS lo0, round(x.hi0, 3) AS hi0, round(x.v, 6) AS value FROM (VALUES (0.0::DOUBLE, 2.5::DOUBLE, 1.0::DOUBLE), (1.25, 0.0, 0.0), (0.0, 3.0, 4.0)) x(lo0, hi0, v)")
def rows_codec(spark, sf_dir):
    """Editable rows with blanks to pieces and back."""
    return to_rows(from_rows(spark, [{"lo0": "", "hi0": "2.5"}, {"lo0": 1.25, "hi0": None, "value": ""}, {"hi0": 3, "value": "4"}], ["[)"]))


@query("SELECT 1.0::DOUBLE AS lo0, 2.0::DOUBLE AS hi0, 20.0::DOUBLE AS value UNION ALL SELECT 6.0, 7.0, 60.0")
def rows_contract(spark, sf_dir):
    a = [{"lo0": 0, "hi0": 2, "value": 2}, {"lo0": 5, "hi0": 7, "value": 3}]
    b = [{"lo0": 1, "hi0": 3, "value": 10}, {"lo0": 6, "hi0": 8, "value": 20}]
    out = contract_rows(spark, "i,i->i", [a, b], [["[)"], ["[)"]])
    return to_rows(PieceTable(out.df.withColumnsRenamed({"i_lo": "lo0", "i_hi": "hi0"}), (Axis("[)", "lo0", "hi0"),), "value", ("lo0",)))


@query()
def synth_boxes(spark, sf_dir):
    """Generated boxes: hash-based, so the same for any partitioning; SQL has no such generator."""
    return synth_pieces(spark, 10_000, ["[)", "P"], [64.0, 64.0], 0.5, 11).df
