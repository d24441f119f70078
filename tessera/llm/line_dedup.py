"""Line dedup (native): levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, max_doc), bucketed and sorted by both hashes, so that a batch is merge-joined with
each run without a shuffle of the run. A key that no run holds (the anti-join) gets a row of its own; a key that some
run holds gets a row with the counts so far, so a key's newest row has its largest counts. When a level has more than
``fan`` runs they are merged into one run of the next level.

Defined cases: a null or empty text is one empty line. Rows that repeat a doc_id are one document when documents are
counted, and each row keeps its own lines. Rows with a null doc_id aren't counted and lose no line. An empty table gives no
rows. Of several documents that hold a line the largest doc_id keeps it, there are no ties. Very long texts are read whole.
Columns other than the two named ones are carried, but for input columns named like an output column (n_lines, n_dropped,
kept_text), which are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut, prepare, remove, table, work_path

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: A static table is added to the runs in so many batches of documents.
BATCHES = 4
#: From so many dropped keys on, a document's keys are looked up by parts of their hashes.
MANY = 64
SHARE = 1e-3
PARTS = 1024


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) of each line whose key is long enough; the two hashes have 96 bits together."""
    key = df.select(F.col(doc_id).alias("doc_id"), F.explode(lines_of(F.col(text))).alias("line")).where(
        F.char_length("line") >= min_chars
    ).select("doc_id", line_key(F.col("line")).alias("key"))
    return key.where(F.char_length("key") >= min_chars).select(
        "doc_id", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")
    )


class LineRuns:
    """The levelled runs under one folder. ``levels[k]`` lists the tables of level k, newest last."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, fan: int = 3):
        self.spark, self.fan = spark, fan
        self.root = root or work_path(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.repartition(self.buckets, "h1", "h2")
            .write.format("parquet")
            .option("path", f"{self.root}/level{level}/{name}")
            .bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def merged(self) -> DataFrame | None:
        """One row for each key of all runs: the largest counts are the newest."""
        names = [n for level in self.levels for n in level]
        if not names:
            return None
        runs = [self.spark.table(n) for n in names]
        if len(runs) == 1:
            return runs[0]
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.max("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch of whole documents as a run: (doc_id, h1, h2) rows, repeats included."""
        per_doc = hashes.where(F.col("doc_id").isNotNull()).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        own = per_doc.groupBy("h1", "h2").agg(F.sum("one").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        old_n, old_max = [F.lit(0).cast("long")], []
        for k, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias(f"n{k}"), F.col("max_doc").alias(f"m{k}"))
            own = own.join(run.hint("merge"), ["h1", "h2"], "left")
            old_n.append(F.col(f"n{k}"))
            old_max.append(F.col(f"m{k}"))
        if old_max:
            own = own.select(
                "h1",
                "h2",
                (F.col("n_docs") + F.greatest(*old_n)).alias("n_docs"),
                F.greatest("max_doc", *old_max).alias("max_doc"),
            )
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) > self.fan:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges all runs of a level into one of the next."""
        olds, self.levels[level] = self.levels[level], []
        runs = [self.spark.table(n) for n in olds]
        union = runs[0]
        for r in runs[1:]:
            union = union.unionByName(r)
        self._write(
            union.groupBy("h1", "h2").agg(F.max("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc")), level + 1
        )
        for n in olds:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            remove(self.spark, f"{self.root}/level{level}/{n}")

    def drop(self) -> None:
        """Forgets and deletes all runs."""
        for name in (n for level in self.levels for n in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []
        remove(self.spark, self.root)

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, max_doc) of the keys in at least min_docs documents."""
        return self.merged().where(F.col("n_docs") >= min_docs)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    runs: LineRuns | None = None,
    batches: int = BATCHES,
) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text added: a line whose key has at least min_chars code points and is in
    at least min_docs documents stays only in the largest doc_id that holds it.

    ``batches`` deals the documents out by doc_id and adds them to the runs one after the other."""
    spark = docs.sparkSession
    own = runs is None
    runs = runs or LineRuns(spark)
    prepare(spark)
    hashes = cut(line_hashes(docs, doc_id, text, min_chars), "line-hashes")
    try:
        for k in range(batches):
            runs.add(hashes if batches == 1 else hashes.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
        repeated = cut(runs.repeated(min_docs), "repeated-lines")
    finally:
        if own:
            runs.drop()
    total = repeated.agg(F.sum("n_docs").alias("s")).first()["s"] or 0
    # A key with a share of SHARE or more of all occurrences would fill a partition; there are at most 1 / SHARE of them.
    hot = F.col("n_docs") >= max(1.0, total * SHARE)
    few = F.broadcast(repeated.where(hot).select("h1", "h2", "max_doc"))
    rest = repeated.where(~hot).select("h1", "h2", "max_doc")
    keys = ["h1", "h2"]
    drops = (
        hashes.join(few, keys)
        .unionByName(hashes.join(few, keys, "left_anti").join(rest, keys))
        .where(F.col("doc_id") < F.col("max_doc"))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.collect_set("h1").alias("__drop"))
    )
    many = F.transform(
        F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.filter("__drop", lambda d: F.pmod(d, F.lit(PARTS)) == p)
    )
    joined = docs.join(drops, docs[doc_id] == drops["__id"], "left").withColumn(
        "__many", F.when(F.size("__drop") > MANY, many)
    )

    def stays(line: Column) -> Column:
        h = F.xxhash64(line_key(line))
        there = F.when(
            F.col("__many").isNotNull(), F.array_contains(F.get("__many", F.pmod(h, F.lit(PARTS)).cast("int")), h)
        ).otherwise(F.array_contains("__drop", h))
        return ~((F.char_length(line) >= min_chars) & there)

    lines = lines_of(F.col(text))
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, stays))
    out = joined.withColumn("__kept", kept)
    return out.select(
        *[docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")],
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("__kept")).cast("long").alias("n_dropped"),
        F.array_join("__kept", "\n").alias("kept_text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


OP5_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, coalesce(doc_id < top, false) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
