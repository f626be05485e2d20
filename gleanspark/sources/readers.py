"""Document sources and index sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs of this many partitions (8 GB where these are of the usual 128 MB) are never dealt out anew.
SMALL = 64
DOC_SCHEMA = "doc_id string, text string, author_id string, timestamp string, labels array<int>"


def from_rows(spark: SparkSession, rows: Iterable[dict] | dict | None) -> DataFrame:
    """Documents in memory: one dict, many, or None for none. Ids keep their type."""
    if rows is None:
        rows = []
    if isinstance(rows, dict):
        rows = [rows]
    rows = list(rows)
    if any(not isinstance(r, dict) or "text" not in r for r in rows):
        raise TypeError("a document is a dict with doc_id and text")
    kind = "long" if rows and all(isinstance(r.get("doc_id"), int) for r in rows) else "string"
    data = [(r.get("doc_id", "0"), r["text"], r.get("author_id"), r.get("timestamp"), r.get("labels")) for r in rows]
    return spark.createDataFrame(data, DOC_SCHEMA.replace("doc_id string", f"doc_id {kind}"))


def generated(spark: SparkSession, n: int, words: int = 60, vocabulary: int = 5000, seed: int = 0) -> DataFrame:
    """n made-up documents (doc_id, text) for tests of scale, made where they are read; equal for equal arguments.

    Words are drawn with falling frequency: the square of a uniform number times the vocabulary.
    """
    draw = lambda i: F.xxhash64(F.col("doc_id"), i, F.lit(seed))
    u = lambda i: F.shiftrightunsigned(draw(i), 11).cast("double") / F.lit(2.0**53)
    word = lambda i: F.concat(F.lit("w"), F.floor(u(i) * u(i) * vocabulary).cast("string"))
    return spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ").alias("text"))


def parquet_docs(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return spark.read.parquet(path).withColumnsRenamed({id_col: "doc_id", text_col: "text"})


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out once where it arrives in fewer partitions than there are cores.

    A file of one row group is read by one task however many cores there are; tokenizing in that task would
    leave the others idle. Only inputs of under SMALL partitions are ever dealt out, into as many as there are cores and
    SMALL at most, so the texts of a large input are not shuffled on any cluster. Rows are the same either way.
    """
    cores = min(SMALL, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated label and text -> (doc_id, text, label, labels); pos is 1, neg is -1, ids follow the file's order."""
    raw = spark.read.csv(path, sep="\t", schema="said string, text string", quote="")
    label = F.when(F.col("said") == "pos", 1).when(F.col("said") == "neg", -1)
    return _numbered(raw).select("doc_id", "text", label.alias("label"), F.array(label).alias("labels"))


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated tweets without quoting; the fourth field is skipped."""
    raw = spark.read.csv(path, sep="\t", quote="", schema="timestamp string, doc_id string, author_id string, skipped string, text string")
    return raw.drop("skipped")


def _numbered(df: DataFrame) -> DataFrame:
    """doc_id 0, 1, ... in file order: counts of the partitions first, then places inside them."""
    at = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count("*").alias("__n"))
    from pyspark.sql import Window

    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(starts), "__part").withColumn("doc_id", F.col("__start") + inside).drop("__at", "__part", "__n", "__start")


def write_index(table: DataFrame, path: str, by: Column | str | None = None, mode: str = "overwrite") -> None:
    """An index table as Parquet, clustered by a column where one is given."""
    (table.repartition(by) if by is not None else table).write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
