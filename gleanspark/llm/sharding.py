"""Weighted rendezvous hashing of stable record keys, with DataFrame functions only.

A record goes to the shard with the highest score weight / -ln(u), u a uniform number from the MD5 of (key, shard).
The key and the shard weights alone decide. Scores of the old shards don't change when a shard is added,
so rows move into the new shard only, and about its share of them.

Slots number the rows of a shard without gaps, in the order of id, checksum and size. The small table (ids
and numbers, no texts) is range-partitioned by shard and that order, and at last by the row's own number, so
that no task orders a whole shard and even one row that is repeated without end is dealt over many tasks.

Defined cases: a null key is a key like any other; repeated keys share a shard and get slots of their
own; rows that are equal in id, checksum and size share a run of slots in any order; a null text has no bytes; a
weight must be positive. Long texts are hashed where they lie. Further columns are ignored by shards() and kept by
assign(), whose new column is renamed where the name is taken. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, free_name

SHARDS = 40


def _drawn(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1): the first 52 bits of an MD5."""
    said = F.concat(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")), F.lit(f":{shard}"))
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(float(weight)) / (-F.log(_drawn(key, shard)))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) weighted shards; equal scores go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    return -_best(key, weights)["shard"]


def _best(key: Column, weights: list[float]) -> Column:
    scored = [F.struct(_score(key, k, w).alias("score"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)]
    return F.array_max(F.array(*scored))


def assign(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, weights: list[float] | None = None, name: str = "shard") -> DataFrame:
    """docs with a column for the shard, row by row, no shuffle. Where docs has a column of that name, it stays and the new one is name_1, name_2, ..."""
    return docs.withColumn(free_name(docs, name), shard_of(F.col(id_col), weights or [1.0] * shards).cast("int"))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, weights: list[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law is "key"; grown_shard is the shard with one more of weight 1."""
    w = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    if min(w, default=0) <= 0:
        raise ValueError("every shard needs a positive weight")
    won = rows.withColumn("won", _best(F.col("doc_id"), w)).withColumn("more", _score(F.col("doc_id"), len(w), 1.0))
    shard = -F.col("won.shard")
    table = Cut(won.select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
        F.when(F.col("more") > F.col("won.score"), F.lit(len(w))).otherwise(shard).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("own"),
    ))
    dealt = table.df.repartitionByRange("shard", "doc_id", "text_crc32", "size", "own").sortWithinPartitions("shard", "doc_id", "text_crc32", "size", "own")
    # Written at once, so the ranges are drawn once; in a sorted partition the running number gives the order.
    numbered = Cut(dealt.select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.monotonically_increasing_id().alias("at")))
    table.drop()
    part = F.shiftright("at", 33).cast("int")
    pieces = numbered.df.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = pieces.select("shard", "part", (before - F.col("first")).alias("shift"))
    placed = numbered.df.withColumn("part", part).join(starts, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"), "grown_shard")
