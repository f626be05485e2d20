"""Incremental inverted index over a stream of documents.

Every micro-batch writes the counts of its own documents as a segment, so what a batch costs follows the batch
and not the index. FANOUT neighbouring segments of one level become one of the next level: a posting is
rewritten once a level, and levels grow with the logarithm of the number of batches. A reader sums segments.

Segments are named by level and by their first and last batch, and count only once complete. One that lies inside
a wider complete one is ignored, and removed later, so a batch or a merge that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index

SCHEMA = "term string, doc_id long, cnt long"
#: Segments of one level that are merged into one.
FANOUT = 8


class Segment(NamedTuple):
    level: int
    first: int
    last: int

    def holds(self, other: Segment) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


class IndexStream:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    def _of(self, segment: Segment) -> str:
        return f"{self.path}/index/{segment.level:02d}-{segment.first:012d}-{segment.last:012d}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self) -> list[Segment]:
        fs, top = self._fs(f"{self.path}/index")
        if not fs.exists(top):
            return []
        return [Segment(*map(int, s.getPath().getName().split("-"))) for s in fs.listStatus(top) if fs.exists(s.getPath().suffix("/_SUCCESS"))]

    def segments(self) -> list[Segment]:
        """Complete segments that no wider one holds, by batch."""
        found = self._complete()
        return sorted((s for s in found if not any(t.holds(s) for t in found)), key=lambda s: s.first)

    def _sum(self, segments: list[Segment]) -> DataFrame:
        """Postings of documents that stand in several segments add up; all others pass as they are. Reads the ids at once."""
        parts = [self.spark.read.schema(SCHEMA).parquet(self._of(s)) for s in segments]
        every = reduce(DataFrame.unionByName, parts)
        own, shared = index.apart(every, reduce(DataFrame.unionByName, [p.select("doc_id").distinct() for p in parts]))
        added = shared.groupBy("term", "doc_id").agg(F.sum("cnt").alias("cnt")) if shared is not None else None
        return index.together(own, added)

    def upsert(self, docs: DataFrame, batch: int) -> None:
        if any(s.level and s.first <= batch <= s.last for s in self._complete()):
            return  # run again, after its segment was merged
        counted = index.postings(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).select("term", "doc_id", "cnt")
        counted.write.mode("overwrite").parquet(self._of(Segment(0, batch, batch)))
        self._compact()

    def _compact(self) -> None:
        """Merges full levels from the lowest up. What a merge replaces stays until the next one, for readers that began before."""
        if len([s for s in self.segments() if s.level == 0]) < self.fanout:
            return
        found = self._complete()
        for s in found:
            if any(t.holds(s) for t in found):
                fs, p = self._fs(self._of(s))
                fs.delete(p, True)
        level = 0
        while len(same := [s for s in self.segments() if s.level == level]) >= self.fanout:
            self._sum(same).write.mode("overwrite").parquet(self._of(Segment(level + 1, same[0].first, same[-1].last)))
            level += 1

    def run(self, docs: DataFrame) -> None:
        """Takes in all that the stream has now."""
        query = docs.writeStream.foreachBatch(self.upsert).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def current(self) -> DataFrame:
        """(term, doc_id, cnt) over all batches so far."""
        now = self.segments()
        if not now:
            return self.spark.createDataFrame([], SCHEMA)
        return self._sum(now) if len(now) > 1 else self.spark.read.schema(SCHEMA).parquet(self._of(now[0]))
