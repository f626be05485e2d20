"""K-means by Lloyd steps over array columns, and over sparse bags of words.

points(id, x: array<double>). All steps are one job, whose tasks hold the points and exchange k x dimensions numbers a step.
"""

from __future__ import annotations

import secrets
import socket
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cuts import shared_dir, written

CLOSE = 1e-5
FIRST_RSS = 1e6
#: Points that a task takes at once.
BLOCK = 4096
#: Bytes of the word by which tasks of one clustering know each other, and seconds in which they must have found each other.
WORD, JOIN_S = 16, 120


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_scalar(a: Column, v: float) -> Column:
    return F.transform(a, lambda x: x + F.lit(float(v)))


def divide(a: Column, v: float) -> Column:
    return F.transform(a, lambda x: x / F.lit(float(v)))


def _literal(c: list[float]) -> Column:
    """One constant; the plan's code stays the same from step to step."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in c)})")


def _literals(centroids: list[list[float]]) -> Column:
    return F.array(*[_literal(c) for c in centroids])


def nearest(x: Column, centroids: list[list[float]]) -> Column:
    """struct(dist, cid) of the nearest centroid; of equals the lowest number."""
    options = [F.struct(distance(x, _literal(c)).alias("dist"), F.lit(i).alias("cid")) for i, c in enumerate(centroids)]
    return F.array_min(F.array(*options))


@dataclass
class KMeansModel:
    centroids: list[list[float]]
    #: The centroids that the last assignment was made with; members belong to these.
    assigned_with: list[list[float]]
    rss: float
    history: list[float]

    def assign(self, points: DataFrame) -> DataFrame:
        """(id, cid, dist): members of the last assignment, with their distance to the final centroids."""
        near = nearest(F.col("x"), self.assigned_with)["cid"]
        return points.select("id", near.alias("cid"), "x").select("id", "cid", distance(F.col("x"), F.element_at(_literals(self.centroids), F.col("cid") + 1)).alias("dist"))

    def centroid_rows(self, spark) -> DataFrame:
        rows = [(i, d, float(v)) for i, c in enumerate(self.centroids) for d, v in enumerate(c)]
        return spark.createDataFrame(rows, "cid int, dim int, v double")

    def closest(self, points: DataFrame, n: int | None = None) -> DataFrame:
        """(cid, rn, id, dist): members by distance to their centroid, the first n of each."""
        ordered = F.row_number().over(Window.partitionBy("cid").orderBy("dist", "id"))
        out = self.assign(points).select("cid", ordered.alias("rn"), "id", "dist")
        return out if n is None else out.where(F.col("rn") <= n)


def initial(points: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """Seed 0: the first k points by id; other seeds: k points by an MD5 of id and seed."""
    order = [F.col("id")] if seed == 0 else [F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), F.col("id")]
    got = [list(r.x) for r in points.orderBy(*order).limit(k).collect()]
    if len(got) < k:
        raise TypeError(f"{k} clusters need at least {k} points, got {len(got)}")
    return got


def _slots(spark) -> int:
    """How many tasks run side by side; a barrier stage of more would not start, whatever spark.default.parallelism says."""
    jvm = spark.sparkContext._jsc.sc()
    return max(1, min(spark.sparkContext.defaultParallelism, jvm.maxNumConcurrentTasks(jvm.resourceProfileManager().defaultResourceProfile())))


def _lloyd(points: DataFrame, starts: list[list[list[float]]], max_rounds: int | None) -> list[KMeansModel]:
    """A model for each start, all in one job.

    Its tasks run side by side (a barrier stage), keep their points in a file of their own, and after each step get the sums over all of
    them through the first task, so a step costs a message and no job, and every task comes to the same end. (Spark's own allGather answers
    once a second, so it only tells where the first task listens.) Place 0 of a cluster's row holds the summed distances to `now` of the members of `before`, 1 the number of members of `now`. A cluster without members keeps its centroid.
    """
    first, close, least = np.array(starts), CLOSE, FIRST_RSS

    def joined(context) -> list[socket.socket]:
        """Of the first task, connections to all others by their numbers; of another, the one to the first."""
        me, infos = context.partitionId(), context.getTaskInfos()
        server = socket.create_server(("", 0)) if me == 0 else None
        word = secrets.token_bytes(WORD)
        port, word = context.allGather(f"{server.getsockname()[1]} {word.hex()}" if server else "")[0].split()
        word = bytes.fromhex(word)
        if not server:
            peer = socket.create_connection((infos[0].address.rsplit(":", 1)[0], int(port)), timeout=JOIN_S)
            peer.sendall(word + me.to_bytes(4))
            peers = [peer]
        else:
            found: dict[int, socket.socket] = {}
            server.settimeout(JOIN_S)
            while len(found) < len(infos) - 1:
                peer, _ = server.accept()
                peer.settimeout(JOIN_S)
                said = received(peer, WORD + 4)
                if said[:WORD] == word:
                    found[int.from_bytes(said[WORD:])] = peer
                else:
                    peer.close()
            server.close()
            peers = [found[i] for i in sorted(found)]
        for peer in peers:
            peer.settimeout(None)
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return peers

    def received(peer: socket.socket, size: int) -> bytes:
        parts = bytearray()
        while len(parts) < size:
            if not (some := peer.recv(size - len(parts))):
                raise ConnectionError("another task of the clustering ended")
            parts += some
        return bytes(parts)

    def summed(peers: list[socket.socket], mine: np.ndarray) -> np.ndarray:
        """The sum over all tasks, which is the same in each."""
        if BarrierTaskContext.get().partitionId():
            peers[0].sendall(mine.tobytes())
            return np.frombuffer(received(peers[0], mine.nbytes)).reshape(mine.shape)
        total = sum((np.frombuffer(received(p, mine.nbytes)).reshape(mine.shape) for p in peers), mine)
        for p in peers:
            p.sendall(total.tobytes())
        return total

    def run(batches):
        context = BarrierTaskContext.get()
        s, k, dims = first.shape
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                column = batch.column(0)
                if len(flat := column.flatten()) != len(column) * dims:
                    raise ValueError("points differ in dimensions")
                file.write(flat.to_numpy(zero_copy_only=False).tobytes())
            file.flush()
            n = file.tell() // (8 * dims)
            x = np.memmap(file, np.float64, "r", shape=(n, dims)) if n else np.zeros((0, dims))
            cids = np.zeros((s, n), np.int32)

            def step(i: int, now: np.ndarray) -> np.ndarray:
                table = np.zeros((k, dims + 2))
                for at in range(0, n, BLOCK):
                    some = x[at : at + BLOCK]
                    far = np.empty((len(some), k))
                    for c in range(k):
                        gap = some - now[c]
                        far[:, c] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    was, cid = cids[i, at : at + BLOCK], far.argmin(axis=1)
                    table[:, 0] += np.bincount(was, weights=far[np.arange(len(some)), was], minlength=k)
                    table[:, 1] += np.bincount(cid, minlength=k)
                    table[:, 2:] += (cid == np.arange(k)[:, None]).astype(float) @ some
                    cids[i, at : at + BLOCK] = cid
                return table

            before, now, last = first.copy(), first.copy(), np.full(s, least)
            history: list[list[float]] = [[] for _ in range(s)]
            active, begun, peers = list(range(s)), False, joined(context)
            while active:
                mine = np.array([step(i, now[i]) for i in active])
                for i, t in zip(list(active), summed(peers, mine)):
                    rss, members = float(t[:, 0].sum()) / k, t[:, 1:2]
                    if begun:  # the first step has no members before it
                        history[i].append(rss)
                        if abs(last[i] - rss) < close or len(history[i]) == max_rounds:
                            active.remove(i)
                            continue
                        last[i] = rss
                    before[i], now[i] = now[i], np.where(members > 0, t[:, 2:] / np.maximum(members, 1), now[i])
                begun = True
            for peer in peers:
                peer.close()
            if context.partitionId() == 0:
                rows = zip(range(s), (v.ravel().tolist() for v in now), (v.ravel().tolist() for v in before), history)
                yield pa.RecordBatch.from_pydict(dict(zip(("start", "now", "before", "history"), map(list, zip(*rows)))))

    spark = points.sparkSession
    dealt = points.select("x").repartition(_slots(spark))
    found = dealt.mapInArrow(run, "start long, now array<double>, before array<double>, history array<double>", barrier=True).collect()
    shape = first.shape[1:]
    return [KMeansModel(np.reshape(r.now, shape).tolist(), np.reshape(r.before, shape).tolist(), r.history[-1], list(r.history)) for r in sorted(found, key=lambda r: r.start)]


def train_all(points: DataFrame, k: int, seeds: list[int], max_rounds: int | None = None) -> list[KMeansModel]:
    """For each seed, steps until the mean over clusters of summed distances changes by less than CLOSE (or max_rounds).

    The RSS of a step is known one step later, together with the next means.
    """
    # Points without a vector, or with a null in it, are nowhere: they are left out.
    whole = points.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    kept = whole.select("id", F.transform("x", lambda v: v.cast("double")).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        starts = [initial(kept, k, seed) for seed in seeds]
        dims = len(starts[0][0])
        if not kept.where(F.size("x") != dims).isEmpty():
            raise TypeError(f"all points need {dims} dimensions, as the first has")
        return _lloyd(kept, starts, max_rounds)
    finally:
        kept.unpersist()


def train(points: DataFrame, k: int, seed: int = 0, max_rounds: int | None = None) -> KMeansModel:
    return train_all(points, k, [seed], max_rounds)[0]


def best_of(points: DataFrame, k: int, seeds: int = 3) -> tuple[int, KMeansModel]:
    """(seed, model) with the least RSS of seeds 0..seeds-1, the first of equals."""
    models = enumerate(train_all(points, k, list(range(seeds))))
    return min(models, key=lambda m: (m[1].rss, m[0]))


def assign_sparse(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors(doc_id, dim, cnt), centroids(cid, dim, v) -> (doc_id, cid, dist), as |x|^2 - 2xc + |c|^2 in long form.

    A document meets only the centroids that share a dimension with it. Of all others the nearest is the one with the
    least |c|^2, and among these the one of least number, so a ranking of the centroids by |c|^2 (one row each, k of them) stands for
    the rest: the first that the document did not meet.
    """
    x2 = vectors.groupBy("doc_id").agg(F.sum(F.col("cnt") * F.col("cnt")).cast("double").alias("x2"))
    c2 = centroids.groupBy("cid").agg(F.sum(F.col("v") * F.col("v")).alias("c2"))
    dots = vectors.join(centroids.where("v <> 0"), "dim").groupBy("doc_id", "cid").agg(F.sum(F.col("cnt") * F.col("v")).alias("xc"))
    ranked = c2.agg(F.array_sort(F.collect_list(F.struct("c2", "cid"))).alias("all"))
    met = dots.join(c2, "cid").groupBy("doc_id").agg(F.collect_set("cid").alias("met"), F.min(F.struct((F.col("c2") - 2 * F.col("xc")).alias("gap"), "cid")).alias("near"))
    whole = x2.join(met, "doc_id", "left").withColumn("all", ranked.scalar())
    other = F.try_element_at(F.filter("all", lambda c: ~F.array_contains(F.coalesce("met", F.array().cast("array<int>")), c["cid"])), F.lit(1))
    rest = F.when(other.isNotNull(), F.struct(other["c2"].alias("gap"), other["cid"].alias("cid")))
    best = whole.withColumn("best", F.least("near", rest))
    return best.select("doc_id", F.col("best.cid").alias("cid"), F.sqrt(F.greatest(F.lit(0.0), F.col("x2") + F.col("best.gap"))).alias("dist"))


def train_sparse(vectors: DataFrame, k: int, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """Lloyd steps over bags of words: (assigned, centroids, history of the RSS), to convergence as in train().

    The first k documents by id begin. Centroids are rows (cid, dim, v) without zeros and stay a table, whatever the
    vocabulary; the driver holds one number a step. A step's tables are written to the shared folder, so no lineage grows.
    """
    folder = shared_dir(vectors.sparkSession)
    bags = written(vectors.select("doc_id", "dim", "cnt"), folder)
    ids = [r.doc_id for r in bags.select("doc_id").distinct().orderBy("doc_id").limit(k).collect()]
    if len(ids) < k:
        raise TypeError(f"{k} clusters need at least {k} documents, got {len(ids)}")
    number = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(ids) for x in (d, i)]), F.col("doc_id"))
    centroids = bags.where(F.col("doc_id").isin(ids)).select(number.alias("cid"), "dim", F.col("cnt").cast("double").alias("v"))
    last, history = FIRST_RSS, []
    while True:
        assigned = written(assign_sparse(bags, centroids), folder)
        size = assigned.groupBy("cid").agg(F.count("*").alias("n"))
        sums = bags.join(assigned.select("doc_id", "cid"), "doc_id").groupBy("cid", "dim").agg(F.sum("cnt").alias("s"))
        moved = sums.join(size, "cid").select("cid", "dim", (F.col("s") / F.col("n")).alias("v"))
        moved = written(moved.unionByName(centroids.join(size.select("cid"), "cid", "left_anti")), folder)
        # |x - c| to the moved centroid of a document's own cluster.
        x2 = bags.groupBy("doc_id").agg(F.sum(F.col("cnt") * F.col("cnt")).cast("double").alias("x2"))
        c2 = moved.groupBy("cid").agg(F.sum(F.col("v") * F.col("v")).alias("c2"))
        own = bags.join(assigned.select("doc_id", "cid"), "doc_id").join(moved, ["cid", "dim"]).groupBy("doc_id", "cid").agg(F.sum(F.col("cnt") * F.col("v")).alias("xc"))
        dist = own.join(x2, "doc_id").join(c2, "cid").select(F.sqrt(F.greatest(F.lit(0.0), F.col("x2") - 2 * F.col("xc") + F.col("c2"))).alias("d"))
        rss = (dist.agg(F.sum("d").alias("s")).first().s or 0.0) / k
        history.append(rss)
        if abs(last - rss) < CLOSE or len(history) == max_rounds:
            return assigned, moved, history
        last, centroids = rss, moved
