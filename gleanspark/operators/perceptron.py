"""A perceptron over terms.

One pass in document order is sequential by nature: ranges of documents follow one another, each in one task that gets
what was learned before. To scale out, train() splits the rows by a hash into `shards` such streams
and averages their weights term by term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from itertools import batched, count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bags
from ..functions import text as T
from ..sources.cuts import shared_dir, written
from . import index

#: The step of an update and the range of first weights.
STEP = 0.7
RANGE = 0.3
#: Bytes of packed documents that one task of a stream reads (about 12 a term of a document), terms whose keys a task remembers, keys in a row of what was learned.
CHUNK_BYTES = 128 << 20
KNOWN = 1_000_000
LEARNED_ROWS = 500_000


def first_weight(term: str) -> float:
    """A weight in [-RANGE, RANGE) from a hash of the term."""
    return -RANGE + 2 * RANGE * int(hashlib.md5(term.encode()).hexdigest()[:8], 16) / 2**32


def first_weight_column(term: Column) -> Column:
    return -F.lit(RANGE) + F.lit(2 * RANGE) * F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _packed(rows: DataFrame, salt: int) -> DataFrame:
    """(stream, doc_id, label, tie, base, keys, counts): a document as its terms' keys and counts, with its total by first weights."""
    spread = RANGE

    def run(batches):
        known: dict[bytes, tuple[int, float]] = {}
        for batch in batches:
            keys, counts, first, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                n = bags.counted(text)
                for t in n:
                    if t not in known:
                        known[t] = _key(t, salt, spread)
                mine = [known[t] for t in n]
                keys.append(np.array([k for k, _ in mine], np.uint64).tobytes())
                counts.append(np.array(list(n.values()), np.int32).tobytes())
                first.append(sum(w * c for (_, w), c in zip(mine, n.values())))
                if len(known) > KNOWN:
                    known.clear()
            kept = [batch.column(c) for c in ("stream", "doc_id", "label", "tie")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first, pa.float64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["stream", "doc_id", "label", "tie", "base", "keys", "counts"])

    kind = rows.select("stream", "doc_id", "label", "tie").schema
    return rows.mapInArrow(run, kind.add("base", "double").add("keys", "binary").add("counts", "binary"))


def _key(term: bytes, salt: int, spread: float) -> tuple[int, float]:
    """64 bits of a hash of the term, and its first weight."""
    digest = hashlib.md5(term).digest()
    key = hashlib.md5(term + b"\0%d" % salt).digest() if salt else digest
    return int.from_bytes(key[:8], "big"), -spread + 2 * spread * int.from_bytes(digest[:4], "big") / 2**32


def _keyed_terms(rows: DataFrame, salt: int) -> DataFrame:
    """(stream, term, key), distinct. A task sends a term once for some thousands of documents."""
    spread = RANGE

    def run(batches):
        for batch in batches:
            met: dict[int, dict[bytes, None]] = {}
            for stream, text in zip(batch.column("stream").to_pylist(), batch.column("text").to_pylist()):
                met.setdefault(stream, {}).update(bags.counted(text))
            for stream, terms in met.items():
                for some in batched(terms, 50_000):
                    keys = np.array([_key(t, salt, spread)[0] for t in some], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([stream] * len(some), pa.int32()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(keys)], names=["stream", "term", "key"])

    return rows.select("stream", "text").mapInArrow(run, "stream int, term string, key long").distinct()


def _pass(rows: DataFrame, compat: bool) -> DataFrame:
    """(stream, kind, keys, counts) of what each stream has learned after these rows: by key, how many steps a term's weight is off the first.

    rows are sorted by stream and kind: first what was learned before (kind 0, keys ascending), then documents in order.
    """
    size = LEARNED_ROWS

    def learned(state: list, docs: list) -> tuple[np.ndarray, np.ndarray]:
        old = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in state] or [np.zeros(0, np.uint64)])
        steps = np.concatenate([np.frombuffer(c, np.int64) for _, c in state] or [np.zeros(0, np.int64)])
        ends = np.cumsum([0] + [len(d[2]) // 8 for d in docs])
        terms, of = np.unique(np.frombuffer(b"".join(d[2] for d in docs), np.uint64), return_inverse=True)
        at = np.searchsorted(old, terms)
        hit = np.zeros(len(terms), bool)
        hit[at < len(old)] = old[at[at < len(old)]] == terms[at < len(old)]
        now = np.zeros(len(terms), np.int64)
        now[hit] = steps[at[hit]]
        for i, (base, label, _, counts) in enumerate(docs):
            mine, n = of[ends[i] : ends[i + 1]], np.frombuffer(counts, np.int32)
            said = 1 if base + STEP * float(now[mine] @ n) > 0 else -1
            if compat or said != label:
                now[mine] -= said * n.astype(np.int64)
        kept = np.ones(len(old), bool)
        kept[at[hit]] = False
        keys, steps = np.concatenate([old[kept], terms[now != 0]]), np.concatenate([steps[kept], now[now != 0]])
        order = np.argsort(keys)
        return keys[order], steps[order]

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("stream", "kind", "base", "label", "keys", "counts")))

        for stream, part in groupby(each(), key=lambda r: r[0]):
            state, docs = [], []
            for _, kind, base, label, keys, counts in part:
                if kind:
                    docs.append((base, label, keys, counts))
                else:
                    state.append((keys, counts))
            keys, steps = learned(state, docs)
            for i in range(0, max(1, len(keys)), size):
                row = [pa.array([stream], pa.int32()), pa.array([i // size], pa.int32()), pa.array([keys[i : i + size].tobytes()], pa.binary()), pa.array([steps[i : i + size].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["stream", "place", "keys", "counts"])

    return rows.mapInArrow(run, "stream int, place int, keys binary, counts binary")


def _steps(learned: DataFrame) -> DataFrame:
    """(stream, key, steps), a row for each term that learning moved."""

    def run(batches):
        for b in batches:
            for stream, keys, counts in zip(*(b.column(c).to_pylist() for c in ("stream", "keys", "counts"))):
                k, n = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), stream, np.int32)), pa.array(k), pa.array(n)], names=["stream", "key", "steps"])

    return learned.select("stream", "keys", "counts").mapInArrow(run, "stream int, key long, steps long")


def train(docs: DataFrame, compat: bool = False, shards: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text, label) -> (term, weight).

    A weight is the first one and a whole number of steps, and steps are what a stream hands on. Documents are packed where they are read, dealt into ranges of about chunk_bytes
    in order, and each range is one job, with a task for each stream that reads its range and the steps so far. So what a task
    reads and holds doesn't grow with the documents, only their number of jobs.
    """
    index.require(docs, "doc_id", "text", "label")
    folder = shared_dir(docs.sparkSession)
    stream = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % shards
    whole = docs.where(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("int").alias("label"), stream.cast("int").alias("stream"))
    # Rows that are equal in id and label are taken in the order of their terms; where there are none, terms needn't travel.
    ties = not whole.groupBy("doc_id", "label").count().where("count > 1").isEmpty()
    tie = F.transform(T.raw_tokens(F.col("text")), T.normalize) if ties else F.lit(None).cast("array<string>")
    rows = whole.select("stream", "doc_id", "label", tie.alias("tie"), F.col("text").cast("binary").alias("text"))
    for salt in count():
        terms = written(_keyed_terms(rows, salt), folder)
        if terms.groupBy("stream", "key").count().where("count > 1").isEmpty():
            break  # no two terms of a stream have one key
    packed = written(_packed(rows, salt), folder)
    size = F.octet_length("keys") + F.octet_length("counts") + F.coalesce(F.octet_length(F.array_join("tie", " ")), F.lit(0)) + 32
    total = packed.agg(F.sum(size.cast("long"))).first()[0] or 0
    ranged = packed.repartitionByRange(max(1, -(-total // chunk_bytes)), "stream", "doc_id", "label").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, folder, "part")
    parts: dict[int, list[int]] = {}
    for r in ranged.select("stream", "part").distinct().orderBy("part").collect():
        parts.setdefault(r.stream, []).append(r.part)
    columns = ["stream", "kind", "doc_id", "label", "tie", "base", "keys", "counts"]
    learned: dict[int, DataFrame] = {}
    for i in range(max(map(len, parts.values()), default=0)):
        active = {s: ps[i] for s, ps in parts.items() if i < len(ps)}
        mine = F.lit(False)
        for s, p in active.items():
            mine = mine | ((F.col("stream") == s) & (F.col("part") == p))
        now = ranged.where(F.col("part").isin(sorted(set(active.values()))) & mine).withColumn("kind", F.lit(1)).select(columns)
        if i:
            before = learned[next(iter(active))].where(F.col("stream").isin(list(active)))
            # place stands where documents have their label: state has its own order.
            now = now.unionByName(before.select("stream", F.lit(0).alias("kind"), F.col("place").alias("label"), "keys", "counts"), allowMissingColumns=True).select(columns)
        done = written(_pass(now.repartitionById(shards, F.col("stream")).sortWithinPartitions("stream", "kind", "doc_id", "label", "tie"), compat), folder)
        learned |= dict.fromkeys(active, done)
    weight = first_weight_column(F.col("term"))
    if learned:
        # A stream's steps are those of the last job it was in.
        last: dict[int, tuple[DataFrame, list[int]]] = {}
        for s, df in learned.items():
            last.setdefault(id(df), (df, []))[1].append(s)
        moved = reduce(DataFrame.unionByName, [_steps(df.where(F.col("stream").isin(ss))) for df, ss in last.values()])
        terms = terms.join(moved, ["stream", "key"], "left")
        weight = weight + F.lit(STEP) * F.coalesce("steps", F.lit(0))
    got = terms.select("term", weight.alias("weight"))
    return got if shards == 1 else got.groupBy("term").agg(F.avg("weight").alias("weight"))


def _weighed(rows: DataFrame, weights: DataFrame | Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("weight", weights(F.col("term"))) if callable(weights) else rows.join(weights, "term")


def predict(docs: DataFrame, weights: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """(doc_id, total, label): 1 where the summed weights of all token occurrences are over 0, else -1; unknown terms weigh 0.

    weights are a table (term, weight), or what makes a weight of a term, which needs no join.
    """
    known = _weighed(index.bags(docs), weights).groupBy("doc_id").agg(F.sum(F.col("cnt") * F.col("weight")).alias("total"))
    all_ids = docs.select("doc_id").distinct()
    total = F.coalesce("total", F.lit(0.0))
    return all_ids.join(known, "doc_id", "left").select("doc_id", total.alias("total"), F.when(total > 0, 1).otherwise(-1).alias("label"))


def assign(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """docs with predicted_labels, to which the prediction is appended where the column exists."""
    said = predict(docs, weights).select("doc_id", F.array("label").alias("__said"))
    old = F.coalesce(F.col("predicted_labels"), F.array().cast("array<int>")) if "predicted_labels" in docs.columns else F.array().cast("array<int>")
    return docs.join(said, "doc_id").withColumn("predicted_labels", F.concat(old, "__said")).drop("__said")


def extreme(weights: DataFrame, n: int = 10, order: int = 1) -> DataFrame:
    """The n + 1 least weights (order 1), greatest (-1) or any (0, as they come); n of 0 or less means all."""
    by = weights if order == 0 else weights.orderBy(F.col("weight") if order == 1 else F.desc("weight"), "term")
    return by.limit(n + 1) if n > 0 else by


def with_df(weights: DataFrame | Callable[[Column], Column], vocabulary: DataFrame) -> DataFrame:
    return _weighed(vocabulary.select("term", "df"), weights).select("term", "weight", "df")
