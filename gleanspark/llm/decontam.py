"""Benchmark decontamination as a prefix-filtered set join with exact, item-sized windows.

A window is `size` consecutive words of an item (all words of a shorter one). The elements of the join are
shingles of SHINGLE words (a shorter window is one shingle). They are ordered by rarity over the whole corpus.
A window that occurs in a text occurs with all its shingles, so its rarest one is its necessary prefix, and
an equi-join on that shingle's hash makes the candidates. The positional bound places the window (the
shingle's offset fixes the start), the length bound drops starts that leave no room, and the words
around the shingle are compared with the window word for word.

Both sides are tables; the driver holds no benchmark. Texts are read twice: once to count the benchmark's
shingles, once for the places of prefix shingles. A bitmap of shingle hashes, of a size bounded by MAX_BITS,
keeps other shingles from being exchanged; what passes it by chance finds no partner in the join. Texts
are never exchanged, only places with at most 2 * size - 1 words around them.

Defined cases: null and wordless texts have no words and no hits; a wordless item has no window; items
with the same words all count; a null item_id has no name and is left out of n_items and the digest;
rows that repeat an item_id are one item; rows that repeat a doc_id, or are equal, are reported one by one. Long
texts are read whole, in memory linear in one text. Further columns of either table are not looked at. Empty
tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cut, kind_of, map_arrow

SIZE = 10
SHINGLE = 3
#: Bits of the bitmap for each benchmark shingle, and the most that it has: 64 MB, sent to each executor once.
BITS_EACH, LEAST_BITS, MAX_BITS = 32, 1 << 20, 1 << 29
#: Code points that separate words, in ASCII: all but digits and letters. Beyond ASCII none does.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Hasher:
    """64-bit hashes of the shingles of a list of words; hashes of words are remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, w: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > 300_000:
            known.clear()
        for x in set(w).difference(known):
            known[x] = digest(x)
        return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))

    def shingles(self, h: np.ndarray, k: int) -> np.ndarray:
        """Of every k words in a row, from their hashes."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = h[:n] * _FACTORS[0]
        for i in range(1, k):
            total = (total ^ (total >> np.uint64(29))) * _FACTORS[1] + h[i : i + n] * _FACTORS[2]
        return total ^ (total >> np.uint64(32))


def _windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, w, size, shingles) of every window; w is its words, joined by spaces."""
    known = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(x.as_py())
                n, k = min(size, len(w)), min(size, len(w), SHINGLE)
                if not n:
                    continue
                h = hasher.shingles(hasher.words(w), k).view(np.int64)
                starts = range(len(w) - n + 1)
                for at in range(0, len(starts), 4096):
                    part = starts[at : at + 4096]
                    yield pa.RecordBatch.from_pydict({
                        "item_id": pa.array([name] * len(part), pa.string()),
                        "w": [b" ".join(w[i : i + n]).decode() for i in part],
                        "size": pa.array([n] * len(part), pa.int32()),
                        "shingles": pa.array([h[i : i + n - k + 1] for i in part], pa.list_(pa.int64())),
                    })

    return known.mapInArrow(run, "item_id string, w string, size int, shingles array<long>")


def _place(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit(bits - 1))


def bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """The low bits of column h as one bitmap; its size follows n, up to MAX_BITS."""
    bits = LEAST_BITS
    while bits < min(MAX_BITS, BITS_EACH * n):
        bits *= 2
    place = _place(F.col("h"), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(one).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
    return out.view(np.uint8)


def _marked(bitmap_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h whose bit is set."""
    place = h & np.uint64(8 * len(bitmap_) - 1)
    return np.flatnonzero((bitmap_[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)


def counts(docs: DataFrame, shared, kinds: list[int], text_col: str = "text") -> DataFrame:
    """(h, n): how often each shingle that the bitmap holds occurs in all texts, summed in each task first."""

    def run(batches):
        hasher, count = Hasher(), {}

        def rows():
            out = pa.RecordBatch.from_pydict({"h": np.fromiter(count, np.uint64, len(count)).view(np.int64), "n": np.fromiter(count.values(), np.int64, len(count))})
            count.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                of = hasher.words(words(x.as_py()))
                for k in kinds:
                    h = hasher.shingles(of, k)
                    found, n = np.unique(h[_marked(shared.value, h)], return_counts=True)
                    for a, b in zip(found.tolist(), n.tolist()):
                        count[a] = count.get(a, 0) + b
            if len(count) > 200_000:
                yield rows()
        if count:
            yield rows()

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Benchmark:
    """Tables of a benchmark: prefixes(h, offset, size, w) and owners(item_id, w); and the bitmap of prefix shingles."""

    def __init__(self, docs: DataFrame, items: DataFrame, text_col: str = "text", size: int = SIZE):
        context = docs.sparkSession.sparkContext
        every = Cut(_windows(items, size))
        self.size = size
        self.owners = Cut(every.df.where("item_id is not null").select("item_id", "w").distinct())
        distinct = Cut(every.df.groupBy("w").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")))
        self.kinds = [r.k for r in distinct.df.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()]
        every.drop()
        places = distinct.df.select("w", "size", F.posexplode("shingles").alias("offset", "h"))
        n = distinct.df.agg(F.sum(F.size("shingles")).alias("n")).first().n or 0
        # Without a window there is nothing to count.
        known = Cut(counts(docs if n else docs.limit(0), context.broadcast(bitmap(places.select("h"), n)), self.kinds, text_col))
        rarest = places.join(known.df, "h", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset", "size")).alias("p"))
        # A window whose rarest shingle never occurs can't occur.
        self.prefixes = Cut(rarest.where("p.n > 0").select("w", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"), F.col("p.size").alias("size")))
        self.bitmap = context.broadcast(bitmap(self.prefixes.df.select("h"), self.prefixes.df.count()))
        known.drop()
        distinct.drop()

    def drop(self) -> None:
        self.owners.drop()
        self.prefixes.drop()


def _places(bench: Benchmark):
    """A function from a text to its number of words and the places of prefix shingles: (hash, position, words before, words around)."""
    hasher, reach = Hasher(), bench.size - 1
    shared, kinds = bench.bitmap, bench.kinds

    def of(text: bytes | None) -> tuple[int, list[dict]]:
        w = words(text)
        h, found = hasher.words(w), []
        for k in kinds:
            s = hasher.shingles(h, k)
            for i in _marked(shared.value, s).tolist():
                a = max(0, i - reach)
                found.append({"h": int(s[i].view(np.int64)), "pos": i, "before": i - a, "around": b" ".join(w[a : i + reach + 1]).decode()})
        return len(w), found

    return of


_PLACES = "array<struct<h:long,pos:int,before:int,around:string>>"


def _matches(places: DataFrame, bench: Benchmark) -> DataFrame:
    """places(row, n_words, h, pos, before, around) -> (row, start, size, w): windows that occur, compared word for word."""
    met = places.join(bench.prefixes.df, "h")
    skipped = F.col("before") - F.col("offset")
    bounded = met.where((skipped >= 0) & (F.col("pos") - F.col("offset") + F.col("size") <= F.col("n_words")))
    said = F.array_join(F.slice(F.split("around", " "), skipped + 1, F.col("size")), " ")
    return bounded.where(said == F.col("w")).select("row", (F.col("pos") - F.col("offset")).alias("start"), "size", "w")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs; items has item_id and text."""
    bench = Benchmark(docs, items, text_col, size)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    made: list = []

    def make(batch: pa.RecordBatch) -> list:
        if not made:
            made.append(_places(bench_))
        return [batch.column(0), *map(list, zip(*(made[0](x.as_py()) for x in batch.column(1))))]

    bench_ = _Light(bench)
    found = Cut(map_arrow(rows, f"doc_id {kind_of(docs, id_col)}, n_words long, places {_PLACES}", make).withColumn("row", F.monotonically_increasing_id()))
    hits = Cut(_matches(found.df.select("row", "n_words", F.inline("places")), bench))
    # Of the windows at a start the longest counts; positions of a row are summed as the parts that are new.
    longest = hits.df.groupBy("row", "start").agg(F.max("size").alias("size")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("s"))
    end = lambda acc, x: F.greatest(acc["upto"], x["start"] + x["size"])
    new = lambda acc, x: F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(acc["upto"], x["start"]))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda acc, x: F.struct((acc["n"] + new(acc, x)).alias("n"), end(acc, x).alias("upto")), lambda acc: acc["n"])
    n_hit = longest.select("row", covered.cast("long").alias("n_hit"))
    owners = hits.df.select("row", "w").distinct().join(bench.owners.df, "w").select("row", "item_id").distinct()
    named = owners.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("names"))
    report = Cut(n_hit.join(named, "row", "left"))
    hits.drop()
    bench.drop()
    names = F.coalesce("names", F.array().cast("array<string>"))
    whole = found.df.select("row", "doc_id", "n_words").join(report.df, "row", "left")
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


class _Light:
    """What tasks need of a benchmark."""

    def __init__(self, bench: Benchmark):
        self.size, self.kinds, self.bitmap = bench.size, bench.kinds, bench.bitmap


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of docs without a hit word; columns as in docs.

    Equal texts share their fate, so the contaminated texts are named by MD5; the planner broadcasts these names
    where their table, which is written and so of known size, is small.
    """
    bench = Benchmark(docs, items, text_col, size)
    bench_ = _Light(bench)
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        of = _places(bench_)
        for batch in batches:
            got = [(hashlib.md5(t).hexdigest(), *x) for t in (v.as_py() for v in batch.column(0)) if t is not None and (x := of(t))[1]]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got), arrow)], schema=arrow)

    from .common import to_arrow

    fields = docs.sparkSession.createDataFrame([], f"row string, n_words long, places {_PLACES}").schema
    arrow = to_arrow(fields)
    found = rows.mapInArrow(run, fields).select("row", "n_words", F.inline("places"))
    bad = Cut(_matches(found, bench).select(F.col("row").alias("__gs_md5")).distinct())
    bench.drop()
    return docs.join(bad.df, F.md5(F.col(text_col).cast("binary")) == F.col("__gs_md5"), "left_anti").select(*[docs[c] for c in docs.columns])
