"""SimHash near-duplicates by pivot distance tables.

Each text has a 64-bit fingerprint: a bit is 1 if it is set in over half the XXH64 values (seed 42) of
the text's word shingles, repeats included. Fingerprints link at two or fewer differing bits.

Every distinct fingerprint gets a row of a table, written once: its Hamming distances to PIVOTS reference
fingerprints. Two bounds follow from the triangle inequality:

* |d(p, x) - d(p, y)| <= d(x, y): a pair whose coordinates differ by more in any place is discarded. At most two
  changed bits leave two of four blocks of 16 bits equal, so six pairs of blocks are the cells of a fingerprint.
  Inside a cell candidates are joined on ranges of the first coordinate, then the greatest difference of the
  stored coordinates discards, most of the rest at the first comparison or the second, and survivors are verified.
* d(x, y) <= d(x, p) + d(p, y): in crowded cells, where pairs would grow with the square, the pivots are
  all points within one bit of a member. Members within one bit of the same pivot are linked, and two
  fingerprints within two bits always share such a pivot, so no link is lost and no pairs are made.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; fewer words than a shingle give one shingle of all words. Rows that repeat an id are one
document per fingerprint. A null id gets a fingerprint and the component of that fingerprint's
non-null documents (null if there are none). Ids keep their type. Long texts are read whole; further columns are
not looked at (near_duplicates) or kept (keep_one, in similar.py). An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cut, kind_of, map_arrow
from .components import smallest_reachable

#: Four blocks of offsets and one-bit pivots are exact for two bits, so this is no parameter.
MAX_BITS = 2
#: Cells with more members than this go through the near pivots in place of pairs.
CROWDED = 48
PIVOTS = tuple(xxhash.xxh64_intdigest(b"pivot %d" % i, seed=42) for i in range(16))
BLOCK = 16
#: Two coordinates that differ by MAX_BITS lie in one range or in neighbouring ones.
RANGE = MAX_BITS + 1
_CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `shingle` words, repeats included; of all words where there are fewer."""
    joined = b" ".join(words)
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, 42)] if n else [], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - shingle])]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, n - shingle + 1)


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed long of the same 64 bits."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def make(batch: pa.RecordBatch) -> list:
        got = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
        return [batch.column(0), pa.array(got.view(np.int64))]

    return map_arrow(rows, f"doc_id {kind_of(docs, id_col)}, fp long", make)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


_COORDINATES = [f"d{i}" for i in range(len(PIVOTS))]


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps(fp, rid) with d0, d1, ...: the distance to each pivot."""
    return fps.select("fp", "rid", *[_distance(F.col("fp"), p).cast("byte").alias(d) for d, p in zip(_COORDINATES, PIVOTS)])


def cells(table: DataFrame) -> DataFrame:
    """The rows of the table in six cells each, one for every two of four blocks of the fingerprint."""
    block = lambda i: F.shiftrightunsigned("fp", BLOCK * i).bitwiseAND(F.lit((1 << BLOCK) - 1))
    # A cell is its two blocks and their numbers: 37 bits, so nothing is hashed.
    keys = [F.lit(4 * i + j) * F.lit(1 << 32) + block(i) * F.lit(1 << 16) + block(j) for i in range(4) for j in range(i + 1, 4)]
    return table.select(F.explode(F.array(*keys)).alias("cell"), *table.columns)


def links(fps: DataFrame) -> tuple[DataFrame, list[Cut]]:
    """fps(fp, rid), distinct in both -> links (a, b) between rids; the cuts must outlive the result."""
    table = Cut(cells(pivot_table(fps)))
    counts = table.df.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    live = Cut(table.df.join(counts, "cell"))
    table.drop()
    few = live.df.where(F.col("n") <= CROWDED).withColumn("range", F.floor(F.col("d0") / RANGE).cast("int"))
    side = lambda t, s: t.select("cell", "range", *[F.col(c).alias(c + s) for c in ("fp", "rid", *_COORDINATES)])
    left = side(few, "a").withColumn("range", F.explode(F.array(F.col("range"), F.col("range") + 1)))
    met = left.join(side(few, "b"), ["cell", "range"])
    # Pairs of one range meet in both orders, pairs of neighbouring ranges in one.
    met = met.where((F.floor(F.col("d0a") / RANGE) < F.floor(F.col("d0b") / RANGE)) | ((F.floor(F.col("d0a") / RANGE) == F.floor(F.col("d0b") / RANGE)) & (F.col("fpa") < F.col("fpb"))))
    for d in _COORDINATES:
        met = met.where(F.abs(F.col(d + "a") - F.col(d + "b")) <= MAX_BITS)
    pairs = met.where(F.bit_count(F.col("fpa").bitwiseXOR(F.col("fpb"))) <= MAX_BITS).select(F.col("rida").alias("a"), F.col("ridb").alias("b"))
    many = live.df.where(F.col("n") > CROWDED).select("fp", "rid").distinct()
    one_bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), s)))
    points = many.select("rid", F.explode(F.concat(F.array("fp"), one_bit)).alias("point"))
    # At most 65 fingerprints lie within one bit of a point, so the gathered list is bounded.
    balls = points.groupBy("point").agg(F.collect_list("rid").alias("rids")).where(F.size("rids") > 1)
    stars = balls.select(F.explode("rids").alias("a"), F.array_min("rids").alias("b")).where("a <> b")
    return pairs.unionByName(stars), [live]


def components(fps: DataFrame) -> Cut:
    """fps(doc_id, fp) -> Cut of (fp, component_id) with a row for each distinct fingerprint."""
    reps = Cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rid")))
    edges, held = links(reps.df.where("rid is not null"))
    roots = smallest_reachable(edges)
    for cut in held:
        cut.drop()
    out = Cut(reps.df.join(roots.df.withColumnRenamed("node", "rid"), "rid", "left").select("fp", F.coalesce("root", "rid").alias("component_id")))
    reps.drop()
    roots.drop()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: smallest id reachable over links, itself included.
    """
    prints = Cut(fingerprints(docs, id_col, text_col, shingle))
    classes = components(prints.df)
    hex16 = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.df.join(classes.df, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")
