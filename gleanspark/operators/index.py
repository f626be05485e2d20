"""Inverted and document indexes as plain tables.

postings(term, doc_id, cnt, first_pos, tf) and vocab(term, df, idf, first_at) are DataFrames; nothing
gathers a posting list into one row unless asked for. A document's repeats of a term meet where its text is read, and
only documents that share an id are exchanged to add up; of the others' terms a task sends what a vocabulary needs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import bags as B
from ..functions import text as T

#: Ids that documents share are broadcast up to this number; beyond it all documents are exchanged. Documents that a task turns into rows at once, and terms of greatest df whose places are broadcast.
MOST_SHARED = 1_000_000
AT_ONCE = 500
FREQUENT = 100_000


def require(docs: DataFrame, *columns: str) -> DataFrame:
    """docs, or a TypeError where it is no DataFrame with these columns."""
    if not isinstance(docs, DataFrame):
        raise TypeError(f"expected a DataFrame of documents, got {type(docs).__name__}")
    missing = [c for c in columns if c not in docs.columns]
    if missing:
        raise TypeError(f"documents lack the columns {missing}")
    return docs


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term), a row for each token."""
    require(docs, "doc_id", "text")
    return docs.select("doc_id", F.posexplode(T.raw_tokens(F.col("text"))).alias("pos", "raw")).select("doc_id", "pos", T.normalize(F.col("raw")).alias("term"))


def bags(docs: DataFrame, first: int | None = None) -> DataFrame:
    """(term, doc_id, cnt, first_pos), a row for each term of a row of docs; documents that repeat an id do not add up here.

    With first, a term's rows past the first few by id of an Arrow batch are left out: they are not among the first of all.
    """
    require(docs, "doc_id", "text")
    most = AT_ONCE

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if first is not None:
                order = pc.array_sort_indices(ids, null_placement="at_start")
                ids, texts = ids.take(order), texts.take(order)
            seen: Counter = Counter()
            for i in range(0, len(ids), most):
                terms, counts, places, sizes = [], [], [], []
                for text in texts.slice(i, most).to_pylist():
                    n, at = B.placed(text)
                    if first is not None:
                        n = {t: c for t, c in n.items() if seen[t] < first}
                        at = {t: at[t] for t in n}
                        seen.update(n.keys())
                    terms += n
                    counts += n.values()
                    places += at.values()
                    sizes.append(len(n))
                own = ids.slice(i, most).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                columns = [pa.array(terms, pa.binary()).cast(pa.string()), own, pa.array(counts, pa.int64()), pa.array(places, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "cnt", "first_pos"])

    kind = StructType([StructField("term", StringType()), docs.select("doc_id").schema[0], StructField("cnt", LongType()), StructField("first_pos", IntegerType())])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, kind)


def apart(docs: DataFrame, once: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Documents with an id of their own and those that share one, each None where there are none. Reads the ids at once.

    Shared ids beyond MOST_SHARED are no longer told apart: then all documents count as sharing theirs. Ids are shared that
    repeat in once where it is given, else in docs.
    """
    ids = (docs if once is None else once).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__shared"))
    found = ids.limit(MOST_SHARED + 1).count()
    if not found:
        return docs, None
    if found > MOST_SHARED:
        return None, docs
    same = F.col("doc_id").eqNullSafe(F.col("__shared"))
    return tuple(docs.join(F.broadcast(ids), same, how) for how in ("left_anti", "left_semi"))


def together(own: DataFrame | None, shared: DataFrame | None) -> DataFrame:
    return own.unionByName(shared) if own is not None and shared is not None else own if own is not None else shared


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "doc_id").agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"))


def postings(docs: DataFrame, use_tfidf: bool = True, first: int | None = None) -> DataFrame:
    """(term, doc_id, cnt, first_pos, tf); documents that repeat an id add up. With first, at least the first few of each term by id."""
    require(docs, "doc_id", "text")
    own, shared = apart(docs)
    rows = together(bags(own, first) if own is not None else None, _added(bags(shared)) if shared is not None else None)
    return rows.withColumn("tf", T.tf(F.col("cnt")) if use_tfidf else F.lit(0.0))


def total_docs(docs: DataFrame) -> Column:
    """The number of document rows, repeats included, as a scalar subquery."""
    return docs.agg(F.count("*")).scalar()


def vocab(posts: DataFrame, docs: DataFrame, use_tfidf: bool = True) -> DataFrame:
    """(term, df, idf, first_at); first_at falls in the order of first appearance: id down, place up."""
    counted = posts.groupBy("term").agg(F.count("*").alias("df"), F.max(F.struct(F.col("doc_id"), (-F.col("first_pos")).alias("back"))).alias("first_at"))
    return counted.select("term", "df", (T.idf(F.col("df"), total_docs(docs)) if use_tfidf else F.lit(0.0)).alias("idf"), "first_at")


def _met(docs: DataFrame, places: bool) -> DataFrame:
    """(term, df) of each Arrow batch of documents that share no id, and first_at with places."""
    kind = docs.select("doc_id").schema[0]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if places:
                order = pc.array_sort_indices(ids, null_placement="at_start")
                ids, texts = ids.take(order), texts.take(order)
            df, last, place = Counter(), {}, {}
            for i in range(0, len(ids), AT_ONCE):
                for row, text in enumerate(texts.slice(i, AT_ONCE).to_pylist(), i):
                    if places:
                        n, at = B.placed(text)
                        last.update(dict.fromkeys(n, row))
                        place.update(at)
                    else:
                        n = B.counted(text)
                    df.update(n.keys())
            terms = list(df)
            columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(df.values(), pa.int64())]
            if places:
                back = pa.array(-np.array([place[t] for t in terms], np.int32))
                columns += [ids.take(pa.array([last[t] for t in terms], pa.int64())), back]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "doc_id", "back"][: len(columns)])

    made = [StructField("term", StringType()), StructField("df", LongType()), kind, StructField("back", IntegerType())]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, StructType(made if places else made[:2]))
    return rows.select("term", "df", *([F.struct("doc_id", "back").alias("first_at")] if places else []))


def vocabulary(docs: DataFrame, use_tfidf: bool = True, places: bool = True) -> DataFrame:
    """vocab() of documents, without their postings; first_at is left out where places are not asked for."""
    own, shared = apart(docs)
    at = F.struct(F.col("doc_id"), (-F.col("first_pos")).alias("back")).alias("first_at")
    added = _added(bags(shared)).select("term", F.lit(1).cast("long").alias("df"), *([at] if places else [])) if shared is not None else None
    rows = together(_met(own, places) if own is not None else None, added)
    counted = rows.groupBy("term").agg(F.sum("df").alias("df"), *([F.max("first_at").alias("first_at")] if places else []))
    idf = T.idf(F.col("df"), total_docs(docs)) if use_tfidf else F.lit(0.0)
    return counted.select("term", "df", idf.alias("idf"), *(["first_at"] if places else []))


def terms(docs: DataFrame) -> DataFrame:
    """(term), distinct: all that a gram index needs."""
    require(docs, "doc_id", "text")
    return _met(docs, False).select("term").distinct()


def head(vocabulary: DataFrame, n: int = 10, start: int = 0) -> DataFrame:
    """Terms start..n by first appearance; n of 0 or less means all."""
    ordered = vocabulary.orderBy(F.desc("first_at"))
    return ordered.offset(start) if n <= 0 else ordered.limit(n).offset(start)


def lookup(vocabulary: DataFrame, term: str) -> DataFrame:
    return vocabulary.where(F.col("term") == T.normalize_text(term))


def first_postings(posts: DataFrame, n: int = 3) -> DataFrame:
    """(term, doc_id, cnt, tf, rn): the first n postings of each term by id. The limit is kept within tasks first."""
    place = F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))
    return posts.select("term", "doc_id", "cnt", "tf", place.alias("rn")).where(F.col("rn") <= n)


def stats(vocabulary: DataFrame) -> DataFrame:
    """(df, terms, pct): how many terms stand in how many documents, in percent of all terms."""
    by = vocabulary.groupBy("df").agg(F.count("*").alias("terms"))
    total = F.sum("terms").over(Window.partitionBy())
    return by.select("df", "terms", F.round(100 * F.col("terms") / total, 2).alias("pct"))


def doc_index(docs: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each doc_id, the first by `order` (input order where none is given)."""
    require(docs, "doc_id")
    own, shared = apart(docs)
    return together(own, _first_rows(shared, order) if shared is not None else None)


def _first_rows(docs: DataFrame, order: Column | None) -> DataFrame:
    at = order if order is not None else F.monotonically_increasing_id()
    rows = docs.select("doc_id", F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), at.alias("__at"))
    return rows.groupBy("doc_id").agg(F.min_by("__row", "__at").alias("__row")).select("__row.*")


def merge(posts: DataFrame, vocabulary: DataFrame, new_docs: DataFrame, update_tf: bool = True) -> tuple[DataFrame, DataFrame]:
    """Postings and vocabulary after an upsert of new documents.

    Counts add up and df follows; tf is computed anew for touched postings only (with update_tf off it stays,
    0 for new ones); idf stays as it was, 0 for new terms, until refresh_idf().

    Old postings of other documents pass as they are; those of the new documents' ids meet the new counts in one
    aggregation. What changes in the vocabulary is found from these only.
    """
    delta = _added(bags(new_docs))
    none = F.lit(None).cast("double")
    ids = new_docs.select(F.col("doc_id").alias("__new")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__new"))
    hit = posts.join(ids, same, "left_semi")
    old = hit.select("term", "doc_id", "cnt", "first_pos", "tf", F.lit(0).alias("new"))
    both = old.unionByName(delta.select("term", "doc_id", "cnt", "first_pos", none.alias("tf"), F.lit(1).alias("new")))
    # An old posting's place comes before a new one's.
    summed = both.groupBy("term", "doc_id").agg(F.sum("cnt").alias("cnt"), F.min_by("first_pos", "new").alias("first_pos"), F.max("tf").alias("tf"), F.max("new").alias("new"))
    fresh = T.tf(F.col("cnt")) if update_tf else F.coalesce("tf", F.lit(0.0))
    changed = summed.select("term", "doc_id", "cnt", "first_pos", F.when(F.col("new") == 0, F.col("tf")).otherwise(fresh).alias("tf"))
    merged = posts.join(ids, same, "left_anti").select("term", "doc_id", "cnt", "first_pos", "tf").unionByName(changed)
    touched = hit.join(delta.select("term", "doc_id"), ["term", "doc_id"], "left_semi").select("term", "doc_id")
    gained = delta.join(touched, ["term", "doc_id"], "left_anti").groupBy("term")
    more = gained.agg(F.count("*").alias("df"), F.max(F.struct(F.col("doc_id"), (-F.col("first_pos")).alias("back"))).alias("first_at"))
    known = vocabulary.select("term", "df", "idf", "first_at", F.lit(0).alias("new"))
    terms = known.unionByName(more.select("term", "df", none.alias("idf"), "first_at", F.lit(1).alias("new")))
    return merged, terms.groupBy("term").agg(F.sum("df").alias("df"), F.coalesce(F.max("idf"), F.lit(0.0)).alias("idf"), F.min_by("first_at", "new").alias("first_at"))


def refresh_idf(vocabulary: DataFrame, total: int | Column) -> DataFrame:
    n = F.lit(total) if isinstance(total, int) else total
    return vocabulary.withColumn("idf", T.idf(F.col("df"), n))


def dimensions(vocabulary: DataFrame) -> DataFrame:
    """(term, dim, df): a term's place by first appearance.

    Places come from a range partitioning: counts of the terms in each range, then numbers inside it, so no
    task orders the whole vocabulary. The numbered table is kept before it is used twice, so its ranges are drawn once.
    """
    ranged = vocabulary.select("term", "df", "first_at").repartitionByRange(F.desc("first_at")).sortWithinPartitions(F.desc("first_at"))
    numbered = ranged.select("term", "df", F.monotonically_increasing_id().alias("at")).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row a partition, so this window is small whatever the vocabulary.
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))
    return numbered.withColumn("part", part).join(F.broadcast(starts), "part").select("term", (F.col("at") + F.col("shift")).alias("dim"), "df")


def document_vectors(posts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, dim, cnt): bags of words.

    The places of the most frequent terms go to where the postings are; only postings of the others are exchanged.
    """
    places = dimensions(vocabulary)
    often = places.orderBy(F.desc("df"), "term").limit(FREQUENT).select("term", "dim")
    met = posts.select("term", "doc_id", "cnt").join(F.broadcast(often), "term", "left")
    rest = met.where(F.col("dim").isNull()).drop("dim").join(places.select("term", "dim"), "term")
    return met.where(F.col("dim").isNotNull()).select("doc_id", "dim", "cnt").unionByName(rest.select("doc_id", "dim", "cnt"))
