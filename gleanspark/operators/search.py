"""Boolean, wildcard, regular-expression and ranked queries over the index tables."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import kgram


def entries(query: str | list[str]) -> list[str]:
    if isinstance(query, str):
        return [query]
    if isinstance(query, (list, tuple)) and all(isinstance(q, str) for q in query):
        return list(query)
    raise TypeError("a query is a string or a list of strings")


def intersect(lists: list[DataFrame]) -> DataFrame:
    """Posting lists (doc_id) in common."""
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), lists)


def unite(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lists).distinct()


def query_terms(posts: DataFrame, grams: DataFrame | None, query: list[str], wildcard: bool) -> DataFrame:
    """(q_ord, term): each entry is one whole term; entries with a star become the words they expand to."""
    spark = posts.sparkSession
    plain = [(i, T.normalize_text(q)) for i, q in enumerate(query) if not (wildcard and "*" in q)]
    out = spark.createDataFrame(plain, "q_ord int, term string")
    starred = {i: q for i, q in enumerate(query) if wildcard and "*" in q}
    if starred and grams is None:
        raise ValueError("wildcards need a gram index")
    return out.unionByName(kgram.expand_all(grams, starred)) if starred else out


def matches(posts: DataFrame, query: str | list[str], grams: DataFrame | None = None, wildcard: bool = False, mode: str = "and") -> DataFrame:
    """(doc_id) of documents with every entry ("and") or any entry ("or").

    Literal entries become a filter that reaches the postings. Without a gram index a pattern does too, as a term alone
    tells whether it is an expansion; with one, the postings that the filter leaves join what the index gives. One aggregation by document decides.
    """
    asked = entries(query)
    need = len(asked) if mode == "and" else 1
    if not (wildcard and any("*" in q for q in asked)):
        by = {}
        for i, q in enumerate(asked):
            by.setdefault(T.normalize_text(q), []).append(i)
        hit = posts.where(F.col("term").isin(list(by)))
        # Entries that are equal as terms hold together.
        return hit.groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") >= (len(by) if mode == "and" else 1)).select("doc_id")
    fits = [kgram.holds(F.col("term"), q) if "*" in q else F.col("term") == T.normalize_text(q) for q in asked]
    hit = posts.select("term", "doc_id").where(reduce(lambda a, b: a | b, fits))
    if grams is None:
        met = hit.groupBy("doc_id").agg(*[F.max(f).alias(f"__{i}") for i, f in enumerate(fits)])
        return met.where(reduce(lambda a, b: a & b if mode == "and" else a | b, [F.col(f"__{i}") for i in range(len(fits))])).select("doc_id")
    hit = hit.join(query_terms(posts, grams, asked, wildcard), "term")
    return hit.groupBy("doc_id").agg(F.countDistinct("q_ord").alias("n")).where(F.col("n") >= need).select("doc_id")


def ranked(posts: DataFrame, vocabulary: DataFrame, query: str | list[str], grams: DataFrame | None = None, wildcard: bool = False, strict: bool = False) -> DataFrame:
    """(doc_id, rank), documents with any entry by cosine of tf * idf.

    Query weights are all equal, so the cosine is sum(w) / (sqrt(n) * sqrt(sum(w * w))) over the n query
    tokens, w = tf * idf of a token in the document; 1 where all w are 0. A token that is not indexed has
    w = 0, or raises KeyError if strict. With wildcards, a pattern's words add candidates but have no weight: the
    pattern itself is a token that is not indexed.
    """
    asked = entries(query)
    words = T.tokens_of(" ".join(asked))
    times = Counter(words)
    if strict:
        known = {r.term for r in vocabulary.where(F.col("term").isin(list(times))).select("term").collect()}
        if missing := sorted(set(times) - known):
            raise KeyError(missing[0])
    candidates = matches(posts, asked, grams, wildcard, "or")
    counts = F.create_map(*[F.lit(x) for t, n in times.items() for x in (t, n)]) if times else F.create_map().cast("map<string,int>")
    of = posts.where(F.col("term").isin(list(times))).join(vocabulary.where(F.col("term").isin(list(times))).select("term", "idf"), "term")
    w, m = F.col("tf") * F.col("idf"), counts[F.col("term")]
    sums = of.groupBy("doc_id").agg(F.sum(w * m).alias("s"), F.sum(w * w * m).alias("ss"))
    norm = F.sqrt(F.lit(float(max(1, len(words))))) * F.sqrt("ss")
    rank = F.when(F.coalesce("ss", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("s") / F.when(norm > 0, norm))
    return candidates.join(sums, "doc_id", "left").select("doc_id", rank.alias("rank"))


def top(rank: DataFrame, k: int) -> DataFrame:
    """The k best by rank, then id; planned as one top-k per task and a merge."""
    return rank.orderBy(F.desc("rank"), "doc_id").limit(k)


def regex_docs(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents whose raw text has a case-insensitive match."""
    return docs.where(F.col("text").rlike("(?i)" + pattern))
