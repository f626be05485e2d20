"""K-gram index and wildcard expansion. Grams are made from distinct terms, never from tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def gram_index(vocabulary: DataFrame, k: int = 2) -> DataFrame:
    """(gram, term), distinct."""
    terms = vocabulary.select("term").where(~T.is_ignored(F.col("term")))
    return terms.select(F.explode(F.array_distinct(T.grams(F.col("term"), k))).alias("gram"), "term")


def words_of(grams: DataFrame) -> DataFrame:
    """(gram, words): sorted words of each gram, for display."""
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("term")).alias("words"))


def word_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def words_count(grams: DataFrame) -> int:
    return grams.count()


def holds(term: Column, pattern: str, k: int = 2) -> Column:
    """Whether expand() of a vocabulary that has the term gives it, told from the term alone."""
    wanted = sorted(set(T.wildcard_grams(pattern, k)))
    if not wanted:
        return F.lit(False)
    # Every gram of a term stands in the marked term; two letters of it are always a gram, unless it is empty.
    marked = F.concat(F.lit(T.MARK), term, F.lit(T.MARK))
    found = ~T.is_ignored(term)
    for g in wanted:
        found = found & F.contains(marked, F.lit(g))
    if k == 2 and all(len(g) == 2 for g in wanted):
        return found & (term != "")
    return found & (F.size(F.array_intersect(T.grams(term, k), F.array(*[F.lit(g) for g in wanted]))) == len(wanted))


def expand_all(grams: DataFrame, patterns: dict[int, str], k: int = 2) -> DataFrame:
    """(q_ord, term): the expansions of numbered patterns in one pass over the grams that any of them holds."""
    wanted = {i: sorted(set(T.wildcard_grams(p, k))) for i, p in patterns.items()}
    every = sorted({g for gs in wanted.values() for g in gs})
    # A term's list holds at most the grams of the patterns.
    found = grams.where(F.col("gram").isin(every) if every else F.lit(False)).groupBy("term").agg(F.collect_set("gram").alias("gs"))
    hits = [F.when(F.size(F.array_intersect("gs", F.array(*[F.lit(g) for g in gs]))) == len(gs), F.lit(i)) for i, gs in wanted.items() if gs]
    if not hits:
        return found.select(F.lit(0).alias("q_ord"), "term").limit(0)
    return found.select(F.explode(F.array_compact(F.array(*hits))).alias("q_ord"), "term")


def expand(grams: DataFrame, pattern: str, k: int = 2, exact: bool = False) -> DataFrame:
    """(term): words that hold every gram of the pattern, a division by the set of its grams.

    Like any k-gram lookup this admits false positives; exact=True filters them by the pattern itself. A
    pattern without a whole gram matches nothing.
    """
    wanted = sorted(set(T.wildcard_grams(pattern, k)))
    found = grams.where(F.col("gram").isin(wanted) if wanted else F.lit(False)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    if exact:
        found = found.where(F.col("term").rlike(T.glob_regex(pattern)))
    return found.select("term")
