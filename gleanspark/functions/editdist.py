"""Edit distance and its matrices as column expressions; no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: stands for a neighbour outside the matrix.
MISSING = 1000


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def within(a: Column, b: Column, most: int) -> Column:
    """The distance, or -1 where it is more than `most`: prunes while it computes."""
    return F.levenshtein(a, b, most)


def matrix(a: Column, b: Column) -> Column:
    """array<array<int>>: a row for each beginning of b, a column for each beginning of a.

    Each cell is the distance of two beginnings, which is what the dynamic program holds there.
    """
    return F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: F.transform(F.sequence(F.lit(0), F.length(a)), lambda j: F.levenshtein(F.substr(b, F.lit(1), i), F.substr(a, F.lit(1), j))))


def last_cell(m: Column) -> Column:
    return F.element_at(F.element_at(m, -1), -1)


def cells(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The columns of pairs and (i, j, d), a row for each cell."""
    rows = pairs.select("*", F.posexplode(matrix(F.col(a), F.col(b))).alias("i", "__row"))
    return rows.select("*", F.posexplode("__row").alias("j", "d")).drop("__row")


def detailed_cells(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The columns of pairs and (i, j, diag, above, left, best); MISSING outside the matrix, and at its origin."""

    def at(i: Column, j: Column) -> Column:
        return F.levenshtein(F.substr(F.col(b), F.lit(1), i), F.substr(F.col(a), F.lit(1), j))

    rows = pairs.select("*", F.explode(F.sequence(F.lit(0), F.length(b))).alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length(a))).alias("j"))
    i, j = F.col("i"), F.col("j")
    differ = (F.substr(F.col(b), i, F.lit(1)) != F.substr(F.col(a), j, F.lit(1))).cast("int")
    diag = F.when((i > 0) & (j > 0), at(i - 1, j - 1) + differ).otherwise(MISSING)
    above = F.when(i > 0, at(i - 1, j) + 1).otherwise(MISSING)
    left = F.when(j > 0, at(i, j - 1) + 1).otherwise(MISSING)
    return rows.select("*", diag.alias("diag"), above.alias("above"), left.alias("left"), F.least(diag, above, left).alias("best"))
