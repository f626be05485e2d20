"""Confusion matrices and their measures, as rows (actual, predicted, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_CATEGORIZED = "NOT_CAT"


def confusion(pairs: DataFrame, not_categorized: bool = False, fill: bool = True) -> DataFrame:
    """pairs(ys, yhats: arrays of labels) -> (actual, predicted, n).

    Labels in both count on the diagonal; every label missed counts against every label wrongly given. Where
    one side has nothing left, the other's rest is dropped, or counts against NOT_CAT. With fill, pairs of
    labels that never met count 0. Null arrays are empty.
    """

    def strings(c: str):
        return F.array_distinct(F.transform(F.coalesce(F.col(c), F.array()), lambda x: x.cast("string")))

    rows = pairs.select(strings("ys").alias("y"), strings("yhats").alias("h"))
    rest = rows.select(F.array_intersect("y", "h").alias("both"), F.array_except("y", "h").alias("missed"), F.array_except("h", "y").alias("wrong"), "y", "h")
    none = F.array(F.lit(NOT_CATEGORIZED))
    if not_categorized:
        one_sided = (F.size("missed") == 0) != (F.size("wrong") == 0)
        rest = rest.withColumn("missed", F.when(one_sided & (F.size("missed") == 0), none).otherwise(F.col("missed")))
        rest = rest.withColumn("wrong", F.when(one_sided & (F.size("wrong") == 0), none).otherwise(F.col("wrong")))
    hits = F.transform("both", lambda x: F.struct(x.alias("actual"), x.alias("predicted")))
    misses = F.flatten(F.transform("missed", lambda a: F.transform(F.col("wrong"), lambda p: F.struct(a.alias("actual"), p.alias("predicted")))))
    met = rest.select(F.explode(F.concat(hits, misses)).alias("c")).select("c.actual", "c.predicted")
    counted = met.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    if not fill:
        return counted
    extra = none if not_categorized else F.array().cast("array<string>")
    labels = rest.select(F.explode(F.array_union(F.array_union("y", "h"), extra)).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("actual")).join(labels.select(F.col("label").alias("predicted")), F.lit(True))
    return grid.join(counted, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def mapped(cm: DataFrame, names: DataFrame) -> DataFrame:
    """The matrix with labels renamed by names(label, name); labels without a name go."""
    a = names.select(F.col("label").cast("string").alias("actual"), F.col("name").alias("a"))
    p = names.select(F.col("label").cast("string").alias("predicted"), F.col("name").alias("p"))
    return cm.join(a, "actual").join(p, "predicted").select(F.col("a").alias("actual"), F.col("p").alias("predicted"), "n")


def precisions(cm: DataFrame) -> DataFrame:
    """(label, precision): the diagonal over the row of an actual label; labels with an empty row are left out.

    Rows are actual labels, so this is what is elsewhere called recall; the name is kept for compatibility.
    """
    return _share(cm, "actual", "precision")


def recalls(cm: DataFrame) -> DataFrame:
    """(label, recall): the diagonal over the column of a predicted label."""
    return _share(cm, "predicted", "recall")


def _share(cm: DataFrame, by: str, name: str) -> DataFrame:
    sums = cm.groupBy(F.col(by).alias("label")).agg(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("all"))
    return sums.where(F.col("all") > 0).select("label", (F.col("hit") / F.col("all")).alias(name))


def f1(cm: DataFrame) -> DataFrame:
    """One row (precision, recall, f1): macro means over all labels of the matrix, and F of the means."""
    labels = cm.select(F.col("actual").alias("label")).distinct()
    per = labels.join(precisions(cm), "label", "left").join(recalls(cm), "label", "left")
    means = per.agg((F.sum(F.coalesce("precision", F.lit(0.0))) / F.count("*")).alias("precision"), (F.sum(F.coalesce("recall", F.lit(0.0))) / F.count("*")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return means.select("precision", "recall", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / F.when(both != 0, both)).alias("f1"))


def true_positives(cm: DataFrame) -> DataFrame:
    return cm.where("actual = predicted").select(F.col("actual").alias("label"), "n")


def false_positives(cm: DataFrame) -> DataFrame:
    """(label, other, n): documents of another label that got this one."""
    return cm.where("actual <> predicted").select(F.col("predicted").alias("label"), F.col("actual").alias("other"), "n")


def true_negatives(cm: DataFrame) -> DataFrame:
    """(label, other, n): documents of this label that got another. The name is kept for compatibility."""
    return cm.where("actual <> predicted").select(F.col("actual").alias("label"), F.col("predicted").alias("other"), "n")
