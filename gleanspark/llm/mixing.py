"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document gets a rate r >= 0, and sum(size * r) over a source must equal the source's target. Of all
such rates the ones nearest to one copy a document are wanted: least sum of q * (r log r - r + 1), where
q = size ** POWER weighs a document. The convex dual has one multiplier a source, and its solution tilts
exponentially: r = min(COPIES, exp(lambda * (size / mean size) ** (1 - POWER))). Newton iterations on the
dual run over the histogram of (source, size), which is exact and far smaller than the corpus, all sources at
once. A bracket around lambda replaces Newton steps that leave it, and every third step halves it, so the
iterations always end; they end at the constraint or where the bracket has no width.

Rates become copies: the whole part, and one more for the documents whose hash divided by the fraction is
under their source's cut. A hash covers all columns of a row, so only rows that are equal in all of them share a fate;
such a group has one line and a count in the plan. The cut is placed by a histogram over the ratio
and the running sum inside one bin. The group at the cut is split by count, so a source's words meet its
target to within one document, whatever repeats.

Defined cases: a null text has size zero and takes nothing; null is a source of its own, last in order;
null and repeated ids are documents like any other; of equal rows at the cut some get a copy more than the others,
and it doesn't matter which; a source of size zero has target zero; further columns only enter the hash. Texts of any
length count whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HASH_SPAN, Cut, content_hash

WEIGHTS = (5, 2, 1)
#: Most copies of a document, and most words of a target per word of its source.
COPIES = 3
POWER = 0.75
BINS = 2048
#: Newton steps in one pass over the histograms.
STEPS = 60
#: Equal rows are written out again in runs of so many.
RUN = 10_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key that sorts as the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank 0, 1, ... by key: numbers inside ranges, and the ranges' sizes summed up."""
    dealt = sources.repartitionByRange("key").sortWithinPartitions("key")
    held = Cut(dealt.withColumn("at", F.monotonically_increasing_id())).df.withColumn("part", F.shiftright("at", 33))
    # One row a partition, however many sources there are.
    sizes = held.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), "first")
    return held.join(starts, "part").select(*sources.columns, (F.coalesce("before", F.lit(0)) + F.col("at") - F.col("first")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """sources(key, source_size) -> adds weight and target = min(cap, level * weight), one level for all.

    All sources share by weight first; those above their caps are set to them and the rest is shared
    again, until none is above. A round is one aggregation over the sources and two numbers for the driver; a
    round without a newly capped source is the last.
    """
    shares = F.array(*[F.lit(float(w)) for w in weights])
    df = _ranked(sources).withColumn("weight", F.element_at(shares, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    df = df.select("key", "source_size", "weight", (F.col("source_size") * float(copies)).alias("cap"))
    level, capped_before = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap") if capped_before >= 0 else F.lit(False)
        got = df.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(over.cast("long")).alias("n")).first()
        if not got.open or got.n == capped_before:
            break
        level, capped_before = (got.total - got.caps) / got.open, got.n
    return df.select("key", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def tilt(size: Column, mean: Column) -> Column:
    return F.pow(size / mean, F.lit(1.0 - POWER))


def rate(size: Column, mean: Column, multiplier: Column, copies: int = COPIES) -> Column:
    return F.when(size > 0, F.least(F.lit(float(copies)), F.exp(F.least(F.lit(30.0), multiplier * tilt(size, mean))))).otherwise(F.lit(0.0))


def multipliers(histogram: DataFrame, wanted: DataFrame, copies: int = COPIES) -> Cut:
    """histogram(key, size, n), wanted(key, source_size, target, mean) -> Cut of wanted with lambda.

    A source's histogram becomes one row: its k sizes differ, so k * (k + 1) / 2 is no more than its words, and the row
    is small whatever the corpus. A pass over these rows takes STEPS safeguarded Newton steps for every source that
    is not yet solved; passes follow until all are. A source whose target is all that its copies can give has an infinite
    multiplier from the start.
    """
    packed = histogram.where("size > 0").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("bars"))
    full = F.col("target") >= F.col("source_size") * (copies * (1 - 1e-12))
    first = F.when(full, F.lit(float("inf"))).otherwise(F.log(F.col("target") / F.col("source_size")))
    begin = F.struct(F.coalesce(first, F.lit(0.0)).alias("lambda"), F.lit(-700.0).alias("low"), F.lit(1e9).alias("high"), (full | (F.col("source_size") == 0)).alias("met"))
    # Each bar as its words and its tilt, both constant over the steps.
    bars = F.transform("bars", lambda x: F.struct((x["size"] * x["n"]).cast("double").alias("words"), tilt(x["size"], F.col("mean")).alias("tilt")))
    state = Cut(wanted.join(packed, "key", "left").select(*wanted.columns, F.coalesce(bars, F.array().cast("array<struct<words:double,tilt:double>>")).alias("bars"), begin.alias("at")))

    def step(at: Column, turn: Column) -> Column:
        here = lambda tilt_: F.least(F.lit(float(copies)), F.exp(F.least(F.lit(30.0), at["lambda"] * tilt_)))
        zero = F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope"))
        add = lambda m, x, r: F.struct((m["got"] + x["words"] * r).alias("got"), (m["slope"] + F.when(r < copies, x["words"] * r * x["tilt"]).otherwise(0.0)).alias("slope"))
        moments = F.aggregate("bars", zero, lambda m, x: add(m, x, here(x["tilt"])))
        return F.when(at["met"], at).otherwise(F.transform(F.array(moments), lambda m: _moved(at, m, turn))[0])

    steps = F.sequence(F.lit(1), F.lit(STEPS))
    passes = 0
    while True:
        moved = Cut(state.df.withColumn("at", F.aggregate(steps, F.col("at"), step)))
        state.drop()
        state, passes = moved, passes + 1
        if state.df.where(~F.col("at.met")).isEmpty():
            break
        if passes > 20:
            raise ArithmeticError("the dual did not converge")
    solved = Cut(state.df.select(*wanted.columns, F.col("at.lambda").alias("lambda")))
    state.drop()
    return solved


def _moved(at: Column, moments: Column, turn: Column) -> Column:
    """The state after one step: Newton's where it stays in the bracket, else (and every third time) to its middle."""
    off = moments["got"] - F.col("target")
    low, high = F.when(off < 0, at["lambda"]).otherwise(at["low"]), F.when(off > 0, at["lambda"]).otherwise(at["high"])
    newton = at["lambda"] - off / F.when(moments["slope"] > 0, moments["slope"])
    inside = F.coalesce((newton > low) & (newton < high) & (turn % 3 != 0), F.lit(False))
    # In proportion where the bracket is still wide: from -700 to 1e9 both ends matter.
    middle = F.when((low > 1) & (high > 4 * low), F.sqrt(low * high)).when((low <= 1) & (high > 4), F.lit(2.0)).otherwise((low + high) / 2)
    narrow = high - low <= F.lit(1e-13) * F.greatest(F.lit(1.0), F.abs(at["lambda"]))
    done = narrow | (F.abs(off) <= 1e-10 * F.greatest(F.lit(1.0), F.col("target")))
    return F.struct(F.when(done, at["lambda"]).when(inside, newton).otherwise(middle).alias("lambda"), low.alias("low"), high.alias("high"), done.alias("met"))


def _ratio(rates: Column, mark: Column) -> Column:
    """A document's hash over the fraction of its rate: the cut it needs for one copy more."""
    fraction = rates - F.floor(rates)
    return F.when(fraction > 0, (F.shiftrightunsigned(mark, 11).cast("double") / F.lit(HASH_SPAN)) / fraction)


def _described(docs: DataFrame, text_col: str, source_col: str) -> list[Column]:
    return [source_key(F.col(source_col)).alias("__gs_key"), words_of(F.col(text_col)).alias("__gs_size"), content_hash(docs, F.lit("mix")).alias("__gs_mark")]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies: int = COPIES) -> tuple[Cut, Cut]:
    """Cuts of the groups of equal rows (doc_id, key, size, mark, rows) and of the sources.

    A source has its multiplier, its cut, and the group at the cut: its mark and how many of its rows get a copy more.
    """
    key, size, mark = _described(docs, text_col, source_col)
    small = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), size.alias("size"), mark.alias("mark"))
    groups = Cut(small.groupBy("doc_id", "key", "size", "mark").agg(F.count("*").alias("rows")))
    histogram = Cut(groups.df.groupBy("key", "size").agg(F.sum("rows").alias("n")))
    sources = histogram.df.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), (F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    aimed = targets(sources.select("key", "source_size"), copies=copies).join(sources.select("key", "mean"), "key")
    solved = multipliers(histogram.df, aimed, copies)
    histogram.drop()

    # Rounded, so that the order of summation doesn't show.
    known = solved.df.select("key", "mean", F.round("lambda", 12).alias("lambda"), "target")
    rows = groups.df.join(known, "key")
    r = rate(F.col("size"), F.col("mean"), F.col("lambda"), copies)
    rows = rows.select("key", "mark", "rows", "size", "target", F.floor(r).alias("whole"), _ratio(r, F.col("mark")).alias("ratio"))
    # Ratios of 2 and more need more words than the target can lack; the last bin takes them, so no row is lost.
    binned = rows.withColumn("bin", F.coalesce(F.least(F.lit(BINS), F.floor(F.col("ratio") * (BINS / 2)).cast("int")), F.lit(-1)))
    words = F.col("size") * F.col("rows")
    sums = Cut(binned.groupBy("key", "bin").agg(F.sum(words * F.col("whole")).alias("sure"), F.sum(words).alias("words"), F.first("target").alias("target")))
    over = Window.partitionBy("key")
    filled = sums.df.withColumn("need", F.col("target") - F.sum("sure").over(over))
    filled = filled.withColumn("upto", F.sum(F.when(F.col("bin") >= 0, F.col("words")).otherwise(0)).over(over.orderBy("bin")))
    open_bin = filled.where((F.col("bin") >= 0) & (F.col("upto") >= F.col("need"))).groupBy("key").agg(F.min_by(F.struct("bin", (F.col("need") - F.col("upto") + F.col("words")).alias("left")), "bin").alias("at"))
    critical = Cut(open_bin.select("key", "at.bin", "at.left"))
    # Groups of one bin of each source only: one in BINS / 2 of a source's, and equal rows are one group.
    last = binned.join(critical.df, ["key", "bin"]).select("key", "ratio", "mark", "size", "rows", "left")
    ordered = Window.partitionBy("key").orderBy("ratio", "mark", "size")
    last = last.withColumn("before", F.sum(F.col("size") * F.col("rows")).over(ordered) - F.col("size") * F.col("rows"))
    lacking = F.col("left") - F.col("before")
    extra = F.least(F.col("rows"), F.greatest(F.lit(0), F.floor(lacking / F.greatest("size", F.lit(1)) + 0.5))).cast("long")
    crossing = last.where(F.col("before") + F.col("size") * F.col("rows") >= F.col("left")).groupBy("key").agg(F.min_by(F.struct("ratio", "mark", extra.alias("extra")), F.struct("ratio", "mark", "size")).alias("at"))
    edges = crossing.select("key", F.col("at.ratio").alias("cut"), F.col("at.mark").alias("edge"), F.col("at.extra").alias("extra"))
    # Without a bin that reaches the target, every fraction is taken.
    final = Cut(solved.df.join(edges, "key", "left").select("key", "source_size", "target", "mean", F.round("lambda", 12).alias("lambda"), F.coalesce("cut", F.lit(float("inf"))).alias("cut"), "edge", F.coalesce("extra", F.lit(0)).alias("extra")))
    for done in (solved, sums, critical):
        done.drop()
    return groups, final


def _copies(size: Column, mark: Column, copies: int = COPIES) -> Column:
    """Copies of a row; those of the group at the cut are without what is split by count."""
    r = rate(size, F.col("mean"), F.col("lambda"), copies)
    ratio = _ratio(r, mark)
    under = (ratio < F.col("cut")) | ((ratio == F.col("cut")) & (mark < F.col("edge")))
    return (F.floor(r) + F.when(under, 1).otherwise(0)).cast("long")


def _repeated(df: DataFrame, n: Column) -> DataFrame:
    """Each row of df n times, in runs, so that no array grows with n but by its share of RUN."""
    runs = df.withColumn("__gs_n", n).where("__gs_n > 0").withColumn("__gs_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__gs_n") - 1) / RUN))))
    left = F.least(F.lit(RUN), F.col("__gs_n") - F.col("__gs_run") * RUN).cast("int")
    return runs.withColumn("__gs_one", F.explode(F.array_repeat(F.lit(1), left))).drop("__gs_n", "__gs_run", "__gs_one")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies: int = COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs."""
    groups, sources = plan(docs, id_col, text_col, source_col, copies)
    rows = groups.df.join(sources.df, "key").withColumn("copies", _copies(F.col("size"), F.col("mark"), copies))
    extra = F.when(F.col("mark") == F.col("edge"), F.col("extra")).otherwise(F.lit(0))
    parts = F.array(F.struct((F.col("rows") - extra).alias("n"), F.col("copies").alias("c")), F.struct(extra.alias("n"), (F.col("copies") + 1).alias("c")))
    split = rows.select("doc_id", "size", "source_size", "target", F.explode(parts).alias("part"))
    return _repeated(split, F.col("part.n")).select("doc_id", "size", "source_size", "target", (F.col("part.c") * F.col("size")).alias("taken"), F.col("part.c").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies: int = COPIES) -> DataFrame:
    """The rows of docs, each as often as its copies say; columns as in docs.

    Texts are not shuffled unless the sources are too many to broadcast. Of the equal rows at a source's cut one
    is taken and written out as often as all of them together; each task brings one at most.
    """
    groups, sources = plan(docs, id_col, text_col, source_col, copies)
    cut = sources.df.select(F.col("key").alias("__gs_key"), "mean", "lambda", "cut", "edge", "extra")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__gs_row")
    keyed = docs.select(row, *_described(docs, text_col, source_col)).join(cut, "__gs_key")
    counted = keyed.withColumn("__gs_c", _copies(F.col("__gs_size"), F.col("__gs_mark"), copies))
    at_cut = F.coalesce(F.col("__gs_mark") == F.col("edge"), F.lit(False))
    plain = _repeated(counted.where(~at_cut).select("__gs_row", "__gs_c"), F.col("__gs_c")).select("__gs_row.*")
    one = counted.where(at_cut).groupBy("__gs_key", "extra").agg(F.first("__gs_row").alias("__gs_row"), F.sum("__gs_c").alias("__gs_c"))
    edge = _repeated(one, F.col("__gs_c") + F.col("extra")).select("__gs_row.*")
    groups.drop()
    return plain.unionByName(edge)
