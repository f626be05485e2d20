"""Quality rules as a short-circuit cascade.

A rule rejects a text. On a sample of all texts, drawn and measured by the executors, every statistic has its cost
(seconds, without what the statistics below it cost) and every combination of rejecting rules its
frequency. The cascade is built greedily from these: the next rule is the one that rejects most of the texts
still kept, for the cost of the statistics that no earlier rule has needed. A text leaves at the first rule
that rejects it, and a statistic that no rule has asked for is not computed. The order changes the time,
never the verdict: a text is kept if no rule rejects it.

keep() is the filter: it computes what the cascade asks for and nothing else. judge() also reports the base
statistics of every text, so there only the cost of what isn't reported counts.

Defined cases: a null text has no words; a text without words fails the base rule; texts of any length are read
whole, also in the sample; repeated rows are judged each on its own; further columns stay (keep) or are not
looked at (judge); rules of equal worth keep their order; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as S
from .common import kind_of, map_arrow

#: Texts that cost and selectivity are estimated on, about.
SAMPLE_ROWS = 300


@dataclass(frozen=True)
class Rule:
    name: str
    #: The statistics that the rule looks at, those of STATISTICS that they need included.
    needs: tuple[str, ...]
    rejects: Callable[["Text"], bool]


#: Each statistic from a text, in an order in which each finds what it needs.
STATISTICS: dict[str, Callable[["Text"], object]] = {
    "words": lambda t: t.raw.split(),
    "word_chars": lambda t: S.word_chars(t.raw),
    "symbols": lambda t: S.n_symbols(t.raw),
    "dup_lines": lambda t: S.n_dup_lines(t.raw),
    "ids": lambda t: S.word_ids(t.words),
    "repeat_words": lambda t: S.n_repeat_words(t.words, t.ids) if t.words else 0,
    "letters": lambda t: (len(t.raw) - len(t.raw.translate(None, S._UPPER)), len(t.raw) - len(t.raw.translate(None, S._LOWER))),
    "top": lambda t: int(S.np.bincount(t.ids).max()) if t.words else 0,
}
#: What judge() reports of every text, and what that needs.
REPORTED = ("words", "word_chars", "symbols", "dup_lines", "ids", "repeat_words")


class Text:
    """One text with statistics that are computed when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    def __getattr__(self, name: str):
        if name not in STATISTICS:
            raise AttributeError(name)
        value = STATISTICS[name](self)
        self.__dict__[name] = value
        return value


def _shouting(t: Text) -> bool:
    """More than 60 % of 40 or more ASCII letters are capitals."""
    up, low = t.letters
    return up + low >= 40 and 10 * up > 6 * (up + low)


#: The base rules, then the method's own.
BASE_RULES = (
    Rule("too_short", ("words",), lambda t: len(t.words) < 20),
    Rule("repeats", ("words", "ids", "repeat_words"), lambda t: 100 * t.repeat_words > 30 * len(t.words)),
)
MORE_RULES = (
    Rule("symbols", ("words", "symbols"), lambda t: 2 * t.symbols > len(t.words)),
    Rule("word_length", ("words", "word_chars"), lambda t: not 2 * len(t.words) <= t.word_chars <= 25 * len(t.words)),
    Rule("dup_lines", ("dup_lines",), lambda t: 2 * t.dup_lines > t.raw.count(b"\n") + 1),
    Rule("shouting", ("letters",), _shouting),
    Rule("one_word", ("words", "ids", "top"), lambda t: 2 * t.top > len(t.words)),
)
RULES = BASE_RULES + MORE_RULES


def measure(texts, rules: tuple[Rule, ...] = RULES) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds of each statistic over the texts, and how many texts each set of rules (as bits) rejects."""
    cost, sets = dict.fromkeys(STATISTICS, 0.0), {}
    for raw in texts:
        text = Text(raw)
        for name in STATISTICS:
            began = time.perf_counter()
            getattr(text, name)
            cost[name] += time.perf_counter() - began
        bits = sum(1 << k for k, rule in enumerate(rules) if rule.rejects(text))
        sets[bits] = sets.get(bits, 0) + 1
    return cost, sets


def plan(cost: dict[str, float], sets: dict[int, int], rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = ()) -> list[Rule]:
    """The cascade: each time the rule that rejects most of what is left, for the cost of what isn't known yet."""
    order, have, left, kept = [], set(known), list(range(len(rules))), dict(sets)

    def worth(k: int) -> float:
        rejected = sum(n for bits, n in kept.items() if bits >> k & 1)
        return (rejected + 0.5) / (1e-9 + sum(cost.get(s, 0.0) for s in rules[k].needs if s not in have))

    while left:
        best = max(left, key=lambda k: (worth(k), -k))
        left.remove(best)
        order.append(rules[best])
        have.update(rules[best].needs)
        kept = {bits: n for bits, n in kept.items() if not bits >> best & 1}
    return order


def sampled_order(texts: DataFrame, known: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """plan() on about `sample_rows` of all the texts, which stay on the executors; sums come to the driver."""
    n = texts.count()
    sample = texts.sample(min(1.0, sample_rows / n), seed=7) if n > sample_rows else texts

    def run(batches):
        cost, sets = {}, {}
        for batch in batches:
            c, s = measure((x.as_py() for x in batch.column(0)), rules)
            cost = {k: cost.get(k, 0.0) + v for k, v in c.items()}
            sets = {k: sets.get(k, 0) + s.get(k, 0) for k in sets.keys() | s.keys()}
        rows = [(k, 0, v) for k, v in cost.items()] + [("", k, float(v)) for k, v in sets.items()]
        if rows:
            yield pa.RecordBatch.from_pydict({"name": [r[0] for r in rows], "bits": pa.array([r[1] for r in rows], pa.int64()), "v": [r[2] for r in rows]})

    got = sample.mapInArrow(run, "name string, bits long, v double").groupBy("name", "bits").agg(F.sum("v").alias("v")).collect()
    return plan({r.name: r.v for r in got if r.name}, {r.bits: int(r.v) for r in got if not r.name}, rules, known)


def verdict(text: Text, rules: list[Rule]) -> str | None:
    """The first rule that rejects the text, None if it is kept."""
    return next((r.name for r in rules if r.rejects(text)), None)


def keep(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects; columns as in docs, no shuffle."""
    order = sampled_order(docs.select(F.col(text_col).cast("binary").alias("text")), (), RULES, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            raw = ((t.encode() if isinstance(t, str) else t) for t in (x.as_py() for x in batch.column(at)))
            yield batch.filter(pa.array([verdict(Text(t), order) is None for t in raw], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    order = sampled_order(rows.select("text"), REPORTED, RULES, sample_rows)
    base = {r.name for r in BASE_RULES}

    def make(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(8)]
        for x in batch.column(1):
            t = Text(x.as_py())
            by = verdict(t, order)
            failed = by in base or any(r.rejects(t) for r in BASE_RULES) if by else False
            row = (len(t.words), t.word_chars, t.symbols, t.dup_lines, t.repeat_words, failed, by is None, by)
            for column, v in zip(out, row):
                column.append(v)
        return [batch.column(0), *out]

    schema = f"doc_id {kind_of(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return map_arrow(rows, schema, make)
