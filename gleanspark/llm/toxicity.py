"""Toxicity from a lexicon that tolerates misspelling, weighed by context.

Learning (labelled rows of the training fold only; a bounded sample of at most about `max_train` rows,
drawn by a hash of the id): terms that are significantly commoner in toxic texts become the lexicon, kept in a
trie. An entry is a whole word, or a stem where many words of one beginning are toxic together; behind a stem
the automaton has an affix state that takes any letters. Scoring: Levenshtein automata with one error,
intersected with the trie, run over every word of the whole text. The intersection is one automaton, made
deterministic while it is used; a word stops at its first dead state. An error is admitted in whole words only, and
a word that the clean training texts use is no misspelling of another. Each hit has a context window: the words
around it have weights that are learned from the hits of toxic and of clean texts, and hits between
quotation marks or after a word of reporting count apart from the others, so quotation and abuse have
weights of their own. A logistic model on these counts gives the score.

Defined cases: null and empty texts have no hits and get the score of a text without hits; labels that
are null or neither 0 nor 1 are ignored; of repeated label rows the larger label holds; of documents that repeat
an id one is learned from, the least; all are scored; without training labels of both classes the lexicon is empty and
every text is kept. Long texts and long words are read whole. Further columns stay (reject_toxic) or are not
looked at. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, crc_mod, kind_of, map_arrow, unit_hash

WORD = re.compile(r"[^\W_]+")
#: About so many labelled rows are learned from, at most.
MAX_TRAIN = 6000
#: Letters of a stem; whole words may have any number.
SHORTEST, LONGEST = 3, 12
#: Words that a stem must have.
LEAST_WORDS = 3
#: Shorter entries admit no error.
FUZZY_FROM = 5
#: Log odds of an entry, and the chance that any of all the terms tested enters by accident.
LEAST_ODDS, ACCIDENT = 3.0, 0.01
WINDOW = 8
#: Openers and closers of quotation, and words of reporting.
QUOTES = "\"“”„«»‘’‹›"
REPORTING = frozenset(("said", "says", "called", "quote", "quoted", "word", "term", "wrote", "dit", "sagte", "dijo"))
_CACHE, _CACHED_LENGTH = 100_000, 40
_QUOTED, _TOLD = "\x00quoted", "\x00told"


class Lexicon:
    """Entries in a trie, intersected with one-error Levenshtein automata; a stem is written with a "*" behind it.

    find(word) -> (entry, errors) with errors 0 or 1, or None. A whole entry matches itself and, from FUZZY_FROM
    letters on, words at edit distance one that are not in `ordinary`. A stem matches words that begin with it
    and, like a whole entry, its own misspellings. No error beats one error; then a stem; then the first entry.
    """

    def __init__(self, entries: list[str], ordinary: frozenset[str] = frozenset()):
        self.entries, self.ordinary = list(entries), ordinary
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        for i, e in enumerate(self.entries):
            node = 0
            for ch in e.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                node = self.children[node][ch]
            self.ends.setdefault(node, i)
            if e.endswith("*"):
                self.stems.setdefault(node, i)
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.exact: list[int] = []
        self.fuzzy: list[int] = []
        self.affix: list[int] = []
        self.start = self._number({(0, 0)})
        self.cache: dict[str, tuple[int, int] | None] = {}

    def _number(self, items: set[tuple[int, int]]) -> int:
        """The number of a set of (node, errors), closed under skipped letters of the entries."""
        closed = set(items)
        for node, e in items:
            if e == 0:
                closed.update((c, 1) for c in self.children[node].values())
        closed = {(n, e) for n, e in closed if e == 0 or (n, 0) not in closed}
        key = frozenset(closed)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            hits = [[self.ends[n] for n, e in key if e == want and n in self.ends and (not e or len(self.entries[self.ends[n]].rstrip("*")) >= FUZZY_FROM)] for want in (0, 1)]
            self.exact.append(min(hits[0], default=-1))
            self.fuzzy.append(min(hits[1], default=-1))
            # The affix state: whatever follows an exact stem belongs to it.
            self.affix.append(min((self.stems[n] for n, e in key if not e and n in self.stems), default=-1))
        return self.numbers[key]

    def _step(self, state: int, ch: str) -> int:
        after = set()
        for node, e in self.states[state]:
            child = self.children[node].get(ch)
            if child is not None:
                after.add((child, e))
            if e == 0:
                after.add((node, 1))
                after.update((c, 1) for c in self.children[node].values())
        number = self._number(after) if after else -1
        self.steps[state][ch] = number
        return number

    def find(self, word: str) -> tuple[int, int] | None:
        if word in self.cache:
            return self.cache[word]
        state = self.start
        steps, found = self.steps, None
        for ch in word:
            after = steps[state].get(ch)
            state = self._step(state, ch) if after is None else after
            if state < 0:
                break
            if self.affix[state] >= 0:
                found = (self.affix[state], 0)
                break
        if found is None and state >= 0:
            if self.exact[state] >= 0:
                found = (self.exact[state], 0)
            elif self.fuzzy[state] >= 0 and word not in self.ordinary:
                found = (self.fuzzy[state], 1)
        if len(word) <= _CACHED_LENGTH:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            self.cache[word] = found
        return found


def hits(lexicon: Lexicon, text: str) -> list[tuple[int, int, int, int, bool, list[str]]]:
    """(start, end, entry, errors, quoted, context) of every hit in a lower-cased text.

    The context is the words within WINDOW of the hit that are no hits, and signs for quotation marks on both sides
    and for a word of reporting in front.
    """
    words = WORD.findall(text)
    found = {w: h for w in set(words) if (h := lexicon.find(w)) is not None}
    if not found:
        return []
    out = []
    for i, m in enumerate(WORD.finditer(text)):
        w = m[0]
        if w in found:
            before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 40]
            marked = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            told = any(x in REPORTING for x in words[max(0, i - 5) : i])
            around = {x for x in words[max(0, i - WINDOW) : i + WINDOW + 1] if x not in found}
            around.update([_QUOTED] * marked + [_TOLD] * told)
            out.append((m.start(), m.end(), *found[w], marked or told, sorted(around)))
    return out


N_FEATURES = 11


def densest(starts: list[int], span: int = 12 * WINDOW) -> int:
    """The most hits that start within one window; starts ascend."""
    most = first = 0
    for i, at in enumerate(starts):
        while at - starts[first] > span:
            first += 1
        most = max(most, i - first + 1)
    return most


def evidence(lexicon: Lexicon, weights: list[float], text: str | None, context: dict[str, float] | None = None) -> list[float]:
    """The counts that the logistic model weighs; case is ignored."""
    text = (text or "").lower()
    got = hits(lexicon, text)
    if not got:
        return [0.0] * N_FEATURES
    open_, quoted = [h for h in got if not h[4]], [h for h in got if h[4]]
    exact, fuzzy = [h for h in open_ if not h[3]], [h for h in open_ if h[3]]
    close = densest([h[0] for h in open_])
    total = sum(weights[h[2]] for h in exact)
    around = [sum(context.get(x, 0.0) for x in h[5]) for h in got] if context else [0.0]
    return [
        float(bool(exact)),
        math.log1p(len(exact)),
        math.log1p(len({h[2] for h in exact})),
        float(bool(fuzzy)),
        math.log1p(len(fuzzy)),
        math.log1p(len(quoted)),
        math.log1p(close),
        math.log1p(max(0.0, total)),
        math.log1p(1000.0 * len(exact) / max(40, len(text))),
        max(0.0, min(10.0, max(around))),
        max(0.0, min(10.0, -min(around))),
    ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights with the intercept first, by damped Newton steps with a ridge on all but the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * v @ keep @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled_labels(labels: DataFrame, label: str, bound: int, fold: int, skip: int) -> tuple[DataFrame, int]:
    """(__gs_id, __gs_y): about `bound` labelled ids at most, none with crc32(id) % fold == skip; their number before sampling."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != skip))
        .groupBy(F.col("doc_id").cast("string").alias("__gs_id"))
        .agg(F.max(F.col(label).cast("int")).alias("__gs_y"))
    )
    n = known.count()
    return (known.where(unit_hash(F.lit("sample"), F.col("__gs_id")) < bound / n) if n > bound else known), n


def _terms(df: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(term, n): texts that have a word, or with a "*" a word with this beginning, summed within each task first."""

    def run(batches):
        count: dict[str, int] = {}

        def rows():
            out = pa.RecordBatch.from_pydict({"term": list(count), "n": pa.array(list(count.values()), pa.int64())})
            count.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                got = set()
                for w in set(WORD.findall((x.as_py() or "").lower())):
                    got.add(w)
                    got.update(w[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
                for t in got if wanted is None else got & wanted:
                    count[t] = count.get(t, 0) + 1
                if len(count) > 500_000:
                    yield rows()
        if count:
            yield rows()

    return df.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _ratio(a: float, n: float, b: float, m: float) -> float:
    """Likelihood ratio (G squared) of a in n against b in m."""
    g = 0.0
    for got, of in ((a, n), (b, m)):
        for seen, share in ((got, (a + b) / (n + m)), (of - got, 1 - (a + b) / (n + m))):
            if seen > 0:
                g += 2 * seen * math.log(seen / (of * share))
    return g


def _enough(tested: int) -> float:
    """The likelihood ratio that one term must have where so many are tested: exp(-x / 2) bounds the tail of chi-square."""
    return 2 * math.log(max(1, tested) / ACCIDENT)


def _odds(a: float, n: float, b: float, m: float) -> float:
    return math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> tuple[list[str], list[float]]:
    """Words and stems that are significantly toxic; pos and neg count texts by term, stems with a "*".

    A beginning is a stem if at least LEAST_WORDS toxic words have it and none of its longer beginnings has nearly all
    of its toxic texts; of nested stems the shortest holds. Words that a stem covers are left to it.
    """
    least = _enough(len(pos))
    good = {t for t, n in pos.items() if _odds(n, n_pos, neg.get(t, 0), n_neg) >= LEAST_ODDS and _ratio(n, n_pos, neg.get(t, 0), n_neg) >= least}
    words = [t for t in pos if not t.endswith("*")]
    having: dict[str, int] = {}
    longer: dict[str, int] = {}
    for w in words:
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            having[w[:k]] = having.get(w[:k], 0) + 1
    for t in pos:
        if t.endswith("*"):
            up = t[:-2]
            longer[up] = max(longer.get(up, 0), pos[t])
    stems = sorted((t[:-1] for t in good if t.endswith("*")), key=lambda t: (len(t), t))
    kept: set[str] = set()
    for t in stems:
        one_word = pos.get(t, 0) >= 0.8 * pos[t + "*"]
        if having.get(t, 0) >= LEAST_WORDS and not one_word and longer.get(t, 0) < 0.95 * pos[t + "*"] and not any(t[:k] in kept for k in range(SHORTEST, len(t))):
            kept.add(t)
    whole = {t for t in good if not t.endswith("*") and not any(t[:k] in kept for k in range(SHORTEST, min(LONGEST, len(t)) + 1))}
    chosen = sorted(whole | {t + "*" for t in kept})
    return chosen, [_odds(pos[t], n_pos, neg.get(t, 0), n_neg) for t in chosen]


class Model:
    """entries with log odds, weights of the logistic model, weights of context words, and words that are no misspellings."""

    def __init__(self, entries: list[str], odds: list[float], weights: list[float], context: dict[str, float] | None = None, ordinary: frozenset[str] = frozenset()):
        self.entries, self.odds, self.weights, self.context, self.ordinary = entries, odds, weights, context or {}, ordinary

    def lexicon(self) -> Lexicon:
        return Lexicon(self.entries, self.ordinary)

    def logits(self, made: list[Lexicon], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The evidence of texts and what the logistic model makes of it; `made` holds the lexicon between calls."""
        if not made:
            made.append(self.lexicon())
        x = np.array([evidence(made[0], self.odds, t, self.context) for t in texts]).reshape(len(texts), N_FEATURES)
        return x, self.weights[0] + x @ np.array(self.weights[1:])


def _misspelt(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word), distinct: words that match an entry with an error only."""

    def run(batches):
        for batch in batches:
            got = {w for x in batch.column(0) for w in set(WORD.findall((x.as_py() or "").lower())) if (h := lexicon.find(w)) is not None and h[1]}
            yield pa.RecordBatch.from_pydict({"word": pa.array(sorted(got), pa.string())})

    return df.mapInArrow(run, "word string").distinct()


def _surroundings(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(sign, n): texts with a hit that have a context word near one; the empty sign counts the texts."""

    def run(batches):
        count: dict[str, int] = {}
        for batch in batches:
            for x in batch.column(0):
                got = hits(lexicon, (x.as_py() or "").lower())
                for sign in {"", *(c for h in got for c in h[5])} if got else ():
                    count[sign] = count.get(sign, 0) + 1
        if count:
            yield pa.RecordBatch.from_pydict({"sign": list(count), "n": pa.array(list(count.values()), pa.int64())})

    return df.mapInArrow(run, "sign string, n long").groupBy("sign").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    known, _ = sampled_labels(labels, "toxic", max_train, 5, 0)
    # The sample's bound is what makes this broadcast safe; one text of an id keeps the bound where ids repeat.
    texts = docs.select(F.col(id_col).cast("string").alias("__gs_id"), F.col(text_col).alias("text"))
    rows = Cut(texts.join(F.broadcast(known), "__gs_id").groupBy("__gs_id", "__gs_y").agg(F.min("text").alias("text")).select("text", "__gs_y"))
    size = {r[0]: r[1] for r in rows.df.groupBy("__gs_y").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        rows.drop()
        return Model([], [], [-5.0] + [0.0] * N_FEATURES)
    toxic, other = (rows.df.where(F.col("__gs_y") == y).select("text") for y in (1, 0))
    # Terms of one text or two are significant in no sample.
    pos = {r.term: r.n for r in _terms(toxic, None).where(F.col("n") >= 2).toLocalIterator()}
    neg = {r.term: r.n for r in _terms(other, frozenset(pos)).toLocalIterator()}
    entries, odds = choose(pos, neg, n_pos, n_neg)
    ordinary = frozenset(r.word for r in _misspelt(other, Lexicon(entries)).collect())
    lexicon = Lexicon(entries, ordinary)
    near, far = ({r.sign: r.n for r in _surroundings(part, lexicon).collect()} for part in (toxic, other))
    n, m = near.pop("", 0), far.pop("", 0)
    signs = {x for x in near.keys() | far.keys() if n and m and _ratio(near.get(x, 0), n, far.get(x, 0), m) >= _enough(len(near.keys() | far.keys()))}
    context = {x: _odds(near.get(x, 0), n, far.get(x, 0), m) for x in sorted(signs)}

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(1), [evidence(lexicon, odds, x.as_py(), context) for x in batch.column(0)]]

    got = map_arrow(rows.df, "y int, x array<double>", run).groupBy("y", "x").count().orderBy("y", "x").collect()
    x, y, times = (np.array([r[k] for r in got], float) for k in (1, 0, 2))
    rep = np.repeat(np.arange(len(got)), times.astype(int))
    weights = logistic(x[rep], y[rep])
    rows.drop()
    return Model(entries, odds, [float(v) for v in weights], context, ordinary)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_exact, n_fuzzy, n_quoted) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made: list[Lexicon] = []

    def make(batch: pa.RecordBatch) -> list:
        x, logits = model.logits(made, [t.as_py() for t in batch.column(1)])
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        counts = [pa.array(np.expm1(x[:, k]).round().astype(np.int64)) for k in (1, 4, 5)]
        return [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *counts]

    return map_arrow(rows, f"doc_id {kind_of(docs, id_col)}, score double, predicted int, n_exact long, n_fuzzy long, n_quoted long", make)


def reject_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score under 0.5, decided row by row without a shuffle; columns as in docs."""
    fields = docs.schema
    at = fields.fieldNames().index(text_col)
    made: list[Lexicon] = []

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.logits(made, [t.as_py() for t in batch.column(at)])[1] < 0))

    return docs.mapInArrow(run, fields)
