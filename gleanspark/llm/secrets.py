"""Secret scans: base patterns, and formats learned by grammar inference.

The base patterns label credentials. From a bounded sample of labelled credentials of each kind a prefix
tree of character classes is built, and states whose outgoing frequencies are statistically compatible
(Hoeffding's bound) are merged, frequent states first, into a probabilistic automaton. Every
candidate of the whole text - a maximal run of credential characters outside the base spans, of any length
from six on, also without the punctuation at its ends - is scored by the mean log-likelihood of its format
under the automata, against the same for ordinary runs. Candidates that a credential automaton explains
better, and as well as the labelled credentials themselves, are added as spans of kind "format".

What is ordinary is learned from words of letters first, and then from these and those other runs that
no automaton explains better than the words do. So an unlabelled credential is not made ordinary by being frequent.

Base spans stay as they are. Defined cases: a null text is empty; texts of any length are read whole, and runs of
any length are scored; spans count code points, end exclusive; several spans at one start are in the order
of the kinds; without any labelled credential nothing is added; repeated rows are scanned each on its own, and each
counts in learning; further columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, kind_of, map_arrow, unit_hash

#: The base patterns, on the bytes of the text.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Candidates in the shape of a text: the characters and the least length of labelled values.
CANDIDATE = re.compile(rb"[dhlHL+/_.=-]{6,}")
#: Shapes of ordinary words: lower case or capitalised letters, joined by hyphens, a full stop at most behind them.
_WORD = re.compile(r"[HL]?[hl]+(?:-[HLhl]?[hl]+)*\.?")
_EDGE = "._-/+="
#: Bounds of the sample that is learned from, for each kind: formats, and their signs all together.
MAX_LABELLED, MAX_SIGNS = 4000, 1_000_000
ALPHA = 0.05
#: A state seen less often says nothing against a merge.
LEAST_SEEN = 4


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start and kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def credentials(text: bytes) -> list[tuple[int, bytes]]:
    """(kind, value) of the base spans; of an assignment the value is group 2."""
    out = [(0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out + [(1, m[0]) for m in ACCESS.finditer(text)] + [(2, m[0]) for m in HEX.finditer(text)]


def _class(c: int) -> int:
    """d digit, h a-f, l other lower case, H A-F, L other upper case, a sign itself, a space for what stands in no value."""
    for sign, members in ((b"d", b"0123456789"), (b"h", b"abcdef"), (b"H", b"ABCDEF"), (b"l", bytes(range(0x61, 0x7B))), (b"L", bytes(range(0x41, 0x5B)))):
        if c in members:
            return sign[0]
    return c if c in b"+/_.=-" else 0x20


_CLASSES = bytes(_class(c) for c in range(256))
_SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "L": 20}


def shape(value: bytes) -> str:
    return value.translate(_CLASSES).decode("ascii")


class Automaton:
    """A probabilistic automaton by state merging. states: {symbol: (count, next)}, stops: endings per state."""

    def __init__(self, counts: dict[str, int], alpha: float = ALPHA):
        self.arcs: list[dict[str, list[int]]] = [{}]
        self.stops: list[int] = [0]
        self.alpha = alpha
        for text, n in sorted(counts.items()):
            at = 0
            for c in text:
                arc = self.arcs[at].get(c)
                if arc is None:
                    self.arcs.append({})
                    self.stops.append(0)
                    arc = self.arcs[at][c] = [0, len(self.arcs) - 1]
                arc[0] += n
                at = arc[1]
            self.stops[at] += n
        self.totals = [n + sum(a[0] for a in arcs.values()) for n, arcs in zip(self.stops, self.arcs)]
        self._merge_all()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        if not n or not m:
            return False
        return abs(x / n - y / m) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        """Tests all pairs of states that the two reach alike. What lies below b is a tree, so this ends."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.totals[a], self.totals[b]
            if min(n, m) < LEAST_SEEN:
                continue
            if self._differ(self.stops[a], n, self.stops[b], m):
                return False
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                x, y = self.arcs[a].get(c), self.arcs[b].get(c)
                if self._differ(x[0] if x else 0, n, y[0] if y else 0, m):
                    return False
                if x and y and x[1] != y[1]:
                    stack.append((x[1], y[1]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Folds the tree below b into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.stops[a] += self.stops[b]
            self.totals[a] += self.totals[b]
            for c, (n, to) in self.arcs[b].items():
                if c in self.arcs[a]:
                    self.arcs[a][c][0] += n
                    if self.arcs[a][c][1] != to:
                        stack.append((self.arcs[a][c][1], to))
                else:
                    self.arcs[a][c] = [n, to]

    def _merge_all(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.arcs[0])]
        while blue:
            blue.sort(key=lambda x: -self.arcs[x[0]][x[1]][0] if x[1] in self.arcs[x[0]] else 0)
            at, c = blue.pop(0)
            to = self.arcs[at][c][1]
            if to in red:
                continue
            home = next((r for r in red if self._compatible(r, to)), None)
            if home is None:
                red.append(to)
                blue += [(to, x) for x in sorted(self.arcs[to])]
            else:
                self.arcs[at][c][1] = home
                self._merge(home, to)
                known = set(red)
                blue = [(r, x) for r in red for x in sorted(self.arcs[r]) if self.arcs[r][x][1] not in known]

    def mean_log(self, text: str) -> float:
        """Mean log-likelihood per symbol, the ending included; classes are spread over their characters."""
        at, total = 0, 0.0
        for c in text:
            n = self.totals[at] if at >= 0 else 0
            arc = self.arcs[at].get(c) if at >= 0 else None
            total += math.log(((arc[0] if arc else 0) + 0.01) / (n + 0.2)) - math.log(_SIZE.get(c, 1))
            at = arc[1] if arc else -1
        stop = (self.stops[at] + 0.01) / (self.totals[at] + 0.2) if at >= 0 else 0.05
        return (total + math.log(stop)) / (len(text) + 1)


class Model:
    """Automata of the credential kinds, one of ordinary runs, and the least score of each kind."""

    def __init__(self, kinds: list[Automaton], plain: Automaton | None, least: list[float]):
        self.kinds, self.plain, self.least = kinds, plain, least

    def margin(self, text: str) -> float | None:
        """By how much a credential automaton explains a shape better than the ordinary one, a sign; None if none accepts it."""
        usual = self.plain.mean_log(text) if self.plain else -math.inf
        best = max((got for a, low in zip(self.kinds, self.least) if (got := a.mean_log(text)) >= low), default=-math.inf)
        if best <= usual:
            return None
        return best - usual if usual > -math.inf else -best

    def accepts_shape(self, text: str) -> bool:
        return self.margin(text) is not None

    def part(self, run: str) -> tuple[int, int, float] | None:
        """Start and end, within a run's shape, of what is accepted, and its margin: all of it or all but the punctuation at its ends, whichever has the greater."""
        got = self.margin(run)
        bare = run.strip(_EDGE)
        if 6 <= len(bare) < len(run) and (more := self.margin(bare)) is not None and (got is None or more > got):
            start = len(run) - len(run.lstrip(_EDGE))
            return start, start + len(bare), more
        return None if got is None else (0, len(run), got)


def outside(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, bytes]]:
    """(start, shape) of the candidates that touch no base span, in one walk along both; spans ascend by start."""
    found = CANDIDATE.finditer(text.translate(_CLASSES))
    if not spans:
        return [(m.start(), m[0]) for m in found]
    out, k, upto = [], 0, 0
    for m in found:
        while k < len(spans) and spans[k][0] < m.end():
            upto = max(upto, spans[k][1])
            k += 1
        if upto <= m.start():
            out.append((m.start(), m[0]))
    return out


_KNOWN = 200_000


def _added(text: bytes, spans: list[tuple[int, int, int]], known: dict[bytes, tuple[int, int, float] | None], model: Model) -> tuple[list[tuple[int, int, int]], float | None]:
    """Spans of accepted candidates and their greatest margin; `known` remembers what was said of a shape."""
    if not model.kinds:
        return [], None
    if len(known) >= _KNOWN:
        known.clear()
    shapes = set(CANDIDATE.findall(text.translate(_CLASSES)))
    for run in shapes.difference(known):
        known[run] = model.part(run.decode("ascii"))
    if not any(known[run] for run in shapes):
        return [], None
    out, best = [], None
    for start, run in outside(text, spans):
        if part := known[run]:
            out.append((start + part[0], start + part[1], 3))
            best = part[2] if best is None else max(best, part[2])
    return out, best


def _samples(shapes: DataFrame, kinds: range, max_labelled: int, max_signs: int) -> list[dict[str, int]]:
    """Formats of each kind with their counts, drawn by a hash; each that still fits into the kind's signs."""
    drawn = shapes.select("kind", "shape", "n", F.length("shape").alias("len"), unit_hash(F.lit("shape"), F.col("shape")).alias("draw"))
    first = [drawn.where(F.col("kind") == k).orderBy("draw", "shape").limit(max_labelled).select("kind", "draw", "len") for k in kinds]
    taken: list[set[float]] = [set() for _ in kinds]
    left = [max_signs] * len(kinds)
    for r in sorted(reduce(DataFrame.unionByName, first).collect()):
        if r.len <= left[r.kind]:
            taken[r.kind].add(r.draw)
            left[r.kind] -= r.len
    # What can't have been taken is left out before it comes to the driver.
    wanted = [(F.col("kind") == k) & (F.col("draw") <= max(t)) & (F.col("len") <= max_signs - left[k]) for k, t in zip(kinds, taken) if t]
    out: list[dict[str, int]] = [{} for _ in kinds]
    if wanted:
        for r in drawn.where(reduce(lambda a, b: a | b, wanted)).toLocalIterator():
            if r.draw in taken[r.kind]:
                out[r.kind][r.shape] = r.n
    return out


def _least(automaton: Automaton, counts: dict[str, int]) -> float:
    """The score that a credential must have: that of the lowest 20th of those learned from, less its distance to their median, since new ones score lower."""
    scored = sorted((automaton.mean_log(s), n) for s, n in counts.items())
    total, upto, low = sum(counts.values()), 0, None
    for got, n in scored:
        upto += n
        if low is None and 20 * upto >= total:
            low = got
        if 2 * upto >= total:
            return low - (got - low)
    return low


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Automata from at most about `max_labelled` labelled formats and as many ordinary runs, drawn by a hash."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py() or b""
                known = credentials(text)
                count.update((kind, shape(value).encode()) for kind, value in known)
                runs = (r for _, r in outside(text, base_spans(text))) if known else CANDIDATE.findall(text.translate(_CLASSES))
                count.update((3, r) for r in runs)
                if len(count) >= 100_000:
                    yield _counted(count)
                    count.clear()
        if count:
            yield _counted(count)

    shapes = rows.mapInArrow(run, "kind int, shape string, n long").groupBy("kind", "shape").agg(F.sum("n").alias("n"))
    cut = Cut(shapes)
    picked = _samples(cut.df, range(5), max_labelled, MAX_SIGNS)
    cut.drop()
    kinds = [Automaton(c) for c in picked[:3] if c]
    least = [_least(a, c) for a, c in zip(kinds, [c for c in picked[:3] if c])]
    words = Model(kinds, Automaton(picked[3]) if picked[3] else None, least)
    other = {s: n for s, n in picked[4].items() if not words.accepts_shape(s)}
    usual = {s: picked[3].get(s, 0) + other.get(s, 0) for s in picked[3].keys() | other.keys()}
    return Model(kinds, Automaton(usual) if usual else None, least)


def _counted(count: Counter) -> pa.RecordBatch:
    """Rows of a kind, a shape and its count; of runs outside the base spans ordinary words are kind 3, others 4."""
    rows = [(k, s.decode("ascii"), n) for (k, s), n in count.items()]
    kinds = [k if k < 3 or _WORD.fullmatch(s) else 4 for k, s, _ in rows]
    return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "shape": [s for _, s, _ in rows], "n": pa.array([n for *_, n in rows], pa.int64())})


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[str]:
    """kind:start:end in code points, in the order given."""
    if not spans:
        return []
    if text.isascii():
        return [f"{KINDS[k]}:{a}:{b}" for a, b, k in spans]
    marks = sorted({x for a, b, _ in spans for x in (a, b)})
    at, before, upto = {}, 0, 0
    for m in marks:
        upto += len(text[before:m].decode("utf-8", "replace"))
        at[m], before = upto, m
    return [f"{KINDS[k]}:{at[a]}:{at[b]}" for a, b, k in spans]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, format_score).

    format_score: the greatest margin, in nats a sign, by which an added span is a credential rather than ordinary; null without one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    known: dict[bytes, tuple[int, int, float] | None] = {}

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for x in batch.column(1):
            text = x.as_py() or b""
            base = base_spans(text)
            more, best = _added(text, base, known, model)
            every = sorted(base + more, key=lambda s: (s[0], s[2], s[1])) if more else base
            n = [sum(1 for s in base if s[2] == k) for k in range(3)]
            digest = hashlib.sha256(",".join(_points(text, base)).encode()).hexdigest()
            out.append((*n, digest, ",".join(_points(text, every)), len(more), best))
        return [batch.column(0), *map(list, zip(*out))]

    return map_arrow(rows, f"doc_id {kind_of(docs, id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, format_score double", make)
