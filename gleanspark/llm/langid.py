"""Language identification by unigram pieces, marginalised over segmentations.

The pieces are those of a fixed public vocabulary (a tiktoken rank file, whose path is a parameter), as
bytes: all that can stand in a word of letters, in lower case, of any length, and those that begin with a space at the
beginning of a word only; single bytes make every word possible. Each language has a probability for every piece; the
probability of a word is the sum over all its segmentations into pieces, by the forward algorithm over
the whole word, rescaled so that words of any length have a sum. Learning is expectation maximisation: forward and
backward sums give the expected count of each piece in the words of the training texts. A text's
score is the posterior of its likeliest language under equal priors, where each word is of any language
with the chance FOREIGN, which bounds what one word can say (FOREIGN = 0 is the plain posterior).

Learning sees text and lang of rows whose crc32(id) % 5 is not 0, of each language a sample of about
`per_lang` texts at most, drawn by a hash of id and text, and all words of that sample. Words are runs of letters,
lower-cased. Forward sums run over the distinct words of an Arrow batch at once.

Defined cases: a null text, or one without a letter, gets "und" and score 0; so does every text if nothing
could be learned. Equal posteriors go to the language first by code point. Repeated rows are
predicted each on its own, and learned from each if their hash is drawn. Long texts and long words are read whole.
Further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, crc_mod, kind_of, map_arrow, unit_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PER_LANG = 400
ROUNDS = 4
FLOOR = 1e-7
#: Chance that a word is of any language: a quotation in another one must not outweigh the rest of a text.
FOREIGN = 0.1
#: Bytes after which the sums of a word are rescaled.
RESCALE = 12
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORDS = 8192


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a tiktoken rank file that can stand in a word: letters, in lower case, with a space in front or none."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"language identification needs a tiktoken rank file; there is none at {path} (parameter vocabulary)")
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]).decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape") for line in f if line.strip()}
    return sorted(p for p in pieces if (bare := p[p[:1] == b" " :]) and bare.translate(_TABLE) == bare and b" " not in bare)


class Trie:
    """Pieces as a transition table; state 0 is the root, 1 is dead. Bytes that occur in no piece are dead ends."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        nodes: list[dict[int, int]] = [{}, {}]
        ends: dict[int, int] = {}
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                at = nodes[at][c]
            ends[at] = i
        self.next = np.ones((len(nodes), 256), np.int32)
        for at, children in enumerate(nodes):
            for c, to in children.items():
                self.next[at, c] = to
        self.piece = np.full(len(nodes), -1, np.int64)
        for at, i in ends.items():
            self.piece[at] = i


def _walks(next_: np.ndarray, m: np.ndarray, s: int):
    """(k, rows, states) for the words that still follow the trie when bytes s to k have been read."""
    rows = np.arange(len(m))
    state = np.zeros(len(m), np.int32)
    for k in range(s, m.shape[1]):
        state = next_[state, m[rows, k]]
        alive = state != 1
        if not alive.all():
            rows, state = rows[alive], state[alive]
            if not len(rows):
                return
        yield k, rows, state


def _rescale(sums: list[np.ndarray], logs: np.ndarray, window: range) -> None:
    """Divides what later sums depend on by its largest value, for each word and language."""
    most = np.zeros_like(logs)
    for j in window:
        np.maximum(most, sums[j], out=most)
    most[most == 0] = 1
    for j in window:
        sums[j] /= most
    logs += np.log(most)


class Scorer:
    """Log probabilities of words under every language. prob: states x languages."""

    def __init__(self, next_: np.ndarray, prob: np.ndarray):
        self.next, self.prob = next_, prob

    def _matrix(self, words: list[bytes], length: int) -> np.ndarray:
        return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)

    def log_words(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.prob.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, where in by_length.items():
            for k in range(0, len(where), _WORDS):
                at = where[k : k + _WORDS]
                out[at] = self.total(self._matrix([words[i] for i in at], length))
        return out

    def total(self, m: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, words x languages; sums are held as far as the longest walk reaches."""
        n, length = m.shape
        langs = self.prob.shape[1]
        sums: dict[int, np.ndarray] = {0: np.ones((n, langs))}
        logs = np.zeros((n, langs))
        for s in range(length):
            if s and s % RESCALE == 0:
                _rescale(sums, logs, sorted(sums))
            now = sums.pop(s)
            for k, rows, state in _walks(self.next, m, s):
                to = sums.get(k + 1)
                if to is None:
                    to = sums[k + 1] = np.zeros((n, langs))
                if len(rows) == n:
                    to += now * self.prob[state]
                else:
                    to[rows] += now[rows] * self.prob[state]
            if s + 1 not in sums:
                sums[s + 1] = np.zeros((n, langs))
        with np.errstate(divide="ignore"):
            return np.log(sums[length]) + logs


def cut_words(text: bytes) -> list[bytes]:
    """Runs of letters with a space in front of each, which marks the beginning."""
    return [b" " + w for w in text.translate(_TABLE).split()]


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    plain = text.translate(_TABLE).split()
    if any(c < 0x80 for w in plain for c in w[:1]):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _expected(trie: Trie, column: np.ndarray, m: np.ndarray, n: np.ndarray, gathered: np.ndarray) -> None:
    """Adds the expected counts of the pieces in the words m, each n times, under one language; rescaled as in total()."""
    length = m.shape[1]
    walks = [list(_walks(trie.next, m, s)) for s in range(length)]
    ahead, scale = [np.zeros(len(m)) for _ in range(length + 1)], np.zeros((length + 1, len(m)))
    ahead[0][:] = 1
    for s in range(length):
        reach = range(s, min(length, max((w[-1][0] for w in walks[max(0, s - 64) : s + 1] if w), default=s) + 1) + 1)
        if s and s % RESCALE == 0:
            most = np.maximum.reduce([ahead[j] for j in reach])
            most[most == 0] = 1
            for j in reach:
                ahead[j] /= most
            scale[s:] += np.log(most)
        for k, rows, state in walks[s]:
            ahead[k + 1][rows] += ahead[s][rows] * column[state]
    # behind[s] is relative to the end of the word; both are taken in logs against the whole word's sum.
    behind, back = [np.zeros(len(m)) for _ in range(length)] + [np.ones(len(m))], np.zeros((length + 1, len(m)))
    for s in range(length - 1, -1, -1):
        back[s] = back[s + 1]
        for k, rows, state in walks[s]:
            behind[s][rows] += column[state] * behind[k + 1][rows] * np.exp(back[k + 1][rows] - back[s][rows])
        low = (behind[s] > 0) & (behind[s] < 1e-100)
        if low.any():
            back[s][low] += np.log(behind[s][low])
            behind[s][low] = 1.0
    with np.errstate(divide="ignore"):
        log_total = np.log(ahead[length]) + scale[length]
    for s in range(length):
        for k, rows, state in walks[s]:
            i = trie.piece[state]
            ends = i >= 0
            rows, i, p = rows[ends], i[ends], column[state][ends]
            if len(rows):
                share = n[rows] * p * ahead[s][rows] * behind[k + 1][rows] * np.exp(scale[s][rows] + back[k + 1][rows] - log_total[rows])
                np.add.at(gathered, i, np.nan_to_num(share))


def fit(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = ROUNDS) -> tuple[list[str], Trie, np.ndarray]:
    """Languages in order, the trie of the pieces that occur in the words, and the probabilities states x languages."""
    langs = sorted(counts)
    words = {w for c in counts.values() for w in c}
    occur = Trie(sorted(set(pieces)))
    seen: set[int] = set()
    by_length: dict[int, list[bytes]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for length, same in by_length.items():
        m = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), length)
        for s in range(length):
            for _, _, state in _walks(occur.next, m, s):
                seen.update(np.unique(occur.piece[state]).tolist())
    single = {bytes([c]) for c in range(256)}
    trie = Trie(sorted(single | {occur.pieces[i] for i in seen if i >= 0}))
    size = len(trie.pieces)
    prob = np.full((size, len(langs)), 1.0 / size)
    column = np.zeros((len(trie.next), len(langs)))
    ends = trie.piece >= 0
    for _ in range(rounds):
        column[ends] = prob[trie.piece[ends]]
        gathered = np.full((size, len(langs)), 1e-3)
        for k, lang in enumerate(langs):
            of_length: dict[int, list[bytes]] = {}
            for w in counts[lang]:
                of_length.setdefault(len(w), []).append(w)
            for length, same in of_length.items():
                for at in range(0, len(same), _WORDS):
                    part = same[at : at + _WORDS]
                    m = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), length)
                    _expected(trie, column[:, k], m, np.array([counts[lang][w] for w in part], float), gathered[:, k])
        prob = gathered / gathered.sum(axis=0)
        prob = np.maximum(prob, FLOOR)
    column[ends] = prob[trie.piece[ends]]
    return langs, trie, column


class Model:
    def __init__(self, langs: list[str], next_: np.ndarray, prob: np.ndarray):
        self.langs, self.next, self.prob = langs, next_, prob


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, per_lang: int = PER_LANG) -> Model:
    """A model with a row for each state of the pieces that the sample has, and a column for each language."""
    pieces = read_pieces(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    fold = rows.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    size = {r.lang: r[1] for r in fold.groupBy("lang").count().collect()}
    if not size:
        return Model([], np.ones((2, 256), np.int32), np.zeros((2, 0)))
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in size.items() for v in (lang, min(1.0, per_lang / n))]), F.col("lang"))
    drawn = fold.where(unit_hash(F.lit("lang"), F.col("doc_id").cast("string"), F.col("text")) < share)
    words = drawn.select("lang", F.lower("text").cast("binary").alias("text"))

    def run(batches):
        count: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w in cut_words(text.as_py() or b""):
                    count[lang, w] = count.get((lang, w), 0) + 1
        if count:
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in count], "word": [k[1] for k in count], "n": pa.array(list(count.values()), pa.int64())})

    summed = words.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {}
    # The words of a bounded sample of texts.
    for r in summed.toArrow().to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in r.columns)):
            counts.setdefault(lang, {})[word] = n
    if not counts:
        return Model([], np.ones((2, 256), np.int32), np.zeros((2, 0)))
    langs, trie, prob = fit({k: dict(sorted(v.items())) for k, v in counts.items()}, pieces)
    return Model(langs, trie.next, prob)


def posteriors(scorer: Scorer, texts: list[bytes | None], foreign: float = FOREIGN) -> np.ndarray:
    """Rows of posteriors; all zero where a text has no word."""
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    ends = []
    for t in texts:
        flat.extend([ids.setdefault(w, len(ids)) for w in cut_words(t or b"")])
        ends.append(len(flat))
    out = np.zeros((len(texts), scorer.prob.shape[1]))
    if not flat:
        return out
    table = scorer.log_words(list(ids))
    table = np.exp(table - table.max(axis=1, keepdims=True))
    with np.errstate(divide="ignore"):
        table = np.log((1 - foreign) * table + foreign * table.mean(axis=1, keepdims=True))
    flat_ids = np.array(flat, np.int64)
    start = 0
    for i, end in enumerate(ends):
        if end > start:
            total = table[flat_ids[start:end]].sum(axis=0)
            p = np.exp(total - total.max())
            out[i] = p / p.sum()
        start = end
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.next, model.prob))

    def make(batch: pa.RecordBatch) -> list:
        langs, next_, prob = shared.value
        scorer = Scorer(next_, prob)
        names, scores = [], []
        texts = batch.column(1)
        start = 0
        while start < len(texts):
            chunk, held = [], 0
            while start < len(texts) and (not chunk or held < 4_000_000):
                chunk.append(texts[start].as_py())
                held += len(chunk[-1] or b"")
                start += 1
            p = posteriors(scorer, chunk) if langs else np.zeros((len(chunk), 1))
            for t, row in zip(chunk, p):
                known = bool(langs) and row.any() and has_letter(t)
                names.append(langs[int(row.argmax())] if known else "und")
                scores.append(float(row.max()) if known else 0.0)
        return [batch.column(0), names, scores]

    return map_arrow(rows, f"doc_id {kind_of(docs, id_col)}, lang_pred string, score double", make)
