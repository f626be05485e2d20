"""Operators over whole tables: mixing, sharding, language, toxicity, quality, and the pipeline."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from conftest import crc
from pyspark.sql import functions as F

from gleanspark.llm import langid, mixing, quality, sharding, toxicity

DATA = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1)):
    """Sharing with caps at 3 times the size, the excess reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def corpus(rng, sources, n):
    rows = []
    for i in range(n):
        s = rng.choice(sources)
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(3, 1.2))), s))
    return rows


def test_targets_equal_plain(spark):
    rng = random.Random(1)
    for case in range(6):
        sizes = {s: rng.choice([0, 1, 7, 100, 5000, 10**6]) for s in ["b", "a", "é", "Z", None, "", "c"][: 3 + case % 5]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long").select(mixing.source_key(F.col("source")).alias("key"), "source", "source_size")
        got = {r.key: r.target for r in mixing.targets(df.select("key", "source_size")).collect()}
        for s, t in plain_targets(sizes).items():
            assert got["1" if s is None else "0" + s] == pytest.approx(t, rel=1e-9, abs=1e-9), sizes


def test_mix(make):
    rng = random.Random(2)
    rows = corpus(rng, ["a"] * 6 + ["b", "c", "d", "e", None], 3000) + [(9001, None, "a"), (9002, "", "empty"), (9003, " \n", None), (None, "one two", "b"), (9004, "x " * 50_000, "c")]
    docs = make(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    source = {i: s for i, _, s in rows}
    taken, target = {}, plain_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in target.items():
        largest = max((len((x or "").split()) for _, x, y in rows if y == s), default=0)
        assert abs(taken[s] - t) <= largest, (s, taken[s], t)


def test_rates_solve_the_dual(spark):
    """The Newton solution meets its constraint, and its rates are the tilted ones."""
    rng = random.Random(3)
    sizes = [1 + int(rng.lognormvariate(4, 1)) for _ in range(500)]
    mean = sum(sizes) / len(sizes)
    for share in (0.01, 0.5, 1.0, 2.0, 2.999):
        hist = spark.createDataFrame([("0a", s, 1) for s in sizes], "key string, size long, n long")
        wanted = spark.createDataFrame([("0a", sum(sizes), 5.0, share * sum(sizes), mean)], "key string, source_size long, weight double, target double, mean double")
        lam = mixing.multipliers(hist, wanted).df.first()["lambda"]
        got = sum(s * min(3.0, math.exp(min(30, lam * (s / mean) ** (1 - mixing.POWER)))) for s in sizes)
        assert got == pytest.approx(share * sum(sizes), rel=1e-6)


def test_mixed_documents_are_the_copies(make):
    docs = make(corpus(random.Random(4), ["a", "b", None], 300))
    n = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == n


def test_mix_of_nothing(make):
    assert mixing.mix(make([])).count() == 0 and mixing.mixed_documents(make([])).count() == 0
    assert [tuple(r)[1:] for r in mixing.mix(make([(1, None, None)])).collect()] == [(0, 0, 0.0, 0, 0)]


def test_one_source_takes_itself(make):
    got = mixing.mix(make([(i, "a b c", "s") for i in range(40)])).collect()
    assert all(r.taken == 3 for r in got)


def test_shards(make):
    rows = [(i, "é" * (i % 7)) for i in range(2000)] + [(7, "x"), (7, "x"), (None, None), (None, "y"), (-5, "z" * 100_000)]
    docs = make(rows)
    got = sharding.shards(docs).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    moved = sum(r.grown_shard == 40 for r in got)
    assert 20 <= moved <= 90
    grown = {r.doc_id: r.shard for r in sharding.shards(docs, n_shards=41).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)


def test_shard_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    n = {r.shard: r["count"] for r in sharding.assign(df, weights=[1.0, 3.0]).groupBy("shard").count().collect()}
    assert 2.5 < n[1] / n[0] < 3.6
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [1.0, 0.0])


def test_shards_equal_plain_rendezvous(make):
    """The highest score of all shards, written out, with weights; one repeated row is numbered without gaps."""
    import hashlib

    rows = [(i, "t") for i in range(300)] + [(None, "n")] + [(5, "hot")] * 400
    weights = [1.0, 2.0, 0.5, 1.0]

    def plain(key, w):
        draw = lambda k: (int(hashlib.md5((f"k{key}" if key is not None else "").encode() + f":{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max(range(len(w)), key=lambda k: (w[k] / -math.log(draw(k)), -k))

    got = sharding.shards(make(rows), weights=weights).collect()
    assert all(r.shard == plain(r.doc_id, weights) and r.grown_shard == plain(r.doc_id, [*weights, 1.0]) for r in got)
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_shards_of_nothing(make):
    assert sharding.shards(make([])).count() == 0


# ------------------------------------------------------------------------------------ language

LANGUAGES = {"en": "the there with house this thing other water".split(), "de": "der haus nicht schön über zeit strasse".split(), "fr": "le maison été où français être".split()}


def spoken(rng, n):
    return [(i, " ".join(rng.choices(LANGUAGES[lang], k=rng.randrange(3, 30))), None, lang) for i in range(n) for lang in [rng.choice(list(LANGUAGES))]]


def test_language(make):
    rows = spoken(random.Random(5), 400) + [(900, None), (901, "123 — 45!"), (902, ""), (903, "the " * 50_000), (904, "und " + "x" * 3000), (905, "—é")]
    docs = make(rows)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, _, lang in rows[:400] if crc(i, 5) == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "en"
    assert got[904].lang_pred in LANGUAGES and got[905].lang_pred in LANGUAGES
    assert all(0 <= r.score <= 1 for r in got.values())
    swapped = make([(i, t, s, "zz" if crc(i, 5) == 0 else lang) for i, t, s, lang in [(*r, None, None)[:4] for r in rows]])
    assert {r.doc_id: r.lang_pred for r in langid.predict(swapped, langid.train(swapped)).collect()} == {i: r.lang_pred for i, r in got.items()}


def brute_probability(word, prob):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    return sum(p * brute_probability(word[len(piece) :], prob) for piece, p in prob.items() if word.startswith(piece))


def test_forward_equals_all_segmentations():
    counts = {"a": {b"abab": 5, b"ba": 2, b"aab": 1}, "b": {b"bbb": 4, b"ab": 1}}
    langs, trie, column = langid.fit(counts, [b"ab", b"ba", b"bb", b"aba"])
    scorer = langid.Scorer(trie.next, column)
    words = [b"abab", b"ba", b"b", b"aabba", b"zz"]
    got = scorer.log_words(words)
    for k in range(len(langs)):
        prob = {p: column[list(trie.piece).index(i), k] for i, p in enumerate(trie.pieces)}
        for w, row in zip(words, got):
            assert math.exp(row[k]) == pytest.approx(brute_probability(w, prob), rel=1e-9)


def log_probability(word, prob, longest):
    """The same for words of any length, with exact fractions."""
    from fractions import Fraction

    sums = [Fraction(1)] + [Fraction(0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            if word[i:j] in prob:
                sums[j] += sums[i] * Fraction(prob[word[i:j]])
    total = sums[-1]
    return math.log(total.numerator) - math.log(total.denominator)


def test_long_words_and_pieces_are_summed_whole():
    """A word of 300 bytes, where plain doubles have no sum, and pieces longer than six bytes."""
    long_piece = b" abracadabrasupercalifragilistic"
    counts = {"a": {b" abab": 5, long_piece + b"ab": 3}, "b": {b" bbb" * 1: 4, b" ab": 1, b" " + "日本語".encode() * 4: 2}}
    langs, trie, column = langid.fit(counts, [b" a", b"ab", b"bb", long_piece, "日本語".encode()])
    assert long_piece in trie.pieces and "日本語".encode() in trie.pieces and b" a" in trie.pieces
    scorer = langid.Scorer(trie.next, column)
    words = [b" " + b"ab" * 150, long_piece + b"abab", b" " + "日本語".encode() * 30, b" " + bytes(range(0x80, 0xF0))]
    got = scorer.log_words(words)
    for k in range(len(langs)):
        prob = {p: column[list(trie.piece).index(i), k] for i, p in enumerate(trie.pieces)}
        for w, row in zip(words, got):
            assert row[k] == pytest.approx(log_probability(w, prob, 40), rel=1e-9)


def test_vocabulary_is_used_whole():
    """Every piece of the file that is letters, with or without a space in front, whatever its length."""
    import base64

    pieces = langid.read_pieces()
    letters = set()
    with open(langid.VOCABULARY, "rb") as f:
        for line in f:
            p = base64.b64decode(line.split()[0])
            bare = p[1:] if p.startswith(b" ") else p
            if bare and all(0x61 <= c <= 0x7A for c in bare):
                letters.add(p)
    assert letters <= set(pieces) and len(pieces) > 30_000 and max(map(len, pieces)) > 12
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        langid.read_pieces("/nowhere")


def test_expected_counts_equal_all_segmentations():
    """One round of learning against counts over listed segmentations."""

    def cuts(w, pieces):
        if not w:
            yield []
        for j in range(1, len(w) + 1):
            if w[:j] in pieces:
                for rest in cuts(w[j:], pieces):
                    yield [w[:j], *rest]

    counts = {"a": {b" abab": 5, b" ba": 2}}
    langs, trie, column = langid.fit(counts, [b"ab", b" a", b"bab"], rounds=1)
    size = len(trie.pieces)
    expected = {p: 1e-3 for p in trie.pieces}
    for w, n in counts["a"].items():
        ways = [(c, (1 / size) ** len(c)) for c in cuts(w, set(trie.pieces))]
        total = sum(p for _, p in ways)
        for c, p in ways:
            for piece in c:
                expected[piece] += n * p / total
    every = sum(expected.values())
    for i, p in enumerate(trie.pieces):
        assert column[list(trie.piece).index(i), 0] == pytest.approx(max(langid.FLOOR, expected[p] / every), rel=1e-9)


def test_language_ties_and_repeats(make):
    rows = [(i, "same words here", None, lang) for i, lang in enumerate(["b", "a"] * 20)] + [(500, "same words here")] * 3
    docs = make(rows)
    got = langid.predict(docs, langid.train(docs)).where("doc_id = 500").collect()
    assert len(got) == 3 and len({(r.lang_pred, r.score) for r in got}) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
def test_language_query_equals_plain(spark):
    """Every row of the query, scored again word by word from the exported model."""
    from gleanspark.llm import queries
    from gleanspark.llm.common import table

    docs = table(spark, DATA, "documents")
    model = langid.train(docs)
    scorer = langid.Scorer(model.next, model.prob)
    got = {r.doc_id: r for r in queries.op2_langid(spark, DATA).collect()}
    seen: dict[bytes, np.ndarray] = {}
    for r in docs.select("doc_id", F.lower("text").alias("text")).collect():
        words = langid.cut_words((r.text or "").encode())
        row = got[r.doc_id]
        assert row.held_out == (crc(r.doc_id, 5) == 0)
        if not langid.has_letter((r.text or "").encode()):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        total = np.zeros(len(model.langs))
        for w in words:
            if w not in seen:
                p = np.exp(scorer.log_words([w])[0])
                p = p / p.max()
                seen[w] = np.log((1 - langid.FOREIGN) * p + langid.FOREIGN * p.mean())
            total += seen[w]
        p = np.exp(total - total.max())
        p /= p.sum()
        assert row.score == pytest.approx(p.max(), abs=1e-9) and (row.lang_pred == model.langs[int(p.argmax())] or sorted(p)[-2] > p.max() - 1e-9)


def test_language_of_nothing(make):
    docs = make([])
    assert langid.predict(docs, langid.train(docs)).count() == 0
    docs = make([(1, "words", None, None), (3, None, None, "en")])
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()} == {"und"}


# ------------------------------------------------------------------------------------ toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_plain_distances():
    rng = random.Random(6)
    entries = ["idiot", "scum", "moron", "mor*", "clown", "abba", "réeux*", "disgust", "class"]
    lex = toxicity.Lexicon(entries, frozenset(["glass"]))
    words = ["idiot", "idiots", "idoit", "1diot", "idot", "iddiot", "clwn", "scam", "", "i", "réeuxa", "reeuxa", "reeux", "mormon", "mo", "disguts", "glass", "lass", "classy", "classroom", "subclass"]
    words += ["".join(rng.choices("abdilmnorst", k=rng.randrange(9))) for _ in range(400)]
    words += ["".join(c if rng.random() < 0.85 else rng.choice("aeiouxyz") for c in rng.choice(entries).rstrip("*")) + rng.choice(["", "s", "xyz"]) for _ in range(400)]
    for w in words:
        found = lex.find(w)
        exact = w in entries or any(w.startswith(e[:-1]) for e in entries if e.endswith("*"))
        near = w != "glass" and any(distance(e.rstrip("*"), w) == 1 for e in entries if len(e.rstrip("*")) >= toxicity.FUZZY_FROM)
        assert (found is not None) == (exact or near), w
        if found:
            assert found[1] == (0 if exact else 1), w
    assert lex.find("glass") is None and lex.find("classroom") is None and lex.find("x" * 100_000) is None


def test_lexicon_has_no_bounds():
    """Rare, long and many entries; stems only where words share a beginning."""
    pos = {f"abuse{i:04d}word": 9 for i in range(900)} | {"x" * 60: 9}
    pos |= {w[:k] + "*": 9 for w in list(pos) for k in range(3, 13)} | {"abu*": 8100, "abus*": 8100, "abuse*": 8100}
    entries, odds = toxicity.choose(pos, {}, 10_000, 90_000)
    assert "abuse*" in entries and "x" * 60 in entries and all(o >= 3 for o in odds)
    many = {f"{i:03d}zz": 8 for i in range(700)}
    assert len(toxicity.choose(many, {}, 1000, 9000)[0]) == 700
    assert toxicity.choose({"rare": 1}, {}, 1000, 9000)[0] == []


def test_context_is_learned(spark, make):
    """Quotation without marks: the words around a term tell, as far as the labels do."""
    rng = random.Random(30)
    docs, labels = [], []
    for i in range(500):
        filler = rng.choices(GOOD, k=30)
        toxic = i % 2
        docs.append((i, " ".join(filler[:15]) + (" you stinking idiot " if toxic else " our dictionary lists idiot entry ") + " ".join(filler[15:])))
        labels.append((i, 1, toxic))
        if i % 5 == 0:
            docs.append((1000 + i, " ".join(filler)))
            labels.append((1000 + i, 1, 0))
    for i in range(2000, 3500):  # so that the term itself is toxic by odds
        docs.append((i, " ".join(rng.choices(GOOD, k=12))))
        labels.append((i, 1, 0))
    for i in range(4000, 4300):
        docs.append((i, "idiot " + " ".join(rng.choices(GOOD, k=12)) + " stinking"))
        labels.append((i, 1, 1))
    table, lab = make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.Model(["idiot"], [4.0], [0.0] * 12)
    lexicon = model.lexicon()
    got = {r.sign: r.n for r in toxicity._surroundings(table.where("doc_id < 500 and doc_id % 2 = 0").select("text"), lexicon).collect()}
    assert got[""] == 250 and got["dictionary"] == 250
    assert toxicity.evidence(lexicon, [4.0], "our dictionary lists idiot entry", {"dictionary": -2.0, "lists": -1.0})[-1] == 3.0
    trained = toxicity.train(table, lab)
    assert trained.context == {} or trained.context.get("dictionary", 0) <= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
def test_toxicity_query_equals_plain(spark):
    """Every row of the query, scored again by distances to all entries from the exported model."""
    from gleanspark.llm import queries
    from gleanspark.llm.common import table

    docs = table(spark, DATA, "documents")
    model = toxicity.train(docs, table(spark, DATA, "labels"))
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, DATA).collect()}
    known = {}

    def find(w):
        if w not in known:
            known[w] = None
            stems = [i for i, e in enumerate(model.entries) if e.endswith("*") and w.startswith(e[:-1])]
            exact = [i for i, e in enumerate(model.entries) if e.rstrip("*") == w]
            near = [i for i, e in enumerate(model.entries) if len(e.rstrip("*")) >= toxicity.FUZZY_FROM and abs(len(e.rstrip("*")) - len(w)) < 2 and distance(e.rstrip("*"), w) == 1]
            if stems or exact:
                known[w] = ((stems or exact)[0], 0)
            elif near and w not in model.ordinary:
                known[w] = (near[0], 1)
        return known[w]

    class Plain:
        pass

    plain = Plain()
    plain.find = find
    for r in docs.collect():
        z = model.weights[0] + float(np.dot(toxicity.evidence(plain, model.odds, r.text, model.context), model.weights[1:]))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (crc(r.doc_id, 5) == 0)


BAD, GOOD = ["idiot", "scum", "moron"], "the of and house river stone water light under over slowly green seven".split()


def talk(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(GOOD, k=rng.randrange(5, 60))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - toxic, toxic))
    return docs, labels


def test_toxicity(spark, make):
    docs, labels = talk(random.Random(7), 600)
    extra = [(9000, "you m0ron and 1diot and idlot and sc um m0ron idi0t"), (9001, None), (9002, ""), (9003, "the " * 50_000)]
    table = make(docs + extra)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (9003, 1, 7), labels[0]], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, lab)
    assert set(BAD) <= set(model.entries)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if crc(i, 5) == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[9000].n_fuzzy >= 3 and got[9001].score == got[9002].score == got[9003].score < 0.5
    kept = toxicity.reject_toxic(table, model)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    flipped = spark.createDataFrame([(i, q, 1 - t if crc(i, 5) == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert toxicity.train(table, flipped).weights == toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).weights


def test_densest_window():
    rng = random.Random(10)
    for _ in range(100):
        at = sorted(rng.randrange(400) for _ in range(rng.randrange(30)))
        assert toxicity.densest(at, 50) == max((sum(0 <= b - a <= 50 for b in at) for a in at), default=0)
    lex = toxicity.Lexicon(["idiot"])
    assert len(toxicity.evidence(lex, [1.0], "idiot " * 100_000)) == toxicity.N_FEATURES


def test_quotation_is_told_from_abuse():
    lex = toxicity.Lexicon(["idiot"])
    assert [h[4] for h in toxicity.hits(lex, 'you idiot. someone called them "an idiot" once')] == [False, True]
    assert [h[4] for h in toxicity.hits(lex, "the word idiot is old")] == [True]


def test_toxicity_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = make([(1, "idiot"), (2, None)])
    got = toxicity.score(table, toxicity.train(table, none)).collect()
    assert len({r.score for r in got}) == 1
    assert toxicity.score(make([]), toxicity.train(make([]), none)).count() == 0


# ------------------------------------------------------------------------------------- quality


def test_quality(spark, make):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = rng.choices(GOOD, k=rng.randrange(20, 80))
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "$$$" for w in words], [words[0]] * 60])
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    table = make(docs + [(9000, None), (9001, ""), (9002, "\n"), (9003, "a " * 100_000)])
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), labels[1]], "doc_id long, quality int, toxic int")
    model = quality.train(table, lab)
    got = {r.doc_id: r for r in quality.score(table, model).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, q) for i, q, _ in labels if crc(i, 3) == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert 0 < len(model.rules) < 60 and len(model.describe()) == len(model.rules)


def test_compiled_rules_equal_the_model(spark, make):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(GOOD + ["X!", "#", "|"], k=rng.randrange(40))) for _ in range(120)]

    from gleanspark.llm import textstats

    x = np.array([textstats.features(t.encode()) for t in texts])
    y = (x[:, 0] + 5 * x[:, 2] > np.median(x[:, 0] + 5 * x[:, 2])).astype(float)
    model = quality.fit(x, y)
    z = model.intercept + sum(w * quality.holds(x, p) for p, w in model.rules)
    got = {r.doc_id: r.score for r in quality.score(make(list(enumerate(texts))), model).collect()}
    assert [got[i] for i in range(120)] == pytest.approx(list(1 / (1 + np.exp(-z))))


def test_lasso_is_optimal():
    """The conditions of the optimum: no gradient beyond the penalty, and all of it where a weight isn't zero."""
    rng = np.random.default_rng(3)
    a = (rng.random((400, 12)) < 0.4).astype(float)
    y = (a[:, 0] + a[:, 1] - a[:, 2] + rng.normal(0, 0.7, 400) > 0.5).astype(float)
    for penalty in (0.002, 0.02, 0.2):
        b, w = quality.lasso(a, y, penalty, rounds=20_000)
        r = 1 / (1 + np.exp(-(b + a @ w))) - y
        grad = a.T @ r / len(y)
        assert abs(r.mean()) < 1e-4 and np.all(np.abs(grad) <= penalty + 1e-4)
        assert np.allclose(grad[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4)


def test_repeated_documents(spark, make):
    """Rows that repeat an id are all scored; one is learned from."""
    docs, labels = talk(random.Random(12), 150)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = make(docs), make(docs * 3)
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        one, three = module.train(once, lab), module.train(often, lab)
        assert sorted(r.score for r in module.score(once, one).collect()) * 3 != [] and module.score(often, three).count() == 450
        a, b = {r.doc_id: r.score for r in module.score(once, one).collect()}, {r.doc_id: r.score for r in module.score(often, three).collect()}
        assert a == pytest.approx(b)


def test_quality_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(make([(1, None), (2, "x")]), quality.train(make([]), none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    table = make([(0, "a"), (2, "b")])
    assert quality.score(table, quality.train(table, one)).first().score > 0.5


# ------------------------------------------------------------------------------------ pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
def test_pipeline(spark):
    import corpus_pipeline
    from test_similar import plain_kept

    from gleanspark.llm import decontam
    from gleanspark.llm.common import table

    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 0").select("doc_id")
    left = docs.join(scored, "doc_id", "left_semi").select(docs.columns)
    rows = left.select("doc_id", "text").collect()
    stay = plain_kept([(r.doc_id, r.text) for r in rows])
    left = left.where(F.col("doc_id").isin(stay))
    bad = decontam.contamination(left, table(spark, DATA, "benchmark")).where("contaminated").select("doc_id")
    left = left.join(bad, "doc_id", "left_anti").select(docs.columns)
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect() if r.copies}
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "shard"]
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies
    assert out.select("doc_id", "shard").distinct().count() == len(copies)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_take_odd_rows(spark, make, tmp_path):
    """Null ids and texts, repeated rows, a long text, clashing columns, an empty table: what stays, stage by stage."""
    import corpus_pipeline

    docs = make([(1, None), (None, "a b"), (2, ""), (2, ""), (3, "x " * 50_000, "s"), (None, None), (4, "zz yy")])
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "zz yy")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"toxicity": [1, None, 2, 2, 3, None, 4], "near_duplicates": [1, None, 3, None, 4], "decontamination": [1, None, 3, None]}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, str(tmp_path))
        rows = after.collect()
        if name in left:
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, left[name])), name
        if name == "sharding":
            assert after.columns == [*docs.columns, "shard_1"] and all(r.shard == "x" and 0 <= r.shard_1 < 40 for r in rows)
        else:
            assert after.columns == docs.columns
            assert all(r.lang is None and r.shard == r.size == r.key == "x" for r in rows)
        now = spark.createDataFrame(rows, after.schema)
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0


def test_stages_with_hot_rows_and_null_ids_meet_targets(make):
    """A source of null ids and equal rows: 1,000 of 10 words each, taken to within one document."""
    rows = [(None, "ten words " * 5, "a")] * 1000 + [(i, "w " * 40, "b") for i in range(500)] + [(7, "one two three", "c")] * 300
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
    for size, t in target.items():
        assert abs(taken[size] - t) <= {10_000: 10, 20_000: 40, 900: 3}[size]
    docs = make(rows)
    out = mixing.mixed_documents(docs)
    by = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by == {"a": taken[10_000] // 10, "b": taken[20_000] // 40, "c": taken[900] // 3}


def test_rates_equal_a_plain_convex_solver(spark):
    """Least sum of q (r log r - r + 1) under the constraint, by bisection on the multiplier in plain Python."""
    rng = random.Random(31)
    for case in range(4):
        sizes = [1 + int(rng.lognormvariate(3, 1.5)) for _ in range(200)]
        mean, total = sum(sizes) / len(sizes), sum(sizes)
        share = (0.003, 0.4, 1.7, 2.9)[case]
        low, high = -700.0, 1e6
        words = lambda lam: sum(s * min(3.0, math.exp(min(30, lam * (s / mean) ** 0.25))) for s in sizes)
        for _ in range(300):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < share * total else (low, middle)
        hist = spark.createDataFrame([("0a", s, sizes.count(s)) for s in set(sizes)], "key string, size long, n long")
        wanted = spark.createDataFrame([("0a", total, 5.0, share * total, mean)], "key string, source_size long, weight double, target double, mean double")
        assert mixing.multipliers(hist, wanted).df.first()["lambda"] == pytest.approx((low + high) / 2, rel=1e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
@pytest.mark.parametrize("name", ["op4_rules", "op6_sharding", "op7_decontam", "op8_chat"])
def test_query_equals_sql(spark, name):
    import duckdb

    from gleanspark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    sql = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in sql.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
@pytest.mark.parametrize("name", [f"op{i}_" for i in range(1, 11)])
def test_queries_run(spark, name):
    from gleanspark.llm import queries

    query = next(f for n, f in queries.queries().items() if n.startswith(name))
    assert query(spark, DATA).count() > 0
