"""Operators that look at one text at a time: rules, secrets, chat, decontamination."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanspark.llm import chat, decontam, rules, secrets, textstats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


SAMPLES = ["", None, "\n\n \n", "a b", "é è\n" * 5, "x y z " * 40, "one # two $$ <b>\n" * 3, "a b c d e f g h a b c d e f g h", "w " * 25, "\x85   x", "no end\n#\n#\n \n ", " ".join(map(str, range(50))) + " " + " ".join(map(str, range(30)))]


def test_rules_equal_plain(make):
    rng = random.Random(2)
    texts = SAMPLES + ["".join(rng.choices("ab \n#é", k=rng.randrange(400))) for _ in range(60)] + ["long " * 100_000]
    got = {r.doc_id: r for r in rules.judge(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, chars, symbols, dup, rep = plain_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)
        assert (r.rejected_by is None) == r.kept


def test_cascade_order_does_not_change_verdicts(make):
    texts = [t.encode() if t is not None else None for t in SAMPLES]
    planned = rules.plan(*rules.measure(texts))
    assert sorted(r.name for r in planned) == sorted(r.name for r in rules.RULES)
    kept = [rules.verdict(rules.Text(t), list(rules.RULES)) is None for t in texts]
    for order in (rules.RULES[::-1], planned):
        assert [rules.verdict(rules.Text(t), list(order)) is None for t in texts] == kept
    docs = make([(i, t) for i, t in enumerate(SAMPLES)] * 2)
    stay = rules.keep(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(2 * [i for i, k in enumerate(kept) if k])
    assert rules.keep(make([])).count() == 0 and rules.judge(make([])).count() == 0


def test_cascade_prefers_rejections_per_cost():
    """Conditional on what is left, and on statistics that are paid for."""
    make = lambda name, *needs: rules.Rule(name, needs, lambda t: True)
    four = (make("dear", "top"), make("never", "words"), make("cheap", "words"), make("same", "symbols"))
    order = rules.plan({"top": 1.0, "words": 0.01, "symbols": 0.02}, {0b0001: 5, 0b1101: 50, 0: 45}, four)
    assert [r.name for r in order] == ["cheap", "never", "dear", "same"] or [r.name for r in order] == ["cheap", "never", "same", "dear"]
    assert rules.plan({"top": 1.0, "words": 0.01, "symbols": 0.02}, {0b0001: 50, 0b0100: 10}, four, ("top",))[0].name == "dear"


def test_cascade_computes_only_what_it_asks_for():
    t = rules.Text(b"short")
    assert rules.verdict(t, list(rules.RULES)) == "too_short"
    assert set(t.__dict__) == {"raw", "words"}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c\n#", max_size=300))
def test_repeat_words_equal_plain(text):
    b = text.encode()
    assert textstats.n_repeat_words(b.split()) == plain_stats(text)[4]


HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def plain_spans(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


SECRETS = [
    None, "", f'é token = "{HEX}" x', "password: abc password:abcdefg", "AKIA" + "Z9" * 8, "AKIAAKIA" + "X" * 5, "AKIA" + "é" + "AKIA" + "Q" * 16, "PASSWD='s3cr3t-Value'",
    "api_key=token=abcdef", "apikey:token:abcdef", f"{HEX}{HEX}g", "Key toKen = abcdefgh", "ſecret=abcdefgh", f"token={HEX[:5]} {HEX}", "日本 " + HEX + " 語 token=" + HEX,
]


def test_secret_base_spans_equal_plain(make):
    docs = make(list(enumerate(SECRETS)))
    got = {r.doc_id: r for r in secrets.scan(docs, secrets.train(docs)).collect()}
    for i, t in enumerate(SECRETS):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [base.count(k) for k in secrets.KINDS[:3]]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("format")] == [s for s in base.split(",") if s]


def test_grammar_finds_unlabelled_formats(make):
    rng = random.Random(4)

    def cred():
        return "sk-" + "".join(rng.choices("0123456789", k=6)) + "-" + "".join(rng.choices("GHJKLMNPQRSTVWXYZ", k=14))

    labelled = [(i, f"token={cred()} and words that mean nothing") for i in range(200)]
    plain = [(1000 + i, "see chapter-" + "".join(rng.choices("abcdefghij", k=12)) + "2 or page-number-listing-" + str(rng.randrange(9))) for i in range(200)]
    hidden = [(5000 + i, f"nobody knows {cred()} here") for i in range(60)]
    docs = make(labelled + plain + hidden)
    got = {r.doc_id: r for r in secrets.scan(docs, secrets.train(docs)).collect()}
    found = {i for i, r in got.items() if r.n_format}
    assert len(found & {5000 + i for i in range(60)}) >= 54  # recall
    assert all(i >= 5000 for i in found)  # precision
    assert all((r.format_score is not None and r.format_score > 0) == bool(r.n_format) for r in got.values())


def plain_mean_log(automaton, text):
    """The path of a text through an automaton, written out state by state."""
    sizes = {"d": 10, "h": 6, "l": 20, "H": 6, "L": 20}
    state, logs = 0, []
    for c in text:
        if state is None:
            seen, to, total = 0, None, 0
        else:
            total = automaton.stops[state] + sum(n for n, _ in automaton.arcs[state].values())
            seen, to = automaton.arcs[state].get(c, (0, None))
        logs.append(math.log((seen + 0.01) / (total + 0.2) / sizes.get(c, 1)))
        state = to
    if state is None:
        logs.append(math.log(0.05))
    else:
        total = automaton.stops[state] + sum(n for n, _ in automaton.arcs[state].values())
        logs.append(math.log((automaton.stops[state] + 0.01) / (total + 0.2)))
    return sum(logs) / len(logs)


def plain_format_spans(text, model):
    """All runs of the text against all base spans, by code points."""
    base = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(text).split(",") if s]
    classes = lambda v: "".join("d" if c in "0123456789" else "h" if c in "abcdef" else "H" if c in "ABCDEF" else "l" if "g" <= c <= "z" else "L" if "G" <= c <= "Z" else c for c in v)

    def wins(v):
        scores = [x for x, low in ((plain_mean_log(a, classes(v)), low) for a, low in zip(model.kinds, model.least)) if x >= low - 1e-9]
        return max(scores, default=-math.inf) - plain_mean_log(model.plain, classes(v))

    out = []
    for m in re.finditer("[A-Za-z0-9+/_.=-]{6,}", text):
        if any(a < m.end() and m.start() < b for a, b in base):
            continue
        bare = m[0].strip("._-/+=")
        whole, less = wins(m[0]), wins(bare) if 6 <= len(bare) < len(m[0]) else 0
        if whole > 0 and whole >= less:
            out.append(f"format:{m.start()}:{m.end()}")
        elif less > 0:
            at = m.start() + m[0].index(bare)
            out.append(f"format:{at}:{at + len(bare)}")
    return out


def test_format_spans_equal_plain(make):
    """Of every row, repeats and long texts included, learned on the same rows."""
    rng = random.Random(21)
    cred = lambda: "key_" + "".join(rng.choices("0123456789", k=8)) + "." + "".join(rng.choices("GHJKLMNP", k=6))
    texts = [f"é secret: {cred()} then 語 {cred()}, {cred()} or Ordinary words-here." for _ in range(120)]
    texts += [f"-{cred()}- token={cred()}" + HEX * 3 + f" {cred()}." for _ in range(40)] + [None, "", "plain words only"] + ["many words here and " * 5000 + cred()]
    texts += [texts[0]] * 3
    docs = make(list(enumerate(texts)))
    model = secrets.train(docs)
    got = {r.doc_id: r for r in secrets.scan(docs, model).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i].spans.split(",") if s.startswith("format")] == plain_format_spans(t or "", model), t
    assert sum(r.n_format for r in got.values()) > 200


def test_merging_tests_all_states_of_large_trees():
    """4,000 random formats of 40 signs: every merge passes its test, however many states there are."""
    rng = random.Random(22)
    counts = {"".join(rng.choices("dhlHL", k=40)): 5 for _ in range(400)}
    made, tested = secrets.Automaton.__new__(secrets.Automaton), []
    compatible = secrets.Automaton._compatible

    def spy(self, a, b):
        tested.append(compatible(self, a, b))
        return tested[-1]

    made._compatible = spy.__get__(made)
    made.__init__(counts)
    assert False in tested and True in tested


def test_long_credentials_are_learned_and_spans_merge_in_linear_time(make):
    import time

    rng = random.Random(23)
    cred = lambda: "".join(rng.choices("GHJKLMNP0123456789", k=600))
    rows = [(i, f"secret={cred()} and words") for i in range(60)] + [(100 + i, f"words {cred()} words") for i in range(20)]
    docs = make(rows)
    got = {r.doc_id: r for r in secrets.scan(docs, secrets.train(docs)).collect()}
    assert sum(got[100 + i].n_format for i in range(20)) >= 18
    text = (f"token=abcdefgh words-of-nothing {HEX} " * 20_000).encode()
    began = time.perf_counter()
    assert len(secrets.outside(text, secrets.base_spans(text))) == 20_000
    assert time.perf_counter() - began < 10


def test_frequent_unlabelled_credentials_are_found(make):
    """More of them than of labelled ones and of ordinary runs together."""
    rng = random.Random(14)

    def cred():
        return "sk-" + "".join(rng.choices("0123456789", k=6)) + "-" + "".join(rng.choices("GHJKLMNPQRSTVWXYZ", k=14))

    labelled = [(i, f"token={cred()} and several ordinary sentences without meaning") for i in range(200)]
    hidden = [(5000 + i, f"nobody remembers {cred()} anymore.") for i in range(600)]
    docs = make(labelled + hidden)
    got = {r.doc_id: r for r in secrets.scan(docs, secrets.train(docs)).collect()}
    assert sum(got[5000 + i].n_format for i in range(600)) >= 570
    assert all(got[5000 + i].spans in ("", "format:17:41") for i in range(600))
    assert sum(got[i].n_format for i in range(200)) == 0


@pytest.mark.parametrize("signs,cut", [("0123456789GHJKLMNP", (12,)), ("GHJKLMNPQRSTVWXYZ", (14,)), ("0123456789", (12,)), ("GHJKLM0123456789", (4, 4, 4))])
def test_every_labelled_format_is_looked_for(make, signs, cut):
    """Short, letters-only, digits-only and dotted values, also at the end of a sentence."""
    rng = random.Random(15)

    def cred():
        return ".".join("".join(rng.choices(signs, k=k)) for k in cut)

    labelled = [(i, f"password: {cred()} and several ordinary sentences without meaning") for i in range(200)]
    hidden = [(5000 + i, f"Nobody remembers {cred()}{'.' if i % 2 else ' anymore'}") for i in range(40)]
    plain = [(9000 + i, "Ordinary sentences. Remember well-known chapters, paragraphs and IMPORTANT headings.") for i in range(50)]
    docs = make(labelled + hidden + plain)
    got = {r.doc_id: r for r in secrets.scan(docs, secrets.train(docs)).collect()}
    end = 17 + sum(cut) + len(cut) - 1
    assert sum(got[5000 + i].spans == f"format:17:{end}" for i in range(40)) >= 36
    assert sum(r.n_format for i, r in got.items() if not 5000 <= i < 9000) == 0


def test_automaton_merges_states():
    rng = random.Random(6)
    counts = {}
    for _ in range(3000):
        word = "H" + "".join(rng.choices("dl", k=1 + int(rng.expovariate(0.1))))
        counts[word] = counts.get(word, 0) + 1
    a = secrets.Automaton(counts)
    reached, todo = {0}, [0]
    while todo:
        for _, to in a.arcs[todo.pop()].values():
            if to not in reached:
                reached.add(to)
                todo.append(to)
    assert len(reached) < 15
    assert a.mean_log("H" + "dl" * 8) > a.mean_log("dl" * 8) and a.mean_log("H" + "dl" * 8) > a.mean_log("H" + "hh" * 8)


def test_secrets_of_nothing(make):
    docs = make([])
    assert secrets.scan(docs, secrets.train(docs)).count() == 0
    docs = make([(1, "nothing at all but a-long-run-of-9-letters-here")])
    assert secrets.scan(docs, secrets.train(docs)).first().spans == ""


ODD = ["", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "<|", "<", "|", "\n", "a\\nb", "é日本", "<<|im_end|>|>", "im_end|>", "<|im_end|", "\\", "x" * 100_000]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<|\\>a\nimendstr_", max_size=40), st.text(alphabet="<|\\>a\nn", max_size=12))
def test_round_trip(text, role):
    assert chat.parse(chat.render(role, text)) == [(role, text)]


@pytest.mark.parametrize("text", ODD)
def test_round_trip_of_odd_texts(text):
    turns = [("user", text), ("assistant", text), ("we<|im_end|>\nird", text)]
    formed = "".join(chat.render(r, t) for r, t in turns)
    assert chat.parse(formed) == turns


def test_parser_takes_pieces_of_any_size():
    turns = [("user", t) for t in ODD[:-1]] + [("assistant", t) for t in ODD[:-1]]
    whole = "".join(chat.render(r, t) for r, t in turns)
    for size in (1, 2, 7, 1000):
        reader, got = chat.Parser(), []
        for i in range(0, len(whole), size):
            got += reader.feed(whole[i : i + size])
        reader.close()
        assert [(r, chat.unescape(c)) for r, c, _ in got] == turns
        assert all(whole[at : at + len(c)] == c for _, c, at in got)
    assert chat.masked(whole, chat.loss_ranges(whole)) == ODD[:-1]
    for bad in ("x", whole + "<|im_start|>user\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>a\n<|im_start|>b\nc<|im_end|>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


def test_clean_text_is_not_escaped():
    assert chat.render("user", "plain <b> | text") == "<|im_start|>user\nplain <b> | text<|im_end|>\n"


def test_conversations(spark):
    rows = [(1, 2, "assistant", t) for t in ODD] + [(1, 1, "user", None), (2, 0, None, "x"), (None, 0, "user", "y"), (2, 1, "assistant", None), (3, None, "assistant", "z"), (3, 0, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", chat.F.lit(1))
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        mine = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (*x[:2], chat.render(*x[1:])))
        said = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(role, text)) for _, role, text in mine)
    whole = {r.conv_id: r.formatted for r in chat.conversations(turns).collect()}
    assert len(whole[1]) == got[1].formatted_chars and len(chat.parse(whole[1])) == got[1].n_turns
    for r in chat.conversations(turns).collect():
        learned = "".join(chat.masked(r.formatted, [(x.start, x.end) for x in r.loss]))
        assert hashlib.sha256(learned.encode()).hexdigest() == got[r.conv_id].loss_sha256
    assert chat.digests(turns.limit(0)).count() == 0
    assert chat.digests(chat.extra_conversation(spark)).first().n_turns == 2


DWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def dwords(text):
    return DWORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(text, items):
    w, hit, found = dwords(text), set(), set()
    for name, item in items:
        iw = dwords(item)
        size = min(10, len(iw))
        for k in range(len(iw) - size + 1) if iw else ():
            for i in range(len(w) - size + 1):
                if w[i : i + size] == iw[k : k + size]:
                    hit.update(range(i, i + size))
                    if name is not None:
                        found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_plain(spark, make):
    rng = random.Random(8)
    vocabulary = ["the", "of", "É", "x1", "Word", "rare", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 10, 12, 25])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "?!"), (53, items[4][1]), (10, items[5][1]), (54, "the the the the the the the the the the the")]
    texts = [None, "", "...", "the " * 30]
    for _ in range(40):
        t = rng.choices(vocabulary, k=rng.randrange(60))
        t[len(t) // 2 : len(t) // 2] = (items[rng.randrange(12)][1].upper().replace(" ", ", ")).split(" ")[: rng.randrange(30)]
        texts.append(rng.choice([" ", "-", "\n\n"]).join(t))
    texts += [texts[-1]] * 2 + ["the of " * 20_000 + items[3][1] + " é" * 20_000]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", chat.F.lit(1))
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination(make(list(enumerate(texts))), bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == plain_contamination(t, items), (i, t)
    docs = make(list(enumerate(texts)))
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not plain_contamination(t, items)[4]}


def test_contamination_of_nothing(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.contamination(make([(1, "a b"), (None, None)]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False), (0, 0, False)]
    bench = spark.createDataFrame([(1, "a"), (None, "b")], "item_id long, text string")
    assert decontam.contamination(make([]), bench).count() == 0
    got = decontam.contamination(make([(1, "b")]), bench).first()
    assert (got.n_hit, got.n_items) == (1, 0)
