import math

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import editdist, lists
from gleanspark.functions import text as T
from gleanspark.operators import index, kgram
from gleanspark.plans import render


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_tf_and_idf(spark):
    got = spark.createDataFrame([(-1000,), (0,), (1,), (10,), (15,), (100,), (370,), (1000,), (4000,)], "n int").select(F.round(T.tf(F.col("n"))).cast("int").alias("t")).collect()
    assert [r.t for r in got] == [0, 0, 1000, 2000, 2176, 3000, 3568, 4000, 4602]
    got = spark.createDataFrame([(1000,), (100,), (10,), (5,), (1,)], "n int").select(F.round(T.idf(F.col("n"), F.lit(1000))).cast("int").alias("t")).collect()
    assert [r.t for r in got] == [0, 1000, 2000, 2301, 3000]
    for bad in (1001, 0):
        with pytest.raises(Exception, match="document frequency"):
            spark.range(1).select(T.idf(F.lit(bad), F.lit(1000))).collect()


def test_cosine(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, x=T.cosine(a(1, 2), a(2, 3.3)), y=T.cosine(a(1, 2), a(2, 2)), z=T.cosine(a(1, 2), a(2, 4)), n=T.cosine(a(0, 0), a(2, 4)), w=T.query_similarity(a(1, 1), a(1, 2), a(1, 1), a(2, 4)))
    assert [round(v.similarity, 4) for v in (r.x, r.y, r.z, r.w)] == [0.9967, 0.9487, 1.0, 1.0]
    assert (r.n.similarity, r.n.err) == (1.0, "provided query is very common")


def plain_grams(t, k):
    if not t:
        return ["$"]
    return ["$" + t[: k - 1]] + [t[i:] + "$" if i + k > len(t) else t[i : i + k] for i in range(len(t))]


@pytest.mark.parametrize("k", [2, 3, 4])
def test_grams(spark, k):
    words = ["", "a", "ab", "abc", "one-liner", "x$y"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.grams(F.col("w"), k).alias("g")).collect()
    assert {r.w: r.g for r in got} == {w: plain_grams(w, k) for w in words}


def test_gram_index_and_wildcards(spark):
    from fixtures import DOC1, DOC2, docs

    for rows, n in (((DOC1,), 84), ((DOC1, DOC2), 144)):
        d = docs(spark, *rows)
        g = kgram.gram_index(index.vocab(index.postings(d), d)).persist()
        assert kgram.word_counts(g).count() == n
    words = {r.gram: r.words for r in kgram.words_of(g).collect()}
    assert words["he"] == ["hello"] and words["ne"] == ["imagine", "one", "one-liner"]
    assert kgram.words_count(g) == sum(map(len, words.values()))
    assert "he" in render.grams(g)
    v = spark.createDataFrame([(w,) for w in ("cat", "car", "dog", "a", "aba", "https://ca")], "term string")
    g = kgram.gram_index(v)
    find = lambda p, **k: sorted(r.term for r in kgram.expand(g, p, **k).collect())
    assert find("ca*") == ["car", "cat"] and find("*") == [] and find("**") == [] and find("*a*") == []
    assert find("a*a") == ["a", "aba"] and find("a*a", exact=True) == ["aba"]


def test_sorted_lists(spark):
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    code = lambda q: lists.in_sorted(a(2, 10, 128), F.lit(q))
    r = one(spark, hit=code(10), low=code(1), mid=code(11), end=code(129))
    assert (r.hit, r.low, r.mid, r.end) == (1, -2, -2, -1)
    zoo = a("ant", "must", "neon", "zebra")
    r = one(spark, two=lists.get_slice(zoo, 2), none=lists.get_slice(zoo, 0), five=lists.get_slice(zoo, 5), all=lists.get_slice(zoo, -1), ins=lists.insert_ordered(zoo, F.lit("must"), unique=True), dup=lists.insert_ordered(zoo, F.lit("must")), has=lists.has(zoo, F.lit("bee")), show=lists.pretty(zoo), b=lists.insert_before(zoo, F.lit(1), F.lit("x")), c=lists.insert_after(zoo, F.lit(1), F.lit("x")))
    assert r.two == ["ant", "must"] and r.none == [] and len(r.five) == len(r["all"]) == len(r.ins) == 4 and len(r.dup) == 5
    assert (r.has.match, r.has.stop) == (None, "must") and r.show == "[ant]->[must]->[neon]->[zebra]"
    assert r.b[1] == "x" and r.c[2] == "x"


def plain_matrix(a, b):
    m = [[i + j if not i * j else 0 for j in range(len(a) + 1)] for i in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            m[i][j] = min(m[i - 1][j - 1] + (a[j - 1] != b[i - 1]), m[i - 1][j] + 1, m[i][j - 1] + 1)
    return m


def test_edit_matrices(spark):
    pairs = [("last", "rats"), ("yellow", "panda"), ("bat", "batman"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", editdist.matrix(F.col("a"), F.col("b")).alias("m"), editdist.distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r.m == plain_matrix(r.a, r.b) and r.d == r.m[-1][-1]
    assert [r.d for r in got] == [3, 6, 3, 1]
    assert render.edit_matrix("bat", "batman", got[2].m).splitlines()[1:4] == ["      b, a, t", "--------------", " |[0, 1, 2, 3]"]
    cells = {(r.i, r.j): (r.diag, r.above, r.left, r.best) for r in editdist.detailed_cells(df.where("a = 'last'")).collect()}
    assert cells[0, 0] == (1000,) * 4 and cells[1, 1] == (1, 2, 2, 1) and cells[2, 2] == (1, 3, 3, 1)
    rows = [[cells[i, j] for j in range(5)] for i in range(5)]
    assert "a|/ , 2\\ /2, 2\\ /1, 3\\ /3, 4\\ /4, 5\\\n |\\ , 2/,\\3, 2/,\\3, 1/,\\2, 2/,\\3, 3/\n" in render.edit_matrix_detailed("last", "rats", rows)


def test_query_tokens():
    assert T.tokens_of('Great, "work" a.b #') == ["great", "work", "a.b", ""]
    assert math.isclose(T.SCALE, 1000)
