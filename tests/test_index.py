import pytest
from fixtures import DOC1, DOC2, DOC3, docs
from pyspark.sql import functions as F

from gleanspark.errors import IndexNotFoundError
from gleanspark.operators import index
from gleanspark.plans import render
from gleanspark.plans.controller import Controller
from gleanspark.sources import readers


@pytest.fixture(scope="module")
def two(spark):
    d = docs(spark, DOC1, DOC2)
    posts = index.postings(d).persist()
    return d, posts, index.vocab(posts, d).persist()


def test_term_counts(spark, two):
    assert index.vocab(index.postings(docs(spark, DOC1)), docs(spark, DOC1)).count() == 20
    assert two[2].count() == 41


def test_first_appearance_order(two):
    terms = [r.term for r in index.head(two[2], 0).collect()]
    assert terms[:10] == ["hello", "world", "this", "is", "a", "test", "document", "to", "do", "some"]
    assert terms[-4:] == ["structured", "text", "mining", "unstructured"]
    assert [r.term for r in index.head(two[2], 5, 3).collect()] == ["is", "a"]


def test_rendered_index(two):
    out = render.inverted_index(two[1], two[2])
    assert out.startswith("[TERM          - DOC_COUNT - IDF] -> [DOC - TERM_COUNT - TF]\n" + "-" * 60 + "\n[hello             -    1 -  301] -> ['6428 - 1 -  1000']\n")
    assert "[as                -    2 -    0] -> ['1451 - 2 -  1301', '6428 - 4 -  1602']\n" in out
    assert out.endswith("[unstructured      -    1 -  301] -> ['1451 - 1 -  1000']\n")
    assert render.inverted_index(two[1], two[2], 10).count("\n") == 12


def test_stats(two):
    assert render.index_stats(index.stats(two[2])) == "   33 (80.49%) terms in    1 docs|..............................|\n    8 (19.51%) terms in    2 docs|........\n"


def test_postings_ascend_and_sum_to_tokens(two):
    assert [r.doc_id for r in index.first_postings(two[1]).where("term = 'this'").orderBy("rn").collect()] == ["1451", "6428"]
    assert two[1].agg(F.sum("cnt")).first()[0] == index.tokens(two[0]).count()


def test_merge_keeps_idf_and_untouched_tf(spark, two):
    changed = two[1].withColumn("tf", F.when(F.col("term") == "some", F.lit(9999.0)).otherwise(F.col("tf")))
    posts, terms = index.merge(changed, two[2], docs(spark, DOC3))
    got = {r.term: (r.df, round(r.idf)) for r in terms.collect()}
    assert len(got) == 58 and got["world"] == (2, 301) and got["this"] == (3, 0) and got["qatar"] == (1, 0)
    tf = {(r.term, r.doc_id): (r.cnt, round(r.tf)) for r in posts.collect()}
    assert tf["some", "6428"] == (1, 9999) and tf["in", "8888"] == (2, 1301)
    fresh = {r.term: round(r.idf) for r in index.refresh_idf(terms, 3).collect()}
    assert fresh["this"] == 0 and fresh["qatar"] == 477


def test_merge_without_tf(spark):
    d = docs(spark, DOC1)
    posts = index.postings(d)
    merged, _ = index.merge(posts, index.vocab(posts, d), docs(spark, DOC2), update_tf=False)
    row = merged.where("term = 'imagine'").first()
    assert (row.cnt, row.tf) == (1, 0.0)


def test_repeated_ids_add_up(spark):
    d = docs(spark, ("a", "one two"), *[("b", "two three")] * 1000)
    posts = index.postings(d)
    assert {(r.term, r.doc_id): r.cnt for r in posts.collect()} == {("one", "a"): 1, ("two", "a"): 1, ("two", "b"): 1000, ("three", "b"): 1000}
    assert round(index.vocab(posts, d).where("term = 'two'").first().idf, 3) == round(1000 * __import__("math").log10(1001 / 2), 3)
    assert index.doc_index(d.withColumn("n", F.monotonically_increasing_id()), F.col("n")).count() == 2


def exchanged(df):
    """Operators that deal rows out, as the plan says before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hash" in line]


ODD = [("a", "one two two"), ("b", "two $three"), (None, "one four"), ("c", None), ("d", "One, . # four$ ti"), ("e", "four five https://x.tion"), ("b", "three one two")]


@pytest.mark.parametrize("most", [index.MOST_SHARED, 0])
def test_vocabulary_of_documents_is_that_of_their_postings(spark, monkeypatch, most):
    """With ids that are shared, missing, and too many to tell apart."""
    monkeypatch.setattr(index, "MOST_SHARED", most)
    for rows in (ODD, ODD + [(None, "one six")], ODD[:2], []):
        d = spark.createDataFrame(rows, "doc_id string, text string")
        plain = index.tokens(d).groupBy("term", "doc_id").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
        posts = index.postings(d)
        assert sorted(posts.select("term", "doc_id", "cnt", "first_pos").collect(), key=repr) == sorted(plain.collect(), key=repr)
        assert sorted(index.vocabulary(d).collect(), key=repr) == sorted(index.vocab(plain, d).collect(), key=repr)
        assert sorted(index.vocabulary(d, places=False).collect(), key=repr) == sorted(index.vocab(plain, d).drop("first_at").collect(), key=repr)
        assert {r.term for r in index.terms(d).collect()} == {r.term for r in plain.collect()}
        few, every = (index.first_postings(x, 2).collect() for x in (index.postings(d, first=2), posts))
        assert sorted(few, key=repr) == sorted(every, key=repr)


def test_only_documents_that_share_an_id_are_exchanged(spark):
    d = docs(spark, *[(str(i), f"w{i % 7} two") for i in range(30)])
    assert exchanged(index.postings(d)) == [] and len(exchanged(index.postings(d.union(d.limit(1))))) > 0
    posts = index.postings(d)
    new = spark.createDataFrame([("99", "w1 x"), ("3", "two")], "doc_id string, text string")
    merged = index.merge(posts, index.vocabulary(d), new)[0]
    expected = {(r.term, r.doc_id): r.cnt for r in index.postings(d.unionByName(new)).collect()}
    assert {(r.term, r.doc_id): r.cnt for r in merged.collect()} == expected


def test_few_frequent_terms_and_many_rare_ones(spark, monkeypatch):
    d = docs(spark, *[(str(i), f"the w{i} w{i % 3}") for i in range(20)])
    posts, terms = index.postings(d), index.vocabulary(d)
    every = sorted(index.document_vectors(posts, terms).collect())
    monkeypatch.setattr(index, "FREQUENT", 2)
    assert sorted(index.document_vectors(posts, terms).collect()) == every and len(every) == posts.count()


def test_a_term_alone_tells_its_patterns(spark):
    from gleanspark.operators import kgram, search

    terms = spark.createDataFrame([(t,) for t in ("", "$", "a", "tion", "nation", "ti$on", "on$", "that", "th", "https:tion", "hth", "$th", "a.b", "ab")], "term string")
    posts = terms.select("term", F.col("term").alias("doc_id"))
    for k in (2, 3):
        grams = kgram.gram_index(terms, k)
        for p in ("*tion", "th*", "*", "**", "*a*", "a*", "*n$", "*$*", "$*", "t*n", "a.*", "*.b", "#*", "", "th*n"):
            assert {r.term for r in terms.where(kgram.holds(F.col("term"), p, k)).collect()} == {r.term for r in kgram.expand(grams, p, k).collect()}, (k, p)
    grams = kgram.gram_index(terms)
    for asked in (["th*", "*h"], ["*tion", "that"], ["*"], ["That,", "th*", "*tion"]):
        for mode in ("and", "or"):
            assert {r.doc_id for r in search.matches(posts, asked, None, True, mode).collect()} == {r.doc_id for r in search.matches(posts, asked, grams, True, mode).collect()}
    assert "Join" not in search.matches(posts, ["th*", "*tion"], wildcard=True)._jdf.queryExecution().executedPlan().toString()


def test_merge_builds_only_what_is_asked_for(spark):
    c = Controller(docs(spark, DOC1, DOC2))
    c.merge(docs(spark, DOC3))
    assert c._built == {}
    assert [r.doc_id for r in c.query_intersection(["inf*", "qatar"], wildcard=True).collect()] == ["8888"] and set(c._built) == {"postings"}
    assert c.get_index("kgram").count() == c.get_index("kgram").distinct().count() > 0
    assert {r.term for r in c.get_index("kgram").collect()} == {r.term for r in c.get_index("vocab").collect()}


def test_empty_term_null_and_empty_text(spark):
    d = docs(spark, ("a", ". x #"), ("b", None), ("c", ""), ("d", "café bar"))
    got = {(r.term, r.doc_id): r.cnt for r in index.postings(d).collect()}
    assert got == {("", "a"): 2, ("x", "a"): 1, ("cafbar", "d"): 1}


def test_without_tfidf(two):
    assert index.postings(two[0], use_tfidf=False).agg(F.sum("tf")).first()[0] == 0


def test_document_vectors(two):
    dims = {r.dim for r in index.document_vectors(two[1], two[2]).collect()}
    assert dims == set(range(41))


def test_controller(spark):
    c = Controller(docs(spark, DOC1, DOC2))
    ids = lambda *a, **k: [r.doc_id for r in c.query_intersection(*a, **k).collect()]
    assert ids(["information", "test"]) == ["1451", "6428"]
    assert ids("inf*", wildcard=True) == ["1451", "6428"]
    assert ids(["hello", "inf*"], wildcard=True) == ["6428"]
    assert ids(["*nf*", "*est"], wildcard=True) == ["1451", "6428"]
    assert ids("*", wildcard=True) == [] and ids("great work") == []
    assert [r.rank for r in c.query_intersection("hello", ranked=True).collect()] == [1.0]
    assert len(ids(["hello", "mining"], ranked=True)) == 2
    assert [r.doc_id for r in c.regex_docs("SHAKESPEAR").collect()] == ["6428"]
    assert [r.doc_id for r in c.doc_index_slice().collect()] == ["6428", "1451"]
    c.merge(docs(spark, DOC3, ("9000", "Zebras say hello")))
    assert c.get_index("vocab").count() == 60
    assert ids("hello") == ["6428", "9000"] and ids("zeb*", wildcard=True) == ["9000"] and ids(["inf*", "qatar"], wildcard=True) == ["8888"]
    assert sorted(ids("hello", ranked=True)) == ["6428", "9000"]
    assert [r.doc_id for r in c.regex_docs("zebra").collect()] == ["9000"] and [r.doc_id for r in c.doc_index_slice(2).collect()] == ["9000", "8888"]
    c.merge(docs(spark, ("9000", "hello again")))
    assert {(r.term, r.cnt) for r in c.get_index("postings").where("doc_id = '9000'").collect()} == {("zebras", 1), ("say", 1), ("hello", 2), ("again", 1)}
    assert ids("aga*", wildcard=True) == ["9000"] and c.get_index("doc").count() == 4
    assert "9000" in c.ranked_page("hello")
    said, lines = [], iter(["hello", "? hello", "zzz", ""])
    c.interactive(lambda _: next(lines), said.append)
    assert said[0] == "6428, 9000" and "9000" in said[1] and said[2] == "nothing found"
    with pytest.raises(IndexNotFoundError, match=r"Index\(nothing\) not set"):
        c.get_index("nothing")
    with pytest.raises(TypeError):
        c.query_intersection(7)
    with pytest.raises(TypeError):
        c.set_docs([1])
    with pytest.raises(KeyError):
        c.query_intersection(["hello", "zzz"], ranked=True, strict=True).collect()

    class Lengths:
        def build(self, d):
            return d.select("doc_id", F.length("text").alias("n"))

    c.add_indexer("lengths", Lengths())
    c.build(force=True)
    assert c.get_index("lengths").count() == 5


def test_generated_documents(spark):
    one, two = (sorted(readers.generated(spark, 20, words=30).repartition(n).collect()) for n in (1, 5))
    assert one == two and len(one) == 20 and all(len(r.text.split()) == 30 for r in one)
    assert len({w for r in one for w in r.text.split()}) > 50


def test_sources(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("pos\tThanks\nneg\tThat's \"bad\"!\npos\tok\n")
    got = readers.read_reviews(spark, str(path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.label) for r in got] == [(0, 1), (1, -1), (2, 1)] and got[1].text == "That's \"bad\"!"
    tweets = tmp_path / "t.tsv"
    tweets.write_text("2020\t5\tme\tx\tHi \"there\n")
    assert readers.read_tweets(spark, str(tweets)).first().text == 'Hi "there'
    assert readers.from_rows(spark, None).count() == 0
    assert readers.from_rows(spark, {"doc_id": 3, "text": "x"}).first().doc_id == 3
    with pytest.raises(TypeError):
        readers.from_rows(spark, [5])
    readers.write_index(index.postings(docs(spark, DOC1)), str(tmp_path / "ix"), "term")
    assert readers.read_index(spark, str(tmp_path / "ix")).count() == 20


def test_renderings(two):
    assert "6428 \tauthored by me" == render.document({"doc_id": "6428", "author_id": "me", "timestamp": None})
    assert render.linked(["a", "b"]) == "[a]->[b]" and render.linked(["a", "b"], True) == "[b]<-[a]"
    assert "hello" in render.terms(two[1], two[2], 3)
