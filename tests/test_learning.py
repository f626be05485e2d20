import random

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import evaluate, kmeans, perceptron
from gleanspark.plans import render
from gleanspark.streaming.index_stream import IndexStream


def matrix(spark, ys, hs, **k):
    df = spark.createDataFrame(list(zip(ys, hs)), "ys array<int>, yhats array<int>")
    return evaluate.confusion(df, **k)


def cells(cm):
    return {(r.actual, r.predicted): r.n for r in cm.collect()}


def test_single_labels(spark):
    got = cells(matrix(spark, [[0], [1], [1], [0], [1]], [[0], [1], [0], [1], [1]]))
    assert got == {("0", "0"): 1, ("0", "1"): 1, ("1", "0"): 1, ("1", "1"): 2}


def test_many_labels(spark):
    ys, hs = [[0, 1], [1], [0], [0]], [[0], [1], [0, 1], [1]]
    assert cells(matrix(spark, ys, hs)) == {("0", "0"): 2, ("0", "1"): 1, ("1", "0"): 0, ("1", "1"): 1}
    got = cells(matrix(spark, ys, hs, not_categorized=True))
    assert [got[a, p] for a in ("0", "1", "NOT_CAT") for p in ("0", "1", "NOT_CAT")] == [2, 1, 0, 0, 1, 1, 0, 1, 0]
    got = cells(matrix(spark, [[0, 1], [1], [3], [0]], [[0], [4], [0, 1], [1]]))
    assert [[got[a, p] for p in "0134"] for a in "0134"] == [[1, 1, 0, 0], [0, 0, 0, 1], [1, 1, 0, 0], [0, 0, 0, 0]]


def test_measures(spark):
    cm = matrix(spark, [[0], [1], [1], [0], [0], [1]], [[0], [1], [0], [1], [1], [1]])
    assert {r.label: round(r.precision, 6) for r in evaluate.precisions(cm).collect()} == {"0": 0.333333, "1": 0.666667}
    assert {r.label: r.recall for r in evaluate.recalls(cm).collect()} == {"0": 0.5, "1": 0.5}
    assert evaluate.f1(cm).first().f1 == pytest.approx(0.5)
    assert {r.label: r.n for r in evaluate.true_positives(cm).collect()} == {"0": 1, "1": 2}
    assert {(r.label, r.other): r.n for r in evaluate.false_positives(cm).collect()} == {("0", "1"): 1, ("1", "0"): 2}
    assert "0" in render.confusion(cm)


def test_empty_label_lists(spark):
    assert cells(matrix(spark, [[], None], [[1], []])) == {("1", "1"): 0}


# Points whose published clusterings the tests hold on to.
FLAT = [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (6.0, 6.0), (7.0, 6.0)]
SOLID = [(1, 1, 25), (1, 1, 20), (0, 20, 5), (0, 23, 2), (0, 25, 1), (2, 24, 0), (15, 10, 0), (15, 15, 5), (10, 10, 0)]


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, x array<double>")


def test_kmeans_published_values(spark):
    flat = points(spark, FLAT)
    model = kmeans.train(flat, 2)
    assert model.rss == pytest.approx(1.5)
    near = {}
    for r in model.closest(flat).orderBy("cid", "rn").collect():
        near.setdefault(r.cid, []).append(FLAT[r.id])
    assert sorted(near.values()) == [[(1.0, 2.0), (1.0, 1.0), (1.0, 3.0)], [(6.0, 6.0), (7.0, 6.0)]]
    assert "Cluster #0" in render.clusters(model.assign(flat), model.centroids)
    solid = points(spark, SOLID)
    assert kmeans.train(solid, 3).rss == pytest.approx(20.93469202522198)
    seed, best = kmeans.best_of(solid, 3)
    assert best.rss <= 20.93469202522199 and best.rss == min(kmeans.train(solid, 3, s).rss for s in range(3))


def test_all_steps_of_all_seeds_are_one_job(spark):
    """As many jobs for a hundred rounds as for one."""
    rng = random.Random(11)
    p = points(spark, [[rng.random() for _ in range(3)] for _ in range(400)])
    tracker, jobs, rounds = spark.sparkContext.statusTracker(), [], []
    for most in (1, None):
        spark.sparkContext.setJobGroup(f"rounds-{most}", "")
        rounds.append(sum(len(m.history) for m in kmeans.train_all(p, 5, [0, 1, 2], most)))
        jobs.append(len(tracker.getJobIdsForGroup(f"rounds-{most}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert rounds[0] == 3 and rounds[1] > 20 and jobs[0] == jobs[1]


def test_kmeans_edges(spark):
    with pytest.raises(TypeError):
        kmeans.train(points(spark, FLAT), 6)
    same = points(spark, [(1.0, 1.0)] * 3)
    model = kmeans.train(same, 2)
    assert model.rss == 0 and {r.cid for r in model.assign(same).collect()} == {0}


def test_sparse_assignment_agrees(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(4) for _ in range(5)] for _ in range(20)]
    dense = points(spark, rows)
    model = kmeans.train(dense, 3, max_rounds=2)
    long = spark.createDataFrame([(i, d, v) for i, r in enumerate(rows) for d, v in enumerate(r)], "doc_id int, dim int, cnt int")
    centroids = spark.createDataFrame([(c, d, v) for c, x in enumerate(model.assigned_with) for d, v in enumerate(x)], "cid int, dim int, v double")
    got = {r.doc_id: r.cid for r in kmeans.assign_sparse(long, centroids).collect()}
    assert got == {r.id: r.cid for r in model.assign(dense).collect()}


def test_bags_of_words_cluster_like_vectors(spark):
    """To convergence, against dense points; documents that share no word with a centroid included."""
    rng = random.Random(5)
    rows = [[rng.randrange(3) if (d < 6) == (i % 2 == 0) else 0 for d in range(12)] for i in range(24)]
    rows = [r if any(r) else [1] + r[1:] for r in rows]
    dense = points(spark, rows)
    for k in (2,):
        model = kmeans.train(dense, k)
        long = spark.createDataFrame([(i, d, v) for i, r in enumerate(rows) for d, v in enumerate(r) if v], "doc_id int, dim int, cnt int")
        assigned, _, history = kmeans.train_sparse(long, k)
        assert history == pytest.approx(model.history)
        assert {r.doc_id: r.cid for r in assigned.collect()} == {r.id: r.cid for r in model.assign(dense).collect()}


def test_points_without_vectors_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(FLAT)] + [(8, None), (9, [1.0, None])], "id int, x array<double>")
    assert kmeans.train(df, 2).rss == pytest.approx(1.5)
    with pytest.raises(TypeError, match="dimensions"):
        kmeans.train(df.unionByName(spark.createDataFrame([(10, [1.0])], "id int, x array<double>")), 2)


def test_texts_of_counts(spark):
    cm = matrix(spark, [[0], [1], [1], [0]], [[0], [0], [1], [1]])
    assert "0         | 1 of 1" in render.false_positives(cm) and "1         | 1 as 0" in render.true_negatives(cm)
    assert render.true_positives(cm, {"0": "bad", "1": "good"}, ["good", "bad"]).splitlines()[2:] == ["good      | 1", "bad       | 1"]


REVIEWS = [("Thanks for sharing", 1), ("Thank you so much", 1), ("Nothing is funny here", -1), ("I do not find it funny", -1), ("That's bad!", -1), ("", 1)]


@pytest.mark.parametrize("compat", [False, True])
def test_perceptron(spark, compat):
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(REVIEWS)], "doc_id int, text string, label int")
    weights = perceptron.train(df, compat)
    got = {r.term: r.weight for r in weights.collect()}
    expected = {}
    for text, label in REVIEWS:
        terms = [w.lower().strip(',.#@:"') for w in text.replace("!", " ").split()]
        for t in terms:
            expected.setdefault(t, perceptron.first_weight(t))
        said = 1 if sum(expected[t] for t in terms) > 0 else -1
        if compat or said != label:
            for t in terms:
                expected[t] -= 0.7 * said
    assert got == pytest.approx(expected)
    totals = {r.doc_id: (r.total, r.label) for r in perceptron.predict(df, weights).collect()}
    assert totals[5] == (0.0, -1) and len(totals) == 6
    assert all(t[1] == (1 if t[0] > 0 else -1) for t in totals.values())
    assigned = perceptron.assign(perceptron.assign(df, weights), weights).where("doc_id = 5").first()
    assert assigned.predicted_labels == [-1, -1]
    low, high = (perceptron.extreme(weights, 2, o).collect() for o in (1, -1))
    assert len(low) == 3 and low[0].weight == min(got.values()) and high[0].weight == max(got.values())
    assert perceptron.train(df, shards=3).count() == len(got)
    assert render.weights(weights).startswith("\nterm      | weight\n")


@pytest.mark.parametrize("shards", [1, 3])
def test_perceptron_in_parts(spark, shards):
    """Many ranges of documents, with ids that repeat and documents without an id or words, learn what one pass learns."""
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(40)]), " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(12))), rng.choice([1, -1])) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label int")
    streams = {}
    for r in df.withColumn("s", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % shards).collect():
        streams.setdefault(r.s, []).append(r)
    expected = {}
    for part in streams.values():
        weights = {}
        for r in sorted(part, key=lambda r: (r.doc_id is not None, r.doc_id, r.label, r.text.split())):
            for t in r.text.split():
                weights.setdefault(t, perceptron.first_weight(t))
            said = 1 if sum(weights[t] for t in r.text.split()) > 0 else -1
            for t in r.text.split() if said != r.label else []:
                weights[t] -= 0.7 * said
        for t, w in weights.items():
            expected.setdefault(t, []).append(w)
    got = perceptron.train(df, shards=shards, chunk_bytes=2000)
    assert {r.term: r.weight for r in got.collect()} == pytest.approx({t: sum(ws) / len(ws) for t, ws in expected.items()})


def test_bags_agree_with_columns(spark):
    from gleanspark.functions import bags
    from gleanspark.functions import text as T

    texts = ["", None, "a,b\x1cc #x# #x. ... [newline][NEWLINE]z", "[new“line] café [newéline] ÀB \u2028c", 'He said: "No!" no. NO @no \x00 \x85d', "\x0b\x1fq?\x7f # . : #"]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.transform(T.raw_tokens(F.col("text")), T.normalize).alias("terms")).collect():
        n, at = bags.placed(r.text.encode() if r.text is not None else None)
        assert {t.decode(): (n[t], at[t]) for t in n} == {t: (r.terms.count(t), r.terms.index(t)) for t in r.terms}
        assert bags.counted(r.text.encode() if r.text else None) == n


def test_first_weights_agree(spark):
    r = spark.createDataFrame([("the",), ("",)], "t string").select("t", perceptron.first_weight_column(F.col("t")).alias("w")).collect()
    assert all(x.w == pytest.approx(perceptron.first_weight(x.t), abs=1e-15) for x in r)


def test_predictions_by_table_and_by_function(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "two"), (2, "three one"), (3, None), (None, "two one")], "doc_id int, text string")
    from gleanspark.operators import index

    table = index.terms(df).select("term", perceptron.first_weight_column(F.col("term")).alias("weight"))
    by = [perceptron.predict(df, w) for w in (table, perceptron.first_weight_column)]
    one, two = ({r.doc_id: (round(r.total, 9), r.label) for r in d.collect()} for d in by)
    assert one == two and set(one) == {1, 2, 3, None}
    assert by[1]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    posts = index.vocabulary(df)
    assert sorted(perceptron.with_df(table, posts).collect()) == sorted(perceptron.with_df(perceptron.first_weight_column, posts).collect())


def test_stream_adds_up_only_documents_in_several_segments(spark, tmp_path):
    stream = IndexStream(spark, f"file://{tmp_path}/s")
    for i in range(3):
        stream.upsert(spark.createDataFrame([(10 * i, "one two two"), (10 * i + 1, "two")], "doc_id long, text string"), i)
    assert "Aggregate" not in stream.current()._jdf.queryExecution().executedPlan().toString()
    assert stream.current().count() == 9
    stream.upsert(spark.createDataFrame([(10, "two")], "doc_id long, text string"), 3)
    assert {(r.term, r.doc_id): r.cnt for r in stream.current().where("doc_id = 10").collect()} == {("one", 10): 1, ("two", 10): 3}


def test_stream_equals_batch_and_replays(spark, tmp_path):
    from gleanspark.operators import index

    a = spark.createDataFrame([(1, "one two two"), (2, "two")], "doc_id long, text string")
    b = spark.createDataFrame([(2, "two three"), (3, "one")], "doc_id long, text string")
    stream = IndexStream(spark, f"file://{tmp_path}/s")
    assert stream.current().count() == 0
    stream.upsert(a, 0)
    stream.upsert(b, 1)
    stream.upsert(b, 1)
    expected = {(r.term, r.doc_id): r.cnt for r in index.postings(a.unionByName(b)).collect()}
    assert {(r.term, r.doc_id): r.cnt for r in stream.current().collect()} == expected


def test_stream_merges_segments(spark, tmp_path):
    from gleanspark.operators import index

    batches = [spark.createDataFrame([(i, "one two"), (i % 3, f"w{i % 4} two")], "doc_id long, text string") for i in range(11)]
    stream = IndexStream(spark, f"file://{tmp_path}/s", fanout=3)
    every = batches[0].limit(0)
    for i, b in enumerate(batches):
        before, expected = stream.current(), {(r.term, r.doc_id): r.cnt for r in index.postings(every).collect()}
        stream.upsert(b, i)
        stream.upsert(b, i)
        assert {(r.term, r.doc_id): r.cnt for r in before.collect()} == expected
        every = every.unionByName(b)
    stream.upsert(batches[0], 0)  # long since merged
    assert [(s.level, s.first, s.last) for s in stream.segments()] == [(2, 0, 8), (0, 9, 9), (0, 10, 10)]
    assert {(r.term, r.doc_id): r.cnt for r in stream.current().collect()} == {(r.term, r.doc_id): r.cnt for r in index.postings(every).collect()}
