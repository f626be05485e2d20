import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gleanspark.llm import simhash as S
from gleanspark.llm.components import smallest_reachable


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, " \n\t", "One", "one TWO", "a b c", "a b c d", "É x \x85y z É", "x " * 5000, "Ａ b\x0bc\x0cd\re"])
def test_fingerprint_equals_plain(text):
    assert S.simhash(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_fingerprint_equals_spark_hash(spark):
    h = spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64
    assert S.simhash(b"a b c") == h


def near(rng, base, n, most):
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(most + 1))) for _ in range(n)]


@pytest.mark.parametrize("crowd", [4, 48])
def test_components_equal_all_pairs(spark, monkeypatch, crowd):
    """Chains, crowds over and under the limit of pairs, and strangers."""
    monkeypatch.setattr(S, "CROWDED", crowd)
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + near(rng, base[0], 150, 3) + near(rng, base[1], 20, 2) + near(rng, base[2], 40, 5)
    chain = base[3]
    for _ in range(25):
        chain ^= 1 << rng.randrange(64)
        fps.append(chain)
    fps += [0, 1, 3, 7, 2**63, fps[5], fps[5]]
    rng.shuffle(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    expected = roots(len(fps), links)
    df = spark.createDataFrame([(i, S._signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    found = {r.fp: r.component_id for r in S.components(df).df.collect()}
    assert [found[S._signed(f)] for f in fps] == expected


def test_long_chains_converge(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, i) for i in range(300, 400)], "a long, b long")
    got = {r.node: r.root for r in smallest_reachable(links).df.collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 300 for i in [*range(300, 400), 500])


TEXT = "the quick brown fox jumps over the lazy dog while seven more foxes sleep near an old stone wall by the river".split()


def test_documents(spark, make):
    rng = random.Random(1)
    other = " ".join(rng.choices("abcdefghij", k=60))
    rows = [(5, " ".join(TEXT)), (3, " ".join(TEXT).upper()), (9, other), (7, None), (8, ""), (2, "\n"), (9, other), (None, other), (4, "x" * 200_000), (None, "alone here")]
    got = S.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint)
    assert [by[i][0].component_id for i in (5, 3, 9, 7, 8, 2, 4)] == [3, 3, 9, 2, 2, 2, 4]
    assert by[7][0].fingerprint == "0" * 16
    assert sorted((r.component_id for r in by[None]), key=str) == [9, None]


def test_empty(spark, make):
    assert S.near_duplicates(make([])).count() == 0


def test_maximum_coordinate_difference_bounds_distance():
    rng = random.Random(5)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = near(rng, x, 1, 2)[0]
        assert max(abs((x ^ p).bit_count() - (y ^ p).bit_count()) for p in S.PIVOTS) <= (x ^ y).bit_count() <= 2
    assert len(set(S.PIVOTS)) == 16


def test_no_link_is_lost_between_cells(spark):
    """Every pair at distance 1 or 2 shares a cell."""
    rng = random.Random(9)
    x = rng.getrandbits(64)
    all_near = [x] + [x ^ (1 << i) for i in range(64)] + [x ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    df = spark.createDataFrame([(S._signed(f), i) for i, f in enumerate(all_near)], "fp long, rid long")
    cells = S.cells(S.pivot_table(df))
    mine = [r.cell for r in cells.where("rid = 0").collect()]
    assert len(mine) == 6
    assert cells.where(F.col("cell").isin(mine)).select("rid").distinct().count() == len(all_near)


def test_text_ids_keep_their_type(spark):
    rows = [("b", "one two three four"), ("a", "One two three four"), (None, "other words"), ("c", None)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", None: None, "c": "c"}


def test_query_equals_all_pairs(spark):
    """The query over a whole table against fingerprints and links of all pairs."""
    import os

    from gleanspark.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the sample tables")
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root, least = roots(len(rows), links), {}
    for r, k in zip(rows, root):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, data).collect()}
    assert got == {r.doc_id: (f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, root)}
