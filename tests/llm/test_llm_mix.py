"""Mixing, neighbour search and the pipeline."""

import os
import sys

import numpy as np
import pytest
from check_oracle import compare
from llm_helpers import messy, plain_components, words

import corpus_pipeline
from barloom.llm import mixing, multi_index, queries
from barloom.llm.decontaminate import contaminated
from barloom.llm.quality import quality_scores

SMALL = "/root/testdata/sf0.001"


def test_mix_matches_sql(spark, con):
    text, ok = compare(spark, con, SMALL, "op4_sainte_lague_mix")
    assert ok, text


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1234])
def test_apportionment_is_seat_by_seat(spark, seats):
    votes = [0.0, 1.0, 1.0, 3.5, 50.0, 1000.0, 7.25]
    df = spark.createDataFrame(list(enumerate(votes)), "p long, v double")
    from pyspark.sql import functions as F
    got = {r.p: r.quota for r in mixing.apportion(df, [], "p", F.col("v"), F.lit(seats)).collect()}
    want = dict.fromkeys(range(len(votes)), 0)
    for _ in range(seats):
        k = max(want, key=lambda p: (votes[p] / (2 * want[p] + 1), -p))
        want[k] += 1
    assert got == want


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    source = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        t = source.setdefault(r.target, [0, r.target])
    docs = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, target = {}, {}
    for r in rows:
        taken[docs[r.doc_id]] = taken.get(docs[r.doc_id], 0) + r.taken
        target[docs[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-3


def test_mix_of_messy_rows(spark):
    got = mixing.mix(messy(spark)).collect()
    assert len(got) == 13 and {r.taken for r in got if r.size == 0} == {0}
    assert [r.size for r in got if r.doc_id == 7] == [60000]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(messy(spark).repartition(3)).collect()), key=str)
    assert mixing.mix(messy(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(messy(spark, [(1, "", "a"), (2, None, None)])).collect()} == {0}


def plain_nearest(rows, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        o = np.lexsort((ids, d))
        out[ids[q]] = [(int(ids[j]), d[j]) for j in o if ids[j] != ids[q]][:k]
    return out


def found(df):
    out = {}
    for r in sorted(multi_index.neighbours(df).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_tables_without_structure(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in v.collect()}
    want, got = plain_nearest(list(rows.items())), found(v)
    assert recall(got, want) >= 0.9
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and len(near) == 10
        assert all(np.isclose(s, np.sqrt(((rows[q] - rows[i]) ** 2).sum()), rtol=1e-12) for i, s in near)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_offset_costs_no_neighbour(spark, offset):
    rng = np.random.default_rng(9)
    groups = rng.normal(scale=0.3, size=(20, 6))
    rows = [(i, [float(x) for x in offset + groups[i % 20] + rng.normal(scale=0.01, size=6)]) for i in range(3000)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)), plain_nearest(rows)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_groups_need_few_of_the_rows():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(200, 16))[:, None] + rng.normal(scale=0.05, size=(200, 100, 16))).reshape(-1, 16)
    books = [multi_index.codebook(x[:, :8], 32, 1), multi_index.codebook(x[:, 8:], 32, 2), np.zeros(16)]
    cell = multi_index._cells(x, books)
    counts = np.bincount(cell, minlength=32 * 32)
    radii = np.zeros((32 * 32, 2))
    for k, (half, book) in enumerate(multi_index._halves(x, books)):
        np.maximum.at(radii[:, k], cell, np.sqrt(((half - book[cell // 32 if k == 0 else cell % 32]) ** 2).sum(axis=1)))
    looked = []
    for q in range(0, len(x), 400):
        first, second = (multi_index.squares(h[q:q + 1], b)[0] for h, b in multi_index._halves(x, books))
        begun = multi_index.walk(first, second, counts, multi_index.FIRST * len(x))
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far = np.sort(d[np.isin(cell, begun)])[10]
        more = multi_index.further_cells(first, second, counts, radii, begun, far, multi_index.SHARE * len(x))
        assert np.isin(np.argsort(d)[:11], np.flatnonzero(np.isin(cell, [*begun, *more]))).all()
        looked.append(counts[[*begun, *more]].sum() / len(x))
    assert np.mean(looked) <= 0.1


def test_copies_displace_no_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    near = (1000, [x + 1e-3 for x in rows[0][1]])
    other = (1001, [x + 1 for x in rows[100][1]]), (1001, [x - 1 for x in rows[100][1]])  # of one id and distance, yet different rows
    want = plain_nearest([*rows, near, *other])
    df = spark.createDataFrame([*rows, *rows, *[near] * 9000, *other], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in sorted(multi_index.neighbours(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in x] for q, x in want.items()} and all(len(x) == 10 for x in got.values())


def test_recall_of_the_walk(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "FEWEST", 10)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 50)
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = plain_nearest(v.select("vec_id", "embedding").collect())
    got = {}
    for r in multi_index.neighbours(v).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    cells = multi_index.walk(a, b, np.ones(35, int), 1e9)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


def test_messy_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 2.0]), (100, [1.0, 3.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, bucket string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.neighbours(df).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0)]
    assert multi_index.neighbours(df.limit(0)).count() == 0


def test_pipeline_against_plain_steps(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept.append((before, docs))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    original = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id for r in quality_scores(original, labels).where("predicted = 1").collect()}
    assert ids(kept[0][1]) == good
    rows = [(r.doc_id, r.text) for r in kept[1][0].collect()]
    assert ids(kept[1][1]) == {d for d, (_, root) in plain_components(rows).items() if d == root}
    leaked = {r.doc_id for r in contaminated(kept[2][0], bench).collect()}
    assert ids(kept[2][1]) == ids(kept[2][0]) - leaked
    assert ids(kept[3][1]) == ids(kept[3][0])
    assert kept[3][1].where(r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count() == 0
    assert all(k[1].columns == original.columns for k in kept[:4])
    last = kept[4][1].collect()
    assert last and all(0 < r.taken <= 3 * len(words(r.text)) for r in last)


def test_stages_on_messy_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, messy(spark), SMALL)
        assert set(messy(spark).columns) <= set(out.columns), name
        out.collect()
        assert stage(spark, messy(spark, []), SMALL).count() == 0
    kept = corpus_pipeline.one_of_each(spark, messy(spark), SMALL)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 8, 10] and kept.where("doc_id IS NULL").count() == 2


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
