"""The exact join of near vectors."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from check_oracle import compare

from barloom.llm import buffers as bf, metric_join

SMALL = "/root/testdata/sf0.001"


def plain_links(rows, least=0.9):
    """{vec_id: (links, least id reachable)} of distinct ids, by all pairs."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    c = (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2) >= least
    np.fill_diagonal(c, False)
    root = np.array(ids)
    while True:
        new = np.array([min([root[i], *root[c[i]]]) for i in range(len(ids))])
        if (new == root).all():
            return {i: (int(n), int(r)) for i, n, r in zip(ids, c.sum(axis=1), root, strict=True)}
        root = new


def told(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def test_vectors_match_sql(spark, con):
    text, ok = compare(spark, con, SMALL, "op13_metric_range_join")
    assert ok, text


@pytest.mark.parametrize("least", [0.9, 0.6])
def test_links_across_cells_and_cut_groups(spark, monkeypatch, least):
    for name, value in (("ROWS_A_CELL", 20), ("HOME", 16), ("PARTNERS", 50), ("BLOCK", 8), ("STEP", 64)):
        monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 5))
    rows = [(i, (centre[i % 12] + rng.normal(scale=0.35, size=5)) * 10.0 ** rng.integers(-3, 4)) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # copies
    rows = [(i, [float(a) for a in v]) for i, v in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert told(metric_join.near_vectors(df, least)) == plain_links(rows, least)


def test_a_cell_sees_all_within_the_radius():
    rng = np.random.default_rng(2)
    x = metric_join.unit(rng.normal(size=(500, 3)))
    pivots = x[:20]
    home, sees = metric_join.seen_by(x, pivots, 0.3)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.3 ** 2
    assert all(sees[j, home[i]] for i, j in zip(*np.nonzero(near), strict=True)) and not sees.all()


def test_messy_near_vectors(spark):
    big, tiny = [1e200, 1e200], [1e-200, 1.1e-200]
    rows = [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [-1.0, -2.0]), (3, None), (4, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0]), (10, []), (None, [1.0, 2.0]), (11, big), (12, tiny)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, id string, n int")
    got = told(metric_join.near_vectors(df))
    assert got.pop(None) == (0, None)
    # 1 and 5 point one way, 11 and 12 another, and these are within 0.9 of each other
    assert got == {5: (3, 1), 1: (3, 1), 11: (3, 1), 12: (3, 1), **{i: (0, i) for i in (2, 3, 4, 6, 7, 8, 9, 10)}}
    assert metric_join.near_vectors(df.limit(0)).count() == 0
    assert told(metric_join.near_vectors(df.where("vec_id IN (3, 4)"))) == {3: (0, 3), 4: (0, 4)}


def test_links_need_no_module_of_another(tmp_path):
    """A fresh worker gets its rows as Arrow bytes and has loaded pyarrow alone: what else
    of it a task uses, its module imports."""
    block = bf.pack(np.array([1, 2]), np.array([1, 1]), np.array([1.0, 0.0, 1.0, 0.1]))
    rows = pa.record_batch({"is_own": [True, False], "block": [block, block]})
    with pa.ipc.new_file(tmp_path / "rows", rows.schema) as out:
        out.write(rows)
    code = """
import sys
import pyarrow as pa
from barloom.llm.metric_join import _links
found = _links(0.9)(pa.ipc.open_file(sys.argv[1]).read_all())
assert sorted(zip(*(found[c].to_pylist() for c in ("kind", "a", "b")))) == [(0, 1, 1), (0, 2, 1), (1, 2, 1)]
"""
    root = Path(__file__).resolve().parents[2]
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "rows")], check=True, cwd=root)
