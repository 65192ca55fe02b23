"""Ranked lexical search."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from check_oracle import compare
from llm_helpers import PROSE, lower, messy

from barloom.llm import lexical_tree as lt

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_best(docs, items, k=10):
    tf = {d: Counter(TERM.findall(lower(t))) for d, t in docs}
    tf = {d: c for d, c in tf.items() if c}
    n_docs, n_terms = len(tf), sum(sum(c.values()) for c in tf.values())
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tf.items():
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
                    for w in set(TERM.findall(lower(text))) if w in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_matches_sql(spark, con):
    text, ok = compare(spark, con, SMALL, "op11_fp_tree_search")
    assert ok, text


@pytest.mark.parametrize("leaf, docs, block", [(256, 1 << 15, 1 << 17), (3, 40, 300), (1, 7, 1 << 17)])
def test_search_matches_plain_version(spark, monkeypatch, leaf, docs, block):
    for name, value in (("LEAF", leaf), ("TREE_DOCS", docs), ("BLOCK_BYTES", block), ("SHARED", 5 if leaf == 3 else 24)):
        monkeypatch.setattr(lt, name, value)
    rng = np.random.default_rng(leaf)
    word = lambda: f"w{min(int(rng.pareto(0.7)), 80)}"
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(500)]
    rows += [(1000 + i, rows[i % 5][1].upper()) for i in range(100)]  # copies: ties
    items = [(i, ",".join(word() for _ in range(int(rng.integers(0, 12))))) for i in range(30)]
    got = lt.best_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"))
    assert told(got) == plain_best(rows, items)


def test_bounds_hold_and_leave_documents_out():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 9, 3000)
    # a few documents hold the rare terms
    term = np.concatenate([np.sort(rng.choice(30, n, replace=False, p=np.arange(30, 0, -1) / 465)) for n in counts])
    tree = lt.Tree(np.arange(3000), rng.integers(10, 200, 3000), counts, term, rng.integers(1, 6, len(term)), np.arange(1, 31) * 100)
    assert max(tree.hi[i] - tree.lo[i] for i, c in enumerate(tree.children) if not c) <= lt.LEAF
    scored = []
    for node, below in enumerate(tree.children):
        assert not below or (tree.lo[below[0]], tree.hi[below[-1]]) == (tree.lo[node], tree.hi[node])
    for terms in ([0, 1], [25, 29], [3, 17, 28]):
        bound, terms = tree.bounds(np.array(terms)), np.array(terms)
        for node, below in enumerate(tree.children):
            if not below:
                assert tree.score(node, terms)[1].max(initial=0) <= bound[node]
        score = tree.score
        tree.score = lambda node, t, score=score: scored.append(node) or score(node, t)
        tree.search(terms, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        tree.score = score
    assert len(scored) < 3 * len(tree.leaf_of)


def test_messy_search(spark):
    items = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, " .,;", "x"), (4, "WORD", "x"), (None, PROSE, "x"), (5, "absent", "x"), (4, "zzz", "x")],
                                  "item_id long, text string, score string")
    rows = [(i, t) for i, t, _ in [(1, PROSE, 0), (2, PROSE, 0), (3, PROSE + " and one more", 0), (7, "lorem ipsum dolor " * 20000, 0), (8, "word", 0), (9, "word", 0),
                                   (10, "\x0b\x85 é " * 60, 0)]]
    assert told(lt.best_documents(messy(spark), items)) == plain_best(rows, [(1, PROSE), (4, "WORD")])
    assert lt.best_documents(messy(spark, []), items).count() == 0
    assert lt.best_documents(messy(spark), items.limit(0)).count() == 0
