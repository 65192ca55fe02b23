"""Repeated bytes, near duplicates and benchmark passages against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import LONG, PROSE, messy, plain_components, plain_repeats, words

from barloom.llm import decontaminate, jaccard_join, suffix_dedup
from barloom.llm.stored import stored

SMALL = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def family(rng, n_docs):
    """Texts that share passages, repeat within themselves and come as edited copies."""
    passage, out = prose(rng, 40), []
    for i in range(n_docs):
        kind = i % 6
        base = prose(rng, rng.randint(5, 120))
        if kind == 1:
            base = base + " " + passage + " " + prose(rng, 5)
        elif kind == 2 and out:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            base = " ".join(w)
        elif kind == 3:
            base = "ab " * rng.randint(1, 90)
        elif kind == 4:
            base = (base[:150] + "\n") * 3
        out.append((i * 3, base))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_all_windows(spark, seed):
    rows = family(random.Random(seed), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    want = {d: (n, g, s, hashlib.sha256(k).hexdigest()) for d, (n, g, s, k) in plain_repeats(rows).items()}
    assert got == want


def test_suffix_ranks_are_byte_order():
    data = np.frombuffer(b"banana bandana \xff\x00 banana", np.uint8)
    rank = suffix_dedup.suffix_ranks(data, 16)
    strings = [bytes(np.append(data, np.zeros(24, np.uint8))[i:i + 16]) for i in range(len(data))]
    assert [a < b for a, b in zip(rank, rank[1:], strict=False)] == [a < b for a, b in zip(strings, strings[1:], strict=False)]


def test_nearest_smaller_matches_a_scan():
    rng = np.random.default_rng(1)
    for n, high in [(0, 1), (1, 5), (63, 9), (64, 1), (65, 70), (300, 4), (900, 10**6), (1000, 1)]:
        for p in (rng.integers(0, high, n), np.arange(n), np.arange(n)[::-1], np.append(np.arange(5, 5 + n), [0, 3])):
            want = [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(len(p))]
            assert suffix_dedup.nearest_smaller(p).tolist() == want


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_previous_factors_match_all_pairs(letters):
    rng = np.random.default_rng(letters)
    texts = [bytes(rng.integers(97, 97 + letters, rng.integers(12, 60))) for _ in range(8)] + [b"abcabcabc" * 4, b"\0" * 20 + b"\xff" * 20]
    texts += [texts[3], texts[0][:15] + texts[5]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    ids = rng.permutation(len(texts))  # documents do not lie in the order of their ids
    where = [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 11)]
    at, doc, start = (np.array(x) for x in zip(*[(off[d] + i, ids[d], i) for d, i in where], strict=True))
    got = suffix_dedup.previous_factors(data, at, doc, start, 12)
    strings = [texts[d][i:i + 12] for d, i in where]
    share = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
    place = list(zip(doc.tolist(), start.tolist(), strict=True))
    want = [max((share(a, b) for b, y in zip(strings, place, strict=True) if y < x), default=0) for a, x in zip(strings, place, strict=True)]
    assert got.tolist() == want


def test_phrase_in_many_surroundings(spark, monkeypatch):
    """One key of many pieces, cut by second keys, gives the spans of all windows."""
    rng = random.Random(4)
    phrase, longer = prose(rng, 12)[:60], prose(rng, 60)[:240]
    rows = [(i, f"{prose(rng, 8)} {phrase} {prose(rng, 8)} {longer if i % 3 else longer[:130]} {prose(rng, rng.randint(0, 30))}") for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, longer * 3)]
    cut = []
    for hot in (0, 8, 4096):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        cut.append({r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()})
    want = {d: (n, g, s, hashlib.sha256(k).hexdigest()) for d, (n, g, s, k) in plain_repeats(rows).items()}
    assert cut == [want] * 3


def test_repeats_of_messy_rows(spark):
    got = suffix_dedup.remove_repeats(messy(spark)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert sorted(by) == list(range(1, 11)) and sum(r.doc_id is None for r in got) == 2
    assert by[1].n_removed == 0 and by[2].n_removed == len(PROSE) and by[2].n_spans == 1
    assert by[3].n_removed == len(PROSE) and by[4].n_bytes == by[5].n_bytes == 0
    assert by[5].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[7].n_removed == len(LONG) - len("lorem ipsum dolor ")
    assert {r.n_removed for r in got if r.doc_id is None} == {0}
    assert suffix_dedup.remove_repeats(messy(spark, [])).count() == 0


def test_kept_text(spark):
    df = spark.createDataFrame([(1, PROSE), (2, "x" + PROSE + "y")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(df, True).collect()} == {1: PROSE, 2: "xy"}


@pytest.mark.parametrize("longest", [64, 3])
def test_components_match_all_pairs(spark, monkeypatch, longest):
    monkeypatch.setattr(jaccard_join, "LIST", longest)
    rng = random.Random(5)
    rows = family(rng, 60)
    base = prose(rng, 60).split(" ")
    for i in range(40):  # a family of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE  two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == plain_components(rows)


def test_chance_candidates_leave_no_whole_sets(spark, monkeypatch):
    """Texts that share a phrase only are told apart by what came with the prefixes."""
    written = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: written.append((name, out := stored(df, name))) or out)
    monkeypatch.setattr(jaccard_join, "HEAVY_COUNT", 10**9)
    rng = random.Random(8)
    phrases = [prose(rng, 7) for _ in range(12)]
    rows = [(i, f"{phrases[i % 12]} {prose(rng, 12)}") for i in range(60)] + [(100, prose(rng, 40))]
    rows += [(101, rows[-1][1] + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == plain_components(rows) and got[101][1] == 100
    assert sum(df.count() for name, df in written if name == "candidates") > 1
    assert [df.count() for name, df in written if name == "shingle-sets"] == [2]


def test_chained_lists_are_searched_one_by_one(spark, monkeypatch):
    """Long lists hang together by single texts; only members of one list meet."""
    monkeypatch.setattr(jaccard_join, "LIST", 4)
    monkeypatch.setattr(jaccard_join, "HEAVY_COUNT", 10**9)
    units = []
    families = jaccard_join._families
    monkeypatch.setattr(jaccard_join, "_families", lambda links, family: units.append(family.groupBy("family").count().collect()) or families(links, family))
    rng = random.Random(6)
    parts = [prose(rng, 9) for _ in range(9)]
    rows = []
    for k, part in enumerate(parts):
        rows += [(100 * k + i, f"{part} {prose(rng, 5)}") for i in range(6)]
        rows.append((100 * k + 50, f"{part} {parts[(k + 1) % 9]}"))  # of two lists
        rows.append((100 * k + 60, f"{rows[-4][1]} {prose(rng, 1)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == plain_components(rows)
    assert units and max(r["count"] for r in units[0]) <= 12


def test_components_of_messy_rows(spark):
    got = jaccard_join.near_duplicates(messy(spark)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert sorted(by) == list(range(1, 11))
    assert by[2].component_id == by[3].component_id == 1 and by[9].component_id == 8
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[5].component_id == 5 and by[6].component_id == 6
    assert by[7].n_shingles == 3
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, by[1].n_shingles]
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert jaccard_join.near_duplicates(messy(spark, [])).count() == 0


def test_sketches_never_deny_a_link():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(5, 400))
        a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        b = np.append(a[int(n * 0.05):], rng.choice(1 << 40, int(n * 0.05), replace=False).astype(np.uint64))
        bits = [1 << max(6, (4 * len(x)).bit_length()) for x in (a, b)]
        s = [np.packbits((np.bincount((x & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1).astype(np.uint8)) for x, w in zip((a, b), bits, strict=True)]
        small = min(map(len, s))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, small), axis=0) for v in s)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_greedy_tiles():
    tile = decontaminate.greedy_tiles
    item = list(range(30))
    assert tile(item, item) == [(0, 0, 30)]
    assert sorted(tile(item, item[15:] + [-1] + item[:15])) == [(0, 16, 15), (15, 0, 15)]
    assert tile(item, [5, 6, 7, 8]) == []
    assert sum(t[2] for t in tile([1, 2, 3, 4, 5] * 4, [1, 2, 3, 4, 5])) == 5  # a tile is used once
    assert sum(t[2] for t in tile(list(range(100)), [*range(50), -1, *range(45, 100)])) == 100


def plain_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if len(v) >= 5:
                code = {x: k for k, x in enumerate(dict.fromkeys(v + w))}
                if sum(x[2] for x in decontaminate.greedy_tiles([code[x] for x in v], [code[x] for x in w])) >= 0.6 * len(v):
                    out.add((d, i))
    return out


def test_leaks_match_all_pairs(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(6, 50))) for i in range(12)] + [(50, "too short"), (51, None)]
    docs = []
    for d in range(60):
        text = prose(rng, 60)
        if d % 3 == 0:
            w = items[d % 12][1].split(" ")
            if d % 2:
                h = len(w) // 2
                w = w[h:] + prose(rng, 3).split(" ") + w[:h]  # the halves change places
            cut = w[:max(3, int(len(w) * rng.choice([1, 0.8, 0.4])))]
            text = text[:100] + " " + " ".join(cut) + " " + text[100:]
        docs.append((d, text))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(a, b).collect()}
    assert got == plain_leaks(docs, items) and got
    assert {r.doc_id for r in decontaminate.clean_of(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_leaks_of_messy_rows(spark):
    items = spark.createDataFrame([(1, PROSE, "x"), (2, PROSE, "y"), (3, None, "z"), (None, "", "z")], "item_id long, text string, runs string")
    got = decontaminate.contaminated(messy(spark), items).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    kept = decontaminate.clean_of(messy(spark), items)
    assert kept.columns == messy(spark).columns and kept.count() == 13 - 5
    none = items.limit(0)
    assert decontaminate.contaminated(messy(spark), none).count() == 0 and decontaminate.clean_of(messy(spark, []), items).count() == 0


def test_leaks_of_repetitive_and_short_items(spark):
    rng = random.Random(4)
    phrase, other = prose(rng, 10), prose(rng, 10)
    items = [(1, " ".join([phrase] * 10)), (2, "Alpha beta gamma"), (3, "delta"), (4, "one two three four"), (5, "beta beta")]
    docs = [(1, f"{prose(rng, 30)} {items[0][1]} {prose(rng, 30)}"), (2, f"{other} alpha BETA gamma {other}"), (3, "alpha beta"), (4, "alpha beta x gamma"),
            (5, "delta"), (6, f"{phrase} {other} one two three {other} four"), (7, "one two three four"), (8, " ".join([phrase] * 5))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_covered, r.n_tiles) for r in decontaminate.contaminated(a, b).collect()}
    assert got == {(1, 1): (100, 100, 1), (2, 2): (3, 3, 1), (5, 3): (1, 1, 1), (7, 4): (4, 4, 1)}
    assert {r.doc_id for r in decontaminate.clean_of(a, b).collect()} == {3, 4, 6, 8}
