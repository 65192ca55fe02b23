"""Repair of conversations."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
from check_oracle import compare

from barloom.llm import conversations as cv

SMALL = "/root/testdata/sf0.001"
FORM = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        conv, role, text = (" " if x is None else str(x) for x in (conv, role, text))
        fate = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        out.setdefault(conv, [])
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain_repair(rows):
    """Everything that is wanted of one conversation, by the cheapest continuation of every prefix."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] + "\0" + r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @functools.cache
    def best(i, last, inserted):
        """Least (cost, audit, turns) from row i on, after a turn that begins with ``last``."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))

        def add(cost, letter, role, text, i, inserted):
            if role is not None:
                x = role[:1]
                if (last, x) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    return
            rest = best(i, last if role is None else role[:1], inserted)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], (() if role is None else (f"{role}:{text}",)) + rest[2]))
        if inserted < 3:
            for role in ("user", "assistant"):
                add(2, "I", role, "", i, inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            add(3, "D", None, None, i + 1, 0)
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                add(cut, "K", role, text, i + 1, 0)
                for other in ("user", "assistant"):
                    add(2 + cut, "R", other, text, i + 1, 0)
        return min(ways, default=None)

    for i in range(len(rows), 0, -20):  # keeps the recursion shallow
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    cost, audit, turns = best(0, "", 0)
    assert FORM.fullmatch("".join(t[0] for t in turns))
    known = [r[0] for r in rows if r[0] is not None]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest())


def told(df):
    return {" " if r.conv_id is None else str(r.conv_id): tuple(r)[1:] for r in df.collect()}


def some(rng, n):
    return [(int(rng.integers(1, n // 6)) if rng.random() > 0.02 else None, int(rng.integers(0, 9)) if rng.random() > 0.1 else None,
             str(rng.choice(["user", "assistant", "system", "tool", ""])) if rng.random() > 0.05 else None,
             str(rng.choice(["Yes.", "no", "Why?", " ", "", "é!\n", " ", "a.\x00"])) if rng.random() > 0.05 else None) for _ in range(n)]


def test_repair_matches_sql(spark, con):
    text, ok = compare(spark, con, SMALL, "op12_structure_repair")
    assert ok, text


@pytest.mark.parametrize("rows", [4096, 3])
def test_repair_matches_plain_version(spark, monkeypatch, rows):
    monkeypatch.setattr(cv, "PIECE_ROWS", rows)
    data = some(np.random.default_rng(rows), 900)
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "conv_id long, turn long, role string, text string, conv string, n int").repartition(7)
    assert told(cv.damage_and_repair(df)) == {k: plain_repair(v) for k, v in plain_damage(data).items()}


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(cv, "PIECE_ROWS", 50)
    rng = np.random.default_rng(8)
    data = [(7, i // 2, str(rng.choice(["user", "assistant"])), f"text {rng.integers(0, 300)}.") for i in range(700)]
    data += [(7, 900, "user", "same.")] * 200 + [(8, 0, "user", "same.")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    pieces = cv.repaired_pieces(cv.damaged(cv.keyed(df)))
    assert pieces.where("conv = '7'").select("part").distinct().count() > 1
    assert told(cv.damage_and_repair(df)) == {k: plain_repair(v) for k, v in plain_damage(data).items()}


def test_ranks_are_those_of_the_audits():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 12, 60)
    codes = rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 9, 26], int(sizes.sum()))
    letter, target = cv.least_arcs(codes, sizes, cv.costs_to_go(codes, sizes))
    rank, _, length = cv.ranked(letter, target)

    def audit(v):
        return "" if letter[v] == 0 else chr(cv.LETTERS[letter[v]]) + audit(target[v])
    every = [audit(v) for v in range(len(letter))]
    assert [len(a) for a in every] == length.tolist()
    order = {a: i for i, a in enumerate(sorted(set(every)))}
    assert rank.tolist() == [order[a] for a in every]


def test_conversations_without_rows(spark):
    schema = "conv_id string, turn long, role string, text string"
    gone = next(f"c{i}" for i in range(1000) if zlib.crc32(f"c{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)
    empty = hashlib.sha256().hexdigest()
    assert [tuple(r) for r in cv.damage_and_repair(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert cv.damage_and_repair(df.limit(0)).count() == 0
