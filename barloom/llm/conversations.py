"""Repair of the turn structure of conversations with the fewest edits.

A repaired conversation reads as an optional system turn and then user and assistant
in turn. A dynamic program over (row, state) gives the cost to go of every node; among
the cheapest edits the one whose audit (the initials of Keep, Rerole, Delete and
Insert) comes first in ASCII is wanted. No two arcs of a node have the same initial, so
its least optimal arc is a pointer; nodes are ranked by the first 1, 2, 4, ... letters of
their audits, each rank made of the rank of a node and that of the node its doubled
pointer leads to, until every pointer has come to an end. The audit is then read
through the doubled pointers, all its letters at once.

Rows are put in order by range over (conversation, turn, role and text), equal rows
collapsed before, so a long conversation spreads over many tasks. A task cuts what it
gets into pieces of bounded size and finishes every conversation that it has whole in one
piece. The few others leave one byte a row, which is what their audit takes
in the result anyway, to one task for the program; their texts stay in their pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.stored import stored

PIECE_ROWS = 4096
PIECE_BYTES = 1 << 20
CHUNK_ROWS = 1 << 15
ORDER_PREFIX = 128

# states: nothing yet, after system, after user, after assistant; 4 stands for none
SYSTEM, USER, ASSISTANT, OTHER = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {2: "user", 3: "assistant"}
TURN = np.array([2, 2, 3, 2])
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
AT_END = np.array([0, 4, 2, 0])
LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST = 0, 2, 3, 2
TRUNCATED, GONE, BLANK, COPY = 4, 8, 16, 32
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_NEVER = np.int64(1) << 40
_WHITE = " \t\n\x0b\x0c\r"


# ---- the program -------------------------------------------------------------------------

def costs_to_go(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(layers, 4): least cost from each state before each row, and after the last; a
    conversation of n rows has n + 1 layers."""
    begin = np.cumsum(sizes) - sizes
    out = np.empty((len(codes) + len(sizes), 4), np.int64)
    out[begin + np.arange(len(sizes)) + sizes] = AT_END
    by_size = np.argsort(-sizes, kind="stable")
    growing = np.sort(sizes)
    for t in range(1, int(sizes.max(initial=0)) + 1):
        some = by_size[:len(sizes) - np.searchsorted(growing, t)]
        row = begin[some] + sizes[some] - t
        layer = row + some
        after = np.concatenate([out[layer + 1], np.full((len(some), 1), _NEVER)], axis=1)
        code = codes[row]
        cut = ((code & TRUNCATED) > 0).astype(np.int64)[:, None]
        kept = np.minimum(np.take_along_axis(after, KEEP[code & 3], axis=1) + KEEP_COST, after[:, TURN] + REROLE_COST) + cut
        kept[(code & GONE) > 0] = _NEVER
        c = np.minimum(after[:, :4] + DELETE_COST, kept)
        user, assistant = np.minimum(c[:, 2], c[:, 3] + INSERT_COST), np.minimum(c[:, 3], c[:, 2] + INSERT_COST)
        out[layer] = np.stack([np.minimum(c[:, 0], user + INSERT_COST), np.minimum(c[:, 1], user + INSERT_COST), user, assistant], axis=1)
    return out


def least_arcs(codes: np.ndarray, sizes: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node (layer * 4 + state) the letter of its first optimal arc (0: the end) and where it leads."""
    layers = len(cost)
    last = np.zeros(layers, bool)
    last[np.cumsum(sizes + 1) - 1] = True
    code = np.zeros(layers, np.int64)
    code[~last] = codes
    after = np.concatenate([np.roll(cost, -1, axis=0), np.full((layers, 1), _NEVER)], axis=1)
    cut = ((code & TRUNCATED) > 0).astype(np.int64)[:, None]
    may = (~last & ((code & GONE) == 0))[:, None]
    state = np.arange(4)[None].repeat(layers, axis=0)
    kept, here = KEEP[code & 3], np.arange(layers)[:, None] * 4
    letter, target = np.zeros((layers, 4), np.int64), here + state
    for which, fits, to in (  # the first letter that fits is written last
            (4, may & (cost == after[:, TURN] + REROLE_COST + cut), here + 4 + TURN[None]),
            (3, may & (cost == np.take_along_axis(after, kept, axis=1) + KEEP_COST + cut), here + 4 + kept),
            (2, cost == cost[:, TURN] + INSERT_COST, here + TURN[None]),
            (1, ~last[:, None] & (cost == after[:, :4] + DELETE_COST), here + 4 + state)):
        letter[fits] = which
        target = np.where(fits, to, target)
    return letter.reshape(-1), target.reshape(-1)


def ranked(letter: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(rank of each node's audit, pointers over 1, 2, 4, ... letters, audit lengths).

    Each round doubles the letters that ranks stand for; it ends once all pointers have
    come to an end node.
    """
    rank, leads = letter.copy(), [target]
    length = (letter > 0).astype(np.int64)
    while letter[leads[-1]].any():
        to = leads[-1]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[to], return_inverse=True)[1]
        length = length + length[to]
        leads.append(to[to])
    return rank, leads, length


def audits(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost of each conversation, letters of all audits, audit lengths)."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    cost = costs_to_go(codes, sizes)
    letter, target = least_arcs(codes, sizes, cost)
    _, leads, length = ranked(letter, target)
    start = (np.cumsum(sizes + 1) - sizes - 1) * 4
    n = length[start]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    node = np.repeat(start, n)
    for bit, to in enumerate(leads):
        node = np.where((step >> bit) & 1, to[node], node)
    return cost[start // 4, 0], LETTERS[letter[node]], n


def walk(letters: bytes, codes: np.ndarray, state: int) -> tuple[list[tuple[int, str | None]], int]:
    """([(place among the rows' own texts or -1, new role or None if kept)], state after them)."""
    out, row, place = [], 0, 0
    for x in letters:
        if x != 73:  # all but Insert take a row
            code = int(codes[row])
            row += 1
            if not code & COPY:
                place += 1
        if x == 75:
            state = int(KEEP[code & 3, state])
            out.append((place - 1, None))
        elif x != 68:
            state = int(TURN[state])
            out.append((-1 if x == 73 else place - 1, ROLES[state]))
    return out, state


# ---- rows to pieces ----------------------------------------------------------------------

PIECE = ("conv string, part int, seq int, whole boolean, low long, high long, turns long, codes binary, prints binary, "
         "roles array<string>, texts array<string>, audit string, cost long")


def _code(role: str, text: str) -> int:
    bare = text.rstrip(_WHITE)
    initial = INITIALS.get(role[:1], OTHER)
    if not bare:
        return initial | GONE | BLANK
    return initial | (0 if bare[-1] in ".!?" else TRUNCATED)


class _Piece:
    def __init__(self, conv: str, part: int, seq: int):
        self.conv, self.part, self.seq, self.bytes = conv, part, seq, 0
        self.codes, self.prints, self.roles, self.texts, self.turns = bytearray(), bytearray(), [], [], set()

    def add(self, turn, role: str, text: str, n: int, seen: set) -> None:
        """A row that stands n times: its copies are blank, or duplicates, which go."""
        code = _code(role, text)
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if not code & GONE:
            if mark in seen:
                code = (code & 3) | GONE
            seen.add(mark)
        self.codes.append(code)
        self.prints += mark
        if n > 1:
            copy = (code | GONE | COPY) & ~TRUNCATED
            self.codes += bytes([copy]) * (n - 1)
            self.prints += mark * (n - 1)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None:
            self.turns.add(turn)
        self.bytes += len(text)


def _batch(pieces: list[_Piece], whole: bool) -> pa.RecordBatch:
    codes = [np.frombuffer(p.codes, np.uint8).astype(np.int64) for p in pieces]
    sizes = np.array([len(c) for c in codes], np.int64)
    cost, told = [None] * len(pieces), [None] * len(pieces)
    if whole:
        cost, letters, n = audits(np.concatenate(codes), sizes)
        at = np.concatenate([[0], np.cumsum(n)])
        told = [letters[at[i]:at[i + 1]].tobytes().decode() for i in range(len(pieces))]
    return pa.RecordBatch.from_pydict({
        "conv": pa.array([p.conv for p in pieces]), "part": pa.array([p.part for p in pieces], pa.int32()),
        "seq": pa.array([p.seq for p in pieces], pa.int32()), "whole": pa.array([whole] * len(pieces)),
        "low": pa.array([min(p.turns, default=None) for p in pieces], pa.int64()), "high": pa.array([max(p.turns, default=None) for p in pieces], pa.int64()),
        "turns": pa.array([len(p.turns) for p in pieces], pa.int64()), "codes": pa.array([bytes(p.codes) for p in pieces], pa.binary()),
        "prints": pa.array([None if whole else bytes(p.prints) for p in pieces], pa.binary()),
        "roles": pa.array([p.roles for p in pieces], pa.list_(pa.string())), "texts": pa.array([p.texts for p in pieces], pa.list_(pa.string())),
        "audit": pa.array(told, pa.string()), "cost": pa.array(cost, pa.int64())})


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to pieces; conversations at either end of a partition may go on in another."""
    done: list[_Piece] = []
    held = rows = 0
    piece, edge, seen = None, True, set()
    for batch in batches:
        for part, conv, turn, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("part", "conv", "turn", "role", "text", "n")), strict=True):
            if piece is None or piece.conv != conv:
                if piece is not None:
                    if edge or piece.seq:
                        yield _batch([piece], False)
                    else:
                        done.append(piece)
                        held, rows = held + piece.bytes, rows + len(piece.codes)
                    edge = False
                else:
                    edge = True
                piece, seen = _Piece(conv, part, 0), set()
                if held >= PIECE_BYTES or rows >= CHUNK_ROWS:
                    yield _batch(done, True)
                    done, held, rows = [], 0, 0
            elif len(piece.codes) >= PIECE_ROWS or piece.bytes >= PIECE_BYTES:
                yield _batch([piece], False)
                piece = _Piece(conv, part, piece.seq + 1)
            piece.add(turn, role, text, n, seen)
    if done:
        yield _batch(done, True)
    if piece is not None:
        yield _batch([piece], False)


# ---- conversations in several pieces -----------------------------------------------------

def _own_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that may repeat one of an earlier piece."""
    for batch in batches:
        for conv, part, seq, codes, prints in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "seq", "codes", "prints")), strict=True):
            at = np.flatnonzero((np.frombuffer(codes, np.uint8) & GONE) == 0)
            yield pa.RecordBatch.from_pydict({
                "conv": pa.array([conv] * len(at), pa.string()), "mark": pa.array([prints[16 * i:16 * i + 16] for i in at], pa.binary()),
                "part": pa.array([part] * len(at), pa.int32()), "seq": pa.array([seq] * len(at), pa.int32()), "row": pa.array(at.astype(np.int32))})


def _long_audit(table: pa.Table) -> pa.Table:
    """The audit of one conversation, dealt back to its pieces with the state each begins in."""
    table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
    codes = []
    for raw, again in zip(table["codes"].to_pylist(), table["again"].to_pylist(), strict=True):
        c = np.frombuffer(raw, np.uint8).copy()
        if again:
            c[again] = (c[again] & (3 | COPY)) | GONE
        codes.append(c)
    every = np.concatenate(codes).astype(np.int64)
    cost, letters, _ = audits(every, np.array([len(every)]))
    takes = np.cumsum(letters != 73)
    # a piece has the letters of its rows and the inserts before them, the last one those at the end
    ends = np.searchsorted(takes, np.cumsum([len(c) for c in codes]), side="left") + 1
    begin, state, told, states = 0, 0, [], []
    for i, c in enumerate(codes):
        end = int(ends[i]) if i + 1 < len(codes) else len(letters)
        told.append(letters[begin:end].tobytes())
        states.append(state)
        state = walk(told[-1], c, state)[1]
        begin = end
    return pa.table({"conv": table["conv"], "part": table["part"], "seq": table["seq"], "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
                     "audit": pa.array([t.decode() for t in told]), "state": pa.array(states, pa.int32()),
                     "cost": pa.array([int(cost[0])] + [None] * (len(codes) - 1), pa.int64())})


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each piece and what was wrong in it."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        if not batch.num_rows:
            continue
        repaired, facts = [], []
        for raw, audit, state, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("codes", "audit", "state", "roles", "texts")), strict=True):
            codes = np.frombuffer(raw, np.uint8)
            repaired.append([{"role": roles[at] if role is None else role, "text": "" if at < 0 else texts[at]}
                             for at, role in walk(audit.encode(), codes, state)[0]])
            init, gone, blank = codes & 3, (codes & GONE) > 0, (codes & BLANK) > 0
            facts.append((int(blank.sum()), int((gone & ~blank).sum()), int(((codes & TRUNCATED) > 0).sum()),
                          int((~LEGAL[init[:-1], init[1:]]).sum()), int(init[0]), int(init[-1])))
        yield pa.RecordBatch.from_pydict(
            {c: batch.column(c) for c in ("conv", "part", "seq", "low", "high", "turns", "audit", "cost")}
            | {"repaired": pa.array(repaired, turn)}
            | {c: pa.array(x, pa.int64()) for c, x in zip(("blank", "duplicate", "truncated", "illegal", "first", "last"), zip(*facts, strict=True), strict=True)})


REPAIRED = ("conv string, part int, seq int, low long, high long, turns long, audit string, cost long, repaired array<struct<role:string,text:string>>, "
            "blank long, duplicate long, truncated long, illegal long, first long, last long")


def repaired_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations, in order by (part, seq): their turns as ``repaired``,
    audit, faults and boundary values. ``rows`` has conv, turn, role and text, no nulls but in turn.

    Rows of one turn stand in the order of role and text; equal rows follow each other.
    """
    spark = rows.sparkSession
    whole_key = F.concat("role", F.lit("\0"), "text")
    distinct = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (distinct.repartitionByRange(parts, "conv", "turn", F.substring(whole_key, 1, ORDER_PREFIX))
              .withColumn("part", F.spark_partition_id()).sortWithinPartitions("conv", "turn", whole_key))
    pieces = stored(ranged.mapInArrow(_cut, PIECE), "conversation-pieces")
    long = pieces.where("NOT whole")
    at = F.struct("part", "seq", "row")
    # a task leaves one row of a text at most, so a list is no longer than there are tasks
    again = (long.select("conv", "part", "seq", "codes", "prints").mapInArrow(_own_marks, "conv string, mark binary, part int, seq int, row int")
             .groupBy("conv", "mark").agg(F.collect_list(at).alias("all")).where("size(all) > 1")
             .select("conv", F.explode(F.array_except("all", F.array(F.array_min("all")))).alias("x"))
             .groupBy("conv", "x.part", "x.seq").agg(F.collect_list("x.row").alias("again")))
    key = ["conv", "part", "seq"]
    told = (long.select(*key, "codes").join(again, key, "left").groupBy("conv")
            .applyInArrow(_long_audit, "conv string, part int, seq int, codes binary, audit string, state int, cost long"))
    long = long.drop("codes", "audit", "cost").join(told, key)
    columns = [*key, "low", "high", "turns", "codes", "roles", "texts", "audit", "cost", "state"]
    ready = pieces.where("whole").withColumn("state", F.lit(0)).select(columns).unionByName(long.select(columns))
    return ready.mapInArrow(_apply, REPAIRED)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; a text passes once, batch by batch."""
    now = None
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv"] != r["conv"]:
                if now is not None:
                    yield _told(now)
                now = {"conv": r["conv"], "hash": hashlib.sha256(), "audit": [], "any": False, "last": None, "low": None, "high": None,
                       "turns": 0, "cost": 0, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)}
            for turn in r["repaired"]:
                now["hash"].update(("\n" * now["any"] + turn["role"] + ":" + turn["text"]).encode())
                now["any"] = True
            now["audit"].append(r["audit"])
            now["cost"] += r["cost"] or 0
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += r[c]
            if now["last"] is not None:
                now["illegal"] += not LEGAL[now["last"], r["first"]]
            now["last"] = r["last"]
            now["turns"] += r["turns"] - (r["low"] is not None and r["low"] == now["high"])
            if r["low"] is not None:
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = r["high"]
    if now is not None:
        yield _told(now)


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _told(x: dict) -> pa.RecordBatch:
    gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]
    row = {"conv": x["conv"], "gaps": gaps, **{c: int(x[c]) for c in ("blank", "duplicate", "truncated", "illegal", "cost")},
           "audit": "".join(x["audit"]), "repaired_sha256": x["hash"].hexdigest()}
    return pa.RecordBatch.from_pylist([row])


def summaries(pieces: DataFrame) -> DataFrame:
    """(conv, gaps, faults, cost, audit, repaired_sha256) of ``repaired_pieces``."""
    pieces = stored(pieces, "repaired-conversations")
    several = pieces.groupBy("conv").count().where("count > 1").select("conv")
    line = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    one = pieces.join(several, "conv", "left_anti").select(
        "conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    more = (pieces.join(several, "conv", "left_semi").repartition("conv").sortWithinPartitions("conv", "part", "seq")
            .mapInArrow(_summed, SUMMARY))
    return one.unionByName(more)


# ---- the conversations of the query ------------------------------------------------------

def keyed(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with one space for null conversations, roles and texts."""
    space = F.lit(" ")
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (keyed) dropped, emptied, cut, repeated or given to the user by crc32 of ``conv:turn``."""
    fate = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    f = F.col("_fate")
    text = F.when(f == 1, "").when(f == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.withColumn("_fate", fate).where("_fate <> 0")
            .select("conv", "turn", F.when(f == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(f == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Per conversation after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored. Null
    conversations are one conversation, null roles and texts a space, null turns come
    first and count for no gap. Roles begin with s, u or a; any other (an empty one too)
    can't be kept. Rows of one turn stand in the order of role and text; rows equal in all
    are duplicates. Conversations that lose all rows have zeros, an empty audit and the
    hash of nothing. An empty table gives no rows.
    """
    rows = keyed(conversations)
    told = summaries(repaired_pieces(damaged(rows)))
    kind = conversations.schema["conv_id"].dataType
    nothing = hashlib.sha256().hexdigest()
    conv_id = F.when(F.col("conv") != " ", F.col("conv").cast(kind)).alias("conv_id")
    return rows.select("conv").distinct().join(told, "conv", "left").select(
        conv_id, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE bits(i, c, n) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
k AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT k.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS fate FROM k, crc),
d AS (SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
a AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS init, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before FROM o),
g AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM a GROUP BY 1),
ins(s, t, k) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (2, 3, 'I'), (3, 2, 'I'), (0, 3, 'II'), (1, 3, 'II')),
act(s, t, edit, init) AS (VALUES (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
    (0, 2, 'R', NULL), (1, 2, 'R', NULL), (2, 3, 'R', NULL), (3, 2, 'R', NULL), (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL)),
dp(conv, pos, s, cost, audit, out) AS (SELECT conv, 0::BIGINT, 0, 0::BIGINT, '', ''::VARCHAR FROM g UNION ALL
    SELECT conv, pos, s, best.cost, best.audit, best.out FROM (
      SELECT dp.conv, a.pos, act.t AS s, min({'cost': dp.cost + 2 * len(ins.k) + CASE edit WHEN 'D' THEN 3 ELSE (fault = 'truncated')::INT + 2 * (edit = 'R')::INT END,
        'audit': dp.audit || ins.k || edit,
        'out': dp.out || CASE WHEN ins.k = '' THEN '' WHEN ins.k = 'II' THEN chr(10) || 'user:' || chr(10) || 'assistant:'
                              WHEN ins.t = 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
          || CASE edit WHEN 'D' THEN '' ELSE chr(10) || CASE WHEN edit = 'K' THEN role WHEN act.t = 2 THEN 'user' ELSE 'assistant' END || ':' || a.text END}) AS best
      FROM dp JOIN a ON a.conv = dp.conv AND a.pos = dp.pos + 1 JOIN ins ON ins.s = dp.s
        JOIN act ON act.s = ins.t AND (act.init IS NULL OR act.init = a.init) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
      GROUP BY dp.conv, a.pos, act.t)),
fin AS (SELECT conv, min({'cost': cost + 2 * len(k), 'audit': audit || k, 'out': out || CASE k WHEN '' THEN '' WHEN 'II' THEN chr(10) || 'user:' || chr(10) || 'assistant:'
    ELSE CASE WHEN t = 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END END}) AS b
  FROM dp JOIN g USING (conv) JOIN ins USING (s) WHERE pos = n AND t IN (0, 3) GROUP BY conv)
SELECT CASE WHEN k.conv <> ' ' THEN k.conv::BIGINT END AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM k) k LEFT JOIN g USING (conv) LEFT JOIN fin USING (conv)
"""
