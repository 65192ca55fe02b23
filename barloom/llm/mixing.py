"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Words are dealt in blocks of one size. Each source's target buys seats: blocks go one by
one to the source of the highest quotient target / (2 * seats + 1). A source's seats are
dealt to its shards (documents by hash, about SHARD_ROWS each) in the same way by shard
size. A shard takes whole passes over its words and, for the rest of its quota, the
first blocks of its words in a seeded order of its documents.

Seats are found without dealing one by one: rounding targets over the average block
price is off by at most n / 2 seats for n parties, and no party's seats are further from
that than 1.5 n times its share + 1, so only these quotients are ranked (about 9 n).
Only (id, source, size) and one row per source or shard are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 64
BLOCKS_A_SOURCE = 2000
SHARD_ROWS = 4096
SEED = "mix-1"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text."""
    words = F.regexp_count(bf.whole_text(), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def source_targets(rows: DataFrame) -> DataFrame:
    """One row per source: source, n_docs, source_size, weight, target, all_words, sources.

    Weights repeat over sources by code point, null last. Targets share all words by
    weight; where that exceeds MOST times the source, it stays there and the rest is
    shared anew. In the order of (limit / weight) limited sources come first, so the
    price of a weight follows from running sums.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array([F.lit(w) for w in WEIGHTS])
    s = (rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
         .withColumn("place", F.row_number().over(named))
         .withColumn("weight", F.get(weights, (F.col("place") - 1) % len(WEIGHTS)).cast("double"))
         .withColumn("cap", (F.lit(MOST) * F.col("source_size")).cast("double")))
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy(F.lit(0))
    s = (s.withColumn("all_words", F.sum("source_size").over(everything)).withColumn("sources", F.count("*").over(everything))
         .withColumn("before", F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("price", (F.col("all_words") - F.col("before")) / F.col("left"))
         .withColumn("price", F.min(F.when(F.col("cap") >= F.col("price") * F.col("weight"), F.struct(F.col("place") * 0 + F.rank().over(tight), "price")))
                     .over(everything)["price"]))
    return s.select("source", "place", "n_docs", "source_size", "weight", "all_words", "sources",
                    F.least("cap", F.coalesce("price", F.lit(0.0)) * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: str, votes: Column, seats: Column) -> DataFrame:
    """``parties`` with ``quota``: seats of each by highest quotients within its group.

    Ties go to the smaller ``party``. Votes of zero get none.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = (parties.withColumn("_v", votes.cast("double")).withColumn("_k", seats.cast("long"))
         .withColumn("_n", F.count("*").over(w)).withColumn("_sum", F.sum("_v").over(w))
         .withColumn("_first", F.when(F.col("_sum") > 0, F.floor(F.col("_v") * F.col("_k") / F.col("_sum") + 0.5)).otherwise(0))
         .withColumn("_reach", F.when(F.col("_sum") > 0, F.ceil(1.5 * F.col("_n") * F.col("_v") / F.col("_sum")) + 2).otherwise(0))
         .withColumn("_base", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.col("_first") - F.col("_reach"))).otherwise(0))
         .withColumn("_open", F.col("_k") - F.sum("_base").over(w)))
    ranked = (p.where("_v > 0").select(*group, party, "_v", "_open",
                                       F.explode(F.sequence(F.col("_base"), F.col("_first") + F.col("_reach"))).alias("_seat"))
              .withColumn("_rank", F.row_number().over(w.orderBy((F.col("_v") / (2 * F.col("_seat") + 1)).desc(), party))))
    won = (ranked.where("_rank <= _open").groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(party).alias("_p")).agg(F.count("*").alias("_won")))
    on = F.col(party).eqNullSafe(F.col("_p"))
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return p.join(won, on, "left").select(*parties.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _code() -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (words the mix takes).

    ``docs`` needs doc_id, text and source; other columns are ignored. Null, empty and
    blank texts have no words and are taken 0 of. A null source is a source, last in
    order. Every row is a document of its own: repeated rows share the place of their
    doc_id in the seeded order, rows without doc_id that of an empty one. Nothing is
    random, so reruns agree. An empty table gives no rows; without words targets are 0.
    """
    rows = stored(sized(docs), "sizes")
    sources = source_targets(rows)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("all_words") / (F.col("sources") * BLOCKS_A_SOURCE)))).cast("long")
    sources = sources.withColumn("block", block).withColumn("shards", F.ceil(F.col("n_docs") / F.lit(SHARD_ROWS)).cast("long"))
    sources = stored(apportion(sources, [], "place", F.col("target"), F.round(F.col("all_words") / F.col("block"))), "sources")

    facts = sources.select(F.col("source").alias("_source"), "place", "source_size", "target", "block", "shards", F.col("quota").alias("source_quota"))
    placed = (rows.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("code", _code())
              .withColumn("shard", F.conv(F.substring("code", 1, 8), 16, 10).cast("long") % F.col("shards")))
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    shards = apportion(shards, ["place"], "shard", F.col("shard_size"), F.col("source_quota"))
    quotas = shards.select("place", "shard", F.least(F.col("quota") * F.col("block"), F.col("shard_size") * MOST).alias("words"), "shard_size")

    order = Window.partitionBy("place", "shard").orderBy("code", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (placed.join(quotas, ["place", "shard"])
             .withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0))
             .withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size") - F.coalesce(F.sum("size").over(order), F.lit(0))))
    return dealt.select("doc_id", "size", "source_size", "target",
                        (F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least("rest", "size"))).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
s0 AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, (1 + (place - 1) % 3)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap,
              (sum(source_size) OVER ())::BIGINT AS all_words, count(*) OVER () AS sources FROM s1),
s3 AS (SELECT *, (all_words - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price,
              row_number() OVER (ORDER BY cap / weight, place) AS tight FROM s2),
s4 AS (SELECT *, least(cap, coalesce((SELECT arg_min(price, tight) FROM s3 WHERE cap >= price * weight), 0.0) * weight) AS target FROM s3),
s5 AS (SELECT *, greatest(1, least(64, floor(all_words / (sources * 2000.0))))::BIGINT AS block,
              ceil(n_docs / 4096.0)::BIGINT AS shards FROM s4),
s6 AS (SELECT *, round(all_words::DOUBLE / block)::BIGINT AS k, sum(target) OVER () AS votes FROM s5),
q AS (SELECT place, k, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, place) AS r
      FROM s6, unnest(range(0, (ceil(target * k / votes) + sources + 3)::BIGINT)) AS u(seat) WHERE target > 0),
s7 AS (SELECT s6.*, (SELECT count(*) FROM q WHERE q.place = s6.place AND r <= q.k) AS source_quota FROM s6),
d AS (SELECT z.*, s7.place, source_size, target, block, source_quota, (('0x' || substr(code, 1, 8))::BIGINT) % shards AS shard
      FROM sized z JOIN s7 ON z.source IS NOT DISTINCT FROM s7.source),
h AS (SELECT place, shard, sum(size)::BIGINT AS shard_size, min(source_quota) AS source_quota, min(block) AS block,
             count(*) OVER (PARTITION BY place) AS n FROM d GROUP BY place, shard),
h2 AS (SELECT *, sum(shard_size) OVER (PARTITION BY place) AS votes FROM h),
hq AS (SELECT place, shard, source_quota, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * seat + 1) DESC, shard) AS r
       FROM h2, unnest(range(0, (ceil(shard_size * source_quota / votes) + n + 3)::BIGINT)) AS u(seat) WHERE shard_size > 0),
h3 AS (SELECT h.place, h.shard, h.shard_size,
              least(block * (SELECT count(*) FROM hq WHERE hq.place = h.place AND hq.shard = h.shard AND r <= hq.source_quota), 3 * shard_size) AS words FROM h),
e AS (SELECT d.*, shard_size, words, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes,
             coalesce(sum(size) OVER (PARTITION BY d.place, d.shard ORDER BY code, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN h3 ON d.place = h3.place AND d.shard = h3.shard)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(words - passes * shard_size - before, size)))::BIGINT AS taken FROM e
"""
