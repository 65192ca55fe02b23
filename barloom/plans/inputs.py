"""Derived inputs shared by the registered queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.features import Feature, feature_set
from barloom.operators.portfolio import topn_weights
from barloom.sources.tables import daily_bars, table, universe

LINE_ORDER_SQL = ("((l_orderkey * 8 + l_linenumber) * 4096 "
                  "+ CAST(floor(l_extendedprice * 100e0 + 0.5e0) AS BIGINT) % 4096)")


def _bars_sql(symbol: str) -> str:
    return f"""SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date,
      first(px ORDER BY {LINE_ORDER_SQL}) AS open, max(px) AS high, min(px) AS low,
      last(px ORDER BY {LINE_ORDER_SQL}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume,
      CASE WHEN first(l_linestatus ORDER BY {LINE_ORDER_SQL}) = 'F' THEN 'exchange_daily'
           ELSE 'vendor_history' END AS source
    FROM (SELECT *, 100e0 + l_extendedprice / 9973e0 AS px
          FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2"""


EQUITY_SQL = """SELECT run_id, date, CASE WHEN max(CASE WHEN ret <= -1 THEN 1 ELSE 0 END) OVER w = 1 THEN 0e0
      ELSE exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER w) END AS equity
    FROM {} WINDOW w AS (PARTITION BY run_id ORDER BY date)"""

FRAGMENTS = {
    "bars": _bars_sql("p_brand"),
    "tbars": _bars_sql("p_type"),
    "uni": "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS position "
           "FROM (SELECT DISTINCT symbol FROM bars)",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx "
           "FROM (SELECT DISTINCT date FROM bars)",
    "zs": """SELECT *, CASE WHEN count(close) OVER w = 20
        THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z0
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "scored": """SELECT s.*, u.position, -z AS score, 1e0 / (1e0 + exp(z)) AS p
      FROM (SELECT *, lag(z0) OVER (PARTITION BY symbol ORDER BY date) AS z FROM zs) s
      JOIN uni u USING (symbol)""",
    "req": """SELECT 'run-' || r_regionkey AS run_id, symbol,
        0.25e0 + 0.25e0 * r_regionkey AS threshold, 3 + r_regionkey AS top_n
      FROM uni JOIN region ON (position + r_regionkey) % 5 <> 0""",
    "rscored": "SELECT run_id, threshold, top_n, s.* FROM scored s JOIN req USING (symbol)",
    "w": """SELECT run_id, date, symbol,
        CASE WHEN ok AND rk <= top_n THEN 1e0 / sum(CASE WHEN ok AND rk <= top_n THEN 1 ELSE 0 END)
          OVER (PARTITION BY run_id, date) ELSE 0e0 END AS weight
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id, date
              ORDER BY ok DESC, score DESC NULLS LAST, position) AS rk
            FROM (SELECT *, coalesce(score >= threshold AND p BETWEEN 0.5 AND 1, false) AS ok
                  FROM rscored))""",
    # The full date x symbol panel per run, zero where a row is absent.
    "grid": """SELECT run_id, date, idx, symbol, coalesce(weight, 0e0) AS weight
      FROM (SELECT DISTINCT run_id, symbol FROM w)
      JOIN (SELECT run_id, date, row_number() OVER (PARTITION BY run_id ORDER BY date) - 1 AS idx
            FROM (SELECT DISTINCT run_id, date FROM w)) USING (run_id)
      LEFT JOIN w USING (run_id, date, symbol)""",
    "px": """SELECT run_id, date, idx, symbol, weight,
        coalesce(lag(weight) OVER s, 0e0) AS held, b.open IS NOT NULL AS has_bar,
        last_value(b.open IGNORE NULLS) OVER s AS open, last_value(b.high IGNORE NULLS) OVER s AS high,
        last_value(b.low IGNORE NULLS) OVER s AS low, last_value(b.close IGNORE NULLS) OVER s AS close
      FROM grid LEFT JOIN bars b USING (symbol, date)
      WINDOW s AS (PARTITION BY run_id, symbol ORDER BY date)""",
    "pret": """SELECT run_id, date, sum(g) AS gross, sum(d) * 0.003e0 AS cost,
        sum(g) - sum(d) * 0.003e0 AS ret
      FROM (SELECT run_id, date, abs(weight - held) AS d,
              coalesce(held * (open / lag(open) OVER (PARTITION BY run_id, symbol ORDER BY date) - 1), 0) AS g
            FROM px) GROUP BY 1, 2""",
    "eq": EQUITY_SQL.format("pret"),
}


def sql(names: str, body: str, **extra: str) -> str:
    """WITH clause of the named fragments, then the extra ones, then body."""
    parts = [f"{n} AS ({FRAGMENTS[n]})" for n in names.split()]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


SCORES = "bars uni zs scored"
RUN_SCORES = SCORES + " req rscored"
WEIGHTS = RUN_SCORES + " w"


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir, "p_brand")


def type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir, "p_type")


def universe_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe of the brand bars, read from the part table alone."""
    return universe(table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")))


def scored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with score = -zscore(20) of the previous row and its probability."""
    z = Feature("zscore", 20, shift=1)
    frame = feature_set(brand_bars(spark, sf_dir), [z],
                        keep=("open", "high", "low", "close", "volume", "source"))
    return (frame.withColumn("score", -F.col(z.column))
            .withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col(z.column))))
            .drop(z.column).join(universe_of(spark, sf_dir), "symbol"))


def _run_slots(spark: SparkSession, sf_dir: str, names: DataFrame, parts: int) -> DataFrame:
    """(symbol, position, r): each region's run r takes names whose position + r is no
    multiple of ``parts``; the rest of the position is the join key."""
    runs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda rest: (rest + F.col("r_regionkey")) % parts != 0)).alias("_rest"))
    return names.withColumn("_rest", F.col("position") % parts).join(runs, "_rest").drop("_rest")


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, symbol, threshold, top_n): a run per region, four fifths of the universe."""
    return _run_slots(spark, sf_dir, universe_of(spark, sf_dir), 5).select(
        F.concat(F.lit("run-"), "r").alias("run_id"), "symbol",
        (F.lit(0.25) + F.lit(0.25) * F.col("r")).alias("threshold"),
        (F.lit(3) + F.col("r")).alias("top_n"))


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_bars(spark, sf_dir).join(run_requests(spark, sf_dir), "symbol")


def run_weights(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return topn_weights(run_scores(spark, sf_dir), threshold=F.col("threshold"),
                        top_n=F.col("top_n"), probabilities="p", keep=keep)


TYPE_REQ = {
    "tuni": "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS position "
            "FROM (SELECT DISTINCT p_type AS symbol FROM part)",
    "treq": """SELECT 'run-' || r_regionkey AS run_id, symbol, position FROM tuni JOIN region
      ON (position + r_regionkey) % 3 <> 0"""}


def type_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe(table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol")))


def type_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, symbol, position): a run per region over two thirds of the part types."""
    return _run_slots(spark, sf_dir, type_universe(spark, sf_dir), 3).select(
        F.concat(F.lit("run-"), "r").alias("run_id"), "symbol", "position")
