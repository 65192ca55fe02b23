"""Parquet tables and the inputs derived from them.

The shapes here (bars, lifecycle rows, corporate events, profiles, runs) are
what the operators take. They are derived from the star-schema tables with
map-side combined aggregates, so a hot symbol or date is reduced before it is
shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# The sources that count as official.
OFFICIAL_SOURCES = ("exchange_month", "exchange_daily", "otc_daily")


@functools.lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; its schema is inferred from the files once per session."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def line_price() -> Column:
    return F.lit(100.0) + F.col("l_extendedprice") / F.lit(9973.0)


LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def line_order() -> Column:
    """Arrival order of a line as one long: order, line number, then cents.

    A fixed-width key keeps first and last price in hash aggregation; a struct
    would make Spark sort every line before combining.
    """
    cents = F.floor(F.col("l_extendedprice") * 100.0 + 0.5)
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + cents % 4096


def one_market(c: str) -> Column:
    """The market of a row, TW throughout the derived inputs.

    Written over a column because a market is data: a constant would let the
    optimizer turn every join on market into a cross join.
    """
    return F.when(F.length(F.col(c).cast("string")) > 0, "TW").otherwise("US")


def line_ticks(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """Order lines as trades: (symbol, date, px, qty, official, ord)."""
    lines = table(spark, sf_dir, "lineitem").select(
        *LINE_COLUMNS, "l_partkey", "l_linestatus", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", symbol)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col(symbol).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        line_price().alias("px"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_linestatus") == "F").alias("official"),
        F.col("l_orderkey"), line_order().alias("ord"))


def daily_bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """(symbol, date, open, high, low, close, volume, source), one row per key."""
    ticks = line_ticks(spark, sf_dir, symbol)
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        F.sum("qty").cast("bigint").alias("volume"),
        F.when(F.min_by("official", "ord"), F.lit("exchange_daily"))
        .otherwise(F.lit("vendor_history")).alias("source"))


def universe(bars: DataFrame) -> DataFrame:
    """(symbol, position): the order that breaks score ties."""
    names = bars.select("symbol").distinct()
    ordered = names.groupBy().agg(F.sort_array(F.collect_set("symbol")).alias("s"))
    return ordered.select(F.posexplode("s").alias("position", "symbol")).select(
        "symbol", F.col("position").cast("bigint").alias("position"))


def lifecycle_events(spark: SparkSession, sf_dir: str, names: DataFrame, slots: int) -> DataFrame:
    """(id, symbol, market, event_type, effective_date, reference_symbol), one per order.

    ``names`` is (symbol, position); an order belongs to position custkey % slots.
    """
    o = table(spark, sf_dir, "orders")
    kind = (F.when(F.col("o_orderstatus") == "O", "listing")
            .when(F.col("o_orderstatus") == "F", "delisting")
            .otherwise("ticker_change"))
    o = o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % slots).alias("position"),
        kind.alias("event_type"), F.to_date("o_orderdate").alias("effective_date"),
        F.when((kind == "ticker_change") & (F.col("o_orderkey") % 5 != 0),
               (F.col("o_custkey") + 1) % slots).alias("_next"))
    successor = names.select(F.col("symbol").alias("reference_symbol"),
                             F.col("position").alias("_next"))
    return o.join(names, "position").join(successor, "_next", "left").select(
        "id", "symbol", F.lit("TW").alias("market"), "event_type", "effective_date",
        "reference_symbol")


def corporate_events(spark: SparkSession, sf_dir: str, names: DataFrame, slots: int) -> DataFrame:
    """(id, symbol, market, event_type, publication_ts, effective_date), one per order.

    An urgent order is a merger from 1998 on and a dividend before: a merger blocks
    its symbol for good.
    """
    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    late = F.to_date("o_orderdate") >= F.lit("1998-01-01").cast("date")
    kind = (F.when(p == "1", F.when(late, "merger").otherwise("cash_dividend"))
            .when(p == "2", "delisting")
            .when(p == "3", "cash_dividend").when(p == "4", "ticker_change")
            .otherwise("listing_status_change"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % slots).alias("position"),
        kind.alias("event_type"), F.to_timestamp("o_orderdate").alias("publication_ts"),
        F.when(F.col("o_orderkey") % 2 == 1, F.date_add(F.to_date("o_orderdate"), 2))
        .alias("effective_date")).join(names, "position").select(
        "id", "symbol", F.lit("TW").alias("market"), "event_type", "publication_ts",
        "effective_date")


def company_profiles(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    """(symbol, market, exchange, trading_status, listing_date) per universe name.

    A name takes the supplier whose key is its position.
    """
    s = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(names, F.col("s_suppkey") == F.col("position")).select(
        "symbol", F.lit("TW").alias("market"),
        F.when(F.col("n_regionkey") % 2 == 0, "TWSE").otherwise("TPEX").alias("exchange"),
        F.when(F.col("s_acctbal") > 0, "active").otherwise("inactive").alias("trading_status"),
        F.when(F.col("s_suppkey") % 4 != 0,
               F.date_add(F.lit("1995-01-01").cast("date"),
                          (F.col("s_suppkey") * 60).cast("int"))).alias("listing_date"))
