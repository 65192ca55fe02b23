"""Dense (symbol, market date) panels without a cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def panel(symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol columns, date, idx): every symbol on every date of its market.

    ``symbols`` has market; ``calendar`` is (market, date, idx). The calendar of
    a market becomes one array (thousands of dates), met by an equi join on
    market and unfolded per symbol. The output is dense by definition: the
    panel operators judge each symbol on each market date.
    """
    packed = calendar.groupBy("market").agg(
        F.sort_array(F.collect_list(F.struct("idx", "date"))).alias("_days"))
    return (symbols.join(packed, "market")
            .select(*symbols.columns, F.explode("_days").alias("_d"))
            .select(*symbols.columns, F.col("_d.date").alias("date"),
                    F.col("_d.idx").alias("idx")))
