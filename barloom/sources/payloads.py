"""Landed JSON payloads to bar, tick, profile and feed rows.

Payloads are rows of a bronze table with a text body. Each decoder is a chain of
from_json, array functions and one explode; bodies that cannot be used go to a
second DataFrame with the reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import MARKET_ZONE, blank_to_null, local_date

# Source names and the field headings exchanges use.
SOURCE_MONTH = "exchange_month"
SOURCE_DAILY = "exchange_daily"
SOURCE_OTC = "otc_daily"
SOURCE_HISTORY = "vendor_history"
SOURCE_MINUTE = "vendor_minute"
SOURCE_SNAPSHOT = "exchange_snapshot"
BLANK_NUMBERS = ("", "--", "---", "----")
MONTH_FIELDS = {"date": ("日期",), "volume": ("成交股數",), "open": ("開盤價",),
                "high": ("最高價",), "low": ("最低價",), "close": ("收盤價",)}
DAILY_FIELDS = {"symbol": ("證券代號", "security code", "code"),
                "open": ("開盤價", "open"), "high": ("最高價", "high"),
                "low": ("最低價", "low"), "close": ("收盤價", "close"),
                "volume": ("成交股數", "trade volume (shares)", "trade vol. (shares)")}
OTC_FIELDS = {"symbol": ("代號", "code", "security code"), "open": ("開盤", "open"),
              "high": ("最高", "high"), "low": ("最低", "low"), "close": ("收盤", "close"),
              "volume": ("成交股數", "trade vol. (shares)", "trade volume (shares)")}
RECORD_KEYS = ("records", "data", "items", "result", "results", "response")
PROFILE_KEYS = {
    "symbol": ("CompanyCode", "SecuritiesCompanyCode", "公司代碼", "公司代號", "股票代號", "代號", "Code"),
    "company_name": ("CompanyName", "公司名稱", "股票名稱", "簡稱", "名稱", "公司簡稱", "Name"),
    "isin_code": ("ISINCode", "ISIN", "國際證券辨識號碼"),
    "industry_category": ("Industry", "IndustryCategory", "產業別", "產業類別"),
    "listing": ("ListingDate", "上市日期", "上櫃日期", "掛牌日期"),
    "status": ("TradingStatus", "交易狀態", "狀態", "Status"),
    "notes": ("MarketCategory", "市場別", "備註", "Note"),
}
ACTIVE_WORDS = ("active", "listed", "trading", "正常")
LIFECYCLE_TYPES = ("listing", "delisting", "ticker_change", "re_listing")
EVENT_TYPES = ("merger", "tender_offer", "stock_split", "reverse_split", "cash_dividend",
               "stock_dividend", "capital_reduction", "delisting", "listing_status_change",
               "ticker_change")
TIMESTAMP_CLASSES = ("official_exchange", "official_issuer", "vendor_published")
BAR = ("date", "symbol", "market", "source", "open", "high", "low", "close", "volume")
_TABLES = "stat string, tables array<struct<fields array<string>, data array<array<string>>>>"


def scan_daily_bars(bars: DataFrame, *, symbols: Sequence[str] | DataFrame | None = None,
                    start=None, end=None, source: str | None = None,
                    market: str | None = None) -> DataFrame:
    """Bars of the symbols, dates inclusive, ordered by date and symbol.

    A list becomes a pushed-down IN; a (symbol) DataFrame a semi join.
    """
    out = bars
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    if source is not None:
        out = out.where(F.col("source") == source)
    if market is not None:
        out = out.where(F.col("market") == market)
    if isinstance(symbols, DataFrame):
        out = out.join(symbols.select("symbol"), "symbol", "left_semi")
    elif symbols is not None:
        out = out.where(F.col("symbol").isin(*symbols))
    return out.orderBy("date", "symbol")


def clean_numeric(c: str | Column) -> Column:
    """Number without HTML tags and commas; dashes, blanks, bad text give 0."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), ",", ""))
    number = F.when(~text.isin(*BLANK_NUMBERS), bare.try_cast("double"))
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))


def normalize_field(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def field_position(fields: Column, aliases: Sequence[str]) -> Column:
    """1-based position of the first alias present, NULL when none is."""
    known = F.reverse(F.transform(fields, normalize_field))

    def at(alias: str) -> Column:
        back = F.array_position(known, F.lit(" ".join(alias.strip().lower().split())))
        return F.when(back > 0, F.size(fields) - back + 1)

    return F.coalesce(*[at(a) for a in aliases]).cast("int")


def _cell(row: Column, position: Column) -> Column:
    return F.try_element_at(row, position)


def attach_lineage(rows: DataFrame, *, payload_id: str = "raw_payload_id",
                   parser_version: str) -> DataFrame:
    """Adds payload id, archive reference and parser version, keeping what is set."""
    have = set(rows.columns)
    pid = F.col(payload_id) if payload_id in have else F.lit(None).cast("bigint")
    reference = F.when(pid.isNotNull() & (pid != 0), F.concat(F.lit("raw_ingest_audit:"), pid))

    def keep(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value) if name in have else value

    return (rows.withColumn("raw_payload_id", pid)
            .withColumn("archive_object_reference", keep("archive_object_reference", reference))
            .withColumn("parser_version", keep("parser_version", F.lit(parser_version))))


def _failed(payloads: DataFrame, issue: Column) -> DataFrame:
    return payloads.select(F.col("id").alias("raw_payload_id"), issue.alias("issue")).where(
        F.col("issue").isNotNull())


def parse_symbol_month_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads (id, symbol, payload_body) -> bars, failures.

    Dates count years from 1911. Numbers that do not parse become 0, which
    validation drops later.
    """
    p = payloads.withColumn("_p", F.from_json(
        "payload_body", "stat string, fields array<string>, data array<array<string>>"))
    ok = F.col("_p.stat") == "OK"
    issue = F.when(~F.coalesce(ok, F.lit(False)), "stat is not OK")
    pos = {k: field_position(F.col("_p.fields"), a) for k, a in MONTH_FIELDS.items()}
    rows = p.where(ok).select("id", "symbol", F.explode("_p.data").alias("_r"),
                              *[pos[k].alias(f"_{k}") for k in pos])

    def number(k: str) -> Column:
        v = F.regexp_replace(_cell(F.col("_r"), F.col(f"_{k}")), ",", "").try_cast("double")
        return F.coalesce(v, F.lit(0.0))

    parts = F.split(_cell(F.col("_r"), F.col("_date")), "/")
    year = F.try_element_at(parts, F.lit(1)).try_cast("int") + 1911
    text = F.concat_ws("-", year.cast("string"), F.try_element_at(parts, F.lit(2)),
                       F.try_element_at(parts, F.lit(3)))
    bars = rows.select(
        F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).alias("date"), "symbol",
        F.lit("TW").alias("market"), F.lit(SOURCE_MONTH).alias("source"),
        *[number(k).alias(k) for k in ("open", "high", "low", "close")],
        number("volume").cast("bigint").alias("volume"), F.col("id").alias("raw_payload_id"))
    return attach_lineage(bars, parser_version="month_parser_v1"), _failed(p, issue)


def _table_bars(chosen: DataFrame, fields: Mapping[str, Sequence[str]], source: str) -> DataFrame:
    rows = chosen.select("id", "trading_date", *[
        field_position(F.col("_t.fields"), a).alias(f"_{k}") for k, a in fields.items()],
        F.explode("_t.data").alias("_r")).where(F.col("_r").isNotNull())

    def cell(k: str) -> Column:
        return _cell(F.col("_r"), F.col(f"_{k}"))

    return rows.select(
        F.col("trading_date").alias("date"), F.upper(F.trim(cell("symbol"))).alias("symbol"),
        F.lit("TW").alias("market"), F.lit(source).alias("source"),
        *[clean_numeric(cell(k)).alias(k) for k in ("open", "high", "low", "close")],
        clean_numeric(cell("volume")).cast("bigint").alias("volume"),
        F.col("id").alias("raw_payload_id"))


def parse_market_daily_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads (id, trading_date, payload_body) -> bars, failures: the first
    table with a security-code field."""
    p = payloads.withColumn("_p", F.from_json("payload_body", _TABLES))

    def coded(t: Column) -> Column:
        names = F.transform(t["fields"], normalize_field)
        return F.array_contains(names, "證券代號") | F.array_contains(names, "security code")

    p = p.withColumn("_t", F.try_element_at(F.filter("_p.tables", coded), F.lit(1)))
    found = F.lit(True)
    for a in DAILY_FIELDS.values():
        found = found & field_position(F.col("_t.fields"), a).isNotNull()
    issue = (F.when(~F.coalesce(F.col("_p.stat") == "OK", F.lit(False)), "stat is not OK")
             .when(F.col("_t").isNull(), "no stock table")
             .when(~found, "missing fields"))
    p = p.withColumn("_issue", issue)
    bars = _table_bars(p.where("_issue IS NULL"), DAILY_FIELDS, SOURCE_DAILY)
    return attach_lineage(bars, parser_version="daily_parser_v1"), _failed(p, F.col("_issue"))


def parse_otc_daily_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads (id, trading_date, payload_body) -> bars, failures: the first
    table on which all six alias groups match."""
    p = payloads.withColumn("_p", F.from_json("payload_body", _TABLES))

    def complete(t: Column) -> Column:
        names = F.transform(t["fields"], normalize_field)
        every = F.lit(True)
        for aliases in OTC_FIELDS.values():
            every = every & F.arrays_overlap(names, F.array(*[F.lit(a) for a in aliases]))
        return every

    p = p.withColumn("_t", F.try_element_at(F.filter("_p.tables", complete), F.lit(1)))
    issue = (F.when(F.lower(F.coalesce("_p.stat", F.lit(""))) != "ok", "stat is not ok")
             .when(F.coalesce(F.size("_p.tables"), F.lit(0)) <= 0, "no tables")
             .when(F.col("_t").isNull(), "no stock table"))
    p = p.withColumn("_issue", issue)
    bars = _table_bars(p.where("_issue IS NULL"), OTC_FIELDS, SOURCE_OTC)
    return attach_lineage(bars, parser_version="otc_parser_v1"), _failed(p, F.col("_issue"))


_RECORD = ("data array<struct<Date string, Datetime string, Open string, High string, "
           "Low string, Close string, Volume string>>")


def parse_table_history_payload(payloads: DataFrame) -> DataFrame:
    """payloads (id, symbol, market, payload_body) of record JSON -> daily bars."""
    rows = payloads.select("id", "symbol", "market", F.explode(
        F.from_json("payload_body", _RECORD)["data"]).alias("r"))
    day = F.substring(F.coalesce("r.Date", "r.Datetime"), 1, 10)
    bars = rows.select(
        F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).alias("date"), "symbol", "market",
        F.lit(SOURCE_HISTORY).alias("source"),
        *[F.col(f"r.{k.title()}").try_cast("double").alias(k)
          for k in ("open", "high", "low", "close")],
        F.coalesce(F.col("r.Volume").try_cast("double"), F.lit(0.0)).cast("bigint").alias("volume"),
        F.col("id").alias("raw_payload_id"))
    return attach_lineage(bars, parser_version="history_parser_v1")


def parse_minute_payload(payloads: DataFrame) -> DataFrame:
    """payloads (id, symbol, market, payload_body) -> minute bars.

    A time without an offset is market-local; ``trading_date`` is the local date
    and ``bar_ts`` the instant.
    """
    rows = payloads.select("id", "symbol", "market", F.explode(
        F.from_json("payload_body", _RECORD)["data"]).alias("r"))
    text = F.coalesce("r.Datetime", "r.Date")
    parsed = F.try_to_timestamp(text)
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    ts = F.when(aware, parsed).otherwise(F.to_utc_timestamp(parsed, MARKET_ZONE))
    bars = rows.withColumn("bar_ts", ts).select(
        local_date("bar_ts").alias("trading_date"), "bar_ts", "symbol", "market",
        F.lit(SOURCE_MINUTE).alias("source"),
        *[F.col(f"r.{k.title()}").try_cast("double").alias(k)
          for k in ("open", "high", "low", "close")],
        F.coalesce(F.col("r.Volume").try_cast("double"), F.lit(0.0)).cast("bigint").alias("volume"),
        F.col("id").alias("raw_payload_id"))
    return attach_lineage(bars, parser_version="minute_parser_v1")


_QUOTE = ("msgArray array<struct<c string, d string, `^` string, t string, `%` string, "
          "tlong string, z string, tv string, v string, b string, g string, a string, f string>>")


def _price(c: Column) -> Column:
    return F.when(~c.isin("", "-", "--"), c.try_cast("double"))


def _count(c: Column) -> Column:
    return _price(c).cast("bigint")


def _ladder(c: Column, kind) -> Column:
    items = F.filter(F.split(F.coalesce(c, F.lit("")), "_"), lambda x: x != "")
    return F.array_compact(F.transform(items, kind))


def snapshot_observations(body: str | Column, fetched: str | Column) -> Column:
    """Array of observation structs of one snapshot body; bad rows are skipped."""
    b = F.col(body) if isinstance(body, str) else body
    f = F.col(fetched) if isinstance(fetched, str) else fetched
    quotes = F.from_json(b, _QUOTE)["msgArray"]

    def observation(q: Column) -> Column:
        day = F.trim(F.coalesce(blank_to_null(q["d"]), q["^"]))
        clock = F.coalesce(blank_to_null(q["t"]), q["%"])
        millis = _count(q["tlong"])
        local = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyyMMdd HH:mm:ss"))
        at = (F.when(millis > 0, F.timestamp_millis(millis))
              .when((F.length(day) == 8) & (F.length(clock) > 0),
                    F.to_utc_timestamp(local, MARKET_ZONE)).otherwise(f))
        return F.struct(
            F.to_date(F.try_to_timestamp(day, F.lit("yyyyMMdd"))).alias("trading_date"),
            at.alias("observation_ts"), F.trim(q["c"]).alias("symbol"),
            F.lit("TW").alias("market"), _price(q["z"]).alias("last_price"),
            _count(q["tv"]).alias("last_size"), _count(q["v"]).alias("cumulative_volume"),
            _ladder(q["b"], _price).alias("best_bid_prices"),
            _ladder(q["g"], _count).alias("best_bid_sizes"),
            _ladder(q["a"], _price).alias("best_ask_prices"),
            _ladder(q["f"], _count).alias("best_ask_sizes"))

    return F.filter(F.transform(F.coalesce(quotes, F.array()), observation), lambda o:
                    (F.coalesce(o["symbol"], F.lit("")) != "") & o["trading_date"].isNotNull())


def parse_tick_snapshot(entries: DataFrame) -> DataFrame:
    """entries (..., fetch_ts, payload_body) -> one row per observation."""
    kept = [c for c in entries.columns if c not in ("payload_body", "fetch_ts")]
    return entries.select(*kept, F.inline(snapshot_observations("payload_body", "fetch_ts")))


def payload_records(payloads: DataFrame) -> DataFrame:
    """payloads (id, payload_body) -> (id, ordinal, record); a failure is one row without record.

    Both come from one pass, and nothing filters below the walk, which would repeat it. The record list sits under one of the wrapper keys, at most four levels
    down; keys are tried in order and the first path to a list with at least one
    object wins. A body is parsed once, to a VARIANT; the levels below are lookups in
    it. A node carries its path as digits, so the least path is the first one found
    depth first. A null body, one that is no JSON and one with a key twice in an object
    are failures. Records are JSON text with keys in order and numbers by value.
    """
    def node(path: Column, body: Column) -> Column:
        return F.struct(path.alias("path"), body.alias("body"))

    def children(n: Column) -> Column:
        return F.filter(F.array(*[
            node(F.concat(n["path"], F.lit(str(i))), F.try_variant_get(n["body"], f"$.{k}", "variant"))
            for i, k in enumerate(RECORD_KEYS)]), lambda c: c["body"].isNotNull())

    def elements(body: Column) -> Column:
        return F.try_variant_get(body, "$", "array<variant>")

    def is_object(text: Column) -> Column:
        return text.startswith("{")

    p = payloads.select("id", F.try_parse_json("payload_body").alias("_body"))
    p = p.withColumn("_level", F.array(node(F.lit(""), F.col("_body"))))
    p = p.withColumn("_all", F.col("_level"))
    for _ in range(4):
        p = p.withColumn("_level", F.flatten(F.transform("_level", children)))
        p = p.withColumn("_all", F.concat("_all", "_level"))
    hits = F.filter("_all", lambda n: F.exists(elements(n["body"]), lambda e: is_object(F.to_json(e))))
    p = p.select("id", "_all", F.array_min(F.transform(hits, lambda n: n["path"])).alias("_path"))
    found = F.filter("_all", lambda n: n["path"] == F.col("_path"))
    return p.select("id", F.posexplode_outer(F.filter(
        F.transform(elements(F.get(found, F.lit(0))["body"]), lambda e: F.to_json(e)), is_object))
        .alias("ordinal", "record"))


def explode_payload_records(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``payload_records`` as (id, ordinal, record) and failures (raw_payload_id, issue)."""
    rows = payload_records(payloads)
    return rows.where("record IS NOT NULL"), rows.where("record IS NULL").select(
        F.col("id").alias("raw_payload_id"), F.lit("no record list").alias("issue"))


def listing_date(text: Column) -> Column:
    dashed = F.regexp_replace(F.trim(text), "/", "-")
    dashed = F.when(dashed.rlike(r"^\d{8}$"), F.concat_ws(
        "-", F.substring(dashed, 1, 4), F.substring(dashed, 5, 2), F.substring(dashed, 7, 2))
    ).otherwise(dashed)
    return F.to_date(F.try_to_timestamp(dashed, F.lit("yyyy-MM-dd")))


def parse_company_profile(records: DataFrame, *, exchange: str | Column, board: str,
                          source: str) -> tuple[DataFrame, DataFrame]:
    """records (id, ordinal, record) -> profiles, failures."""
    names = [k for keys in PROFILE_KEYS.values() for k in keys]
    item = F.from_json("record", ", ".join(f"`{n}` string" for n in dict.fromkeys(names)))
    r = records.withColumn("_i", item)

    def first(field: str) -> Column:
        return F.coalesce(*[blank_to_null(F.col("_i")[k]) for k in PROFILE_KEYS[field]])

    status = F.lower(F.coalesce(first("status"), F.lit("active")))
    r = r.select(
        *[c for c in records.columns if c != "record"],
        first("symbol").alias("symbol"), F.lit("TW").alias("market"),
        (exchange if isinstance(exchange, Column) else F.lit(exchange)).alias("exchange"),
        F.lit(board).alias("board"), first("company_name").alias("company_name"),
        first("isin_code").alias("isin_code"),
        first("industry_category").alias("industry_category"),
        listing_date(first("listing")).alias("listing_date"),
        F.when(status.isin(*ACTIVE_WORDS), "active").otherwise(status).alias("trading_status"),
        F.lit(source).alias("source_name"), first("notes").alias("notes"))
    good = F.col("symbol").isNotNull() & F.col("company_name").isNotNull()
    bad = r.where(~good).select(F.col("id").alias("raw_payload_id"), "ordinal",
                                F.lit("missing symbol or company_name").alias("issue"))
    return r.where(good).withColumnRenamed("id", "raw_payload_id"), bad


def _iso_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def parse_lifecycle_feed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records (id, ordinal, record) -> lifecycle rows, failures."""
    r = records.withColumn("_i", F.from_json(
        "record", "symbol string, market string, event_type string, effective_date string, "
                  "reference_symbol string, notes string"))
    day = _iso_date(F.col("_i.effective_date"))
    issue = (F.when(F.col("_i.symbol").isNull(), "missing symbol")
             .when(~F.coalesce(F.col("_i.event_type").isin(*LIFECYCLE_TYPES), F.lit(False)),
                   "bad event_type")
             .when(day.isNull(), "bad effective_date"))
    r = r.withColumn("_issue", issue)
    good = r.where("_issue IS NULL").select(
        F.col("id").alias("raw_payload_id"), "ordinal", F.upper("_i.symbol").alias("symbol"),
        F.upper(F.coalesce("_i.market", F.lit("TW"))).alias("market"), "_i.event_type",
        day.alias("effective_date"), "_i.reference_symbol", "_i.notes")
    return good, r.where("_issue IS NOT NULL").select(
        F.col("id").alias("raw_payload_id"), "ordinal", F.col("_issue").alias("issue"))


def parse_event_feed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records (id, ordinal, record) -> corporate events, failures."""
    r = records.withColumn("_i", F.from_json(
        "record", "symbol string, market string, event_type string, effective_date string, "
                  "event_publication_ts string, timestamp_source_class string, notes string"))
    day = _iso_date(F.col("_i.effective_date"))
    ts = F.try_to_timestamp(F.col("_i.event_publication_ts"))
    issue = (F.when(F.col("_i.symbol").isNull(), "missing symbol")
             .when(~F.coalesce(F.col("_i.event_type").isin(*EVENT_TYPES), F.lit(False)),
                   "bad event_type")
             .when(F.col("_i.effective_date").isNotNull() & day.isNull(), "bad effective_date")
             .when(ts.isNull(), "bad event_publication_ts")
             .when(~F.coalesce(F.col("_i.timestamp_source_class").isin(*TIMESTAMP_CLASSES),
                               F.lit(False)), "bad timestamp_source_class"))
    r = r.withColumn("_issue", issue)
    good = r.where("_issue IS NULL").select(
        F.col("id").alias("raw_payload_id"), "ordinal", F.upper("_i.symbol").alias("symbol"),
        F.upper(F.coalesce("_i.market", F.lit("TW"))).alias("market"), "_i.event_type",
        day.alias("effective_date"), ts.alias("publication_ts"), "_i.timestamp_source_class",
        "_i.notes")
    return good, r.where("_issue IS NOT NULL").select(
        F.col("id").alias("raw_payload_id"), "ordinal", F.col("_issue").alias("issue"))


def latest_replayable_payload(payloads: DataFrame) -> DataFrame:
    """(market, symbol, id, fetch_ts): newest success with a body per scope.

    Chosen from metadata; bodies can be joined back by id.
    """
    usable = (F.col("fetch_status") == "success") & (F.length("payload_body") > 0)
    return (payloads.where(usable).groupBy("market", "symbol")
            .agg(F.max(F.struct("fetch_ts", "id")).alias("m"))
            .select("market", "symbol", "m.id", "m.fetch_ts"))


def replay_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads (id, source_name, symbol, market, payload_body) -> bars, failures.

    Each source goes to its decoder; an empty body or unknown source fails with
    a reason. Bars still have to be validated and merged.
    """
    empty = F.coalesce(F.length("payload_body"), F.lit(0)) == 0
    month = payloads.where(~empty & (F.col("source_name") == SOURCE_MONTH))
    history = payloads.where(~empty & (F.col("source_name") == SOURCE_HISTORY))
    month_bars, month_failed = parse_symbol_month_payload(month)
    bars = month_bars.unionByName(parse_table_history_payload(history).select(month_bars.columns))
    known = F.coalesce(F.col("source_name").isin(SOURCE_MONTH, SOURCE_HISTORY), F.lit(False))
    refused = _failed(payloads, F.when(empty, "empty body").when(~known, "unsupported source"))
    return bars, month_failed.unionByName(refused)
