"""Queries: run-registry analytics. Runs are customers, metrics their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.operators import registry as rg
from barloom.plans.catalog import query
from barloom.plans.inputs import sql
from barloom.plans.tradability import _CELLS, _COV, daily_universe, ident_sql
from barloom.sources.tables import table


def _names(*pairs):
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


@query("artifact_completeness", """SELECT k AS run_id, state AS artifact_completeness, array_to_string(missing, ',') AS missing_artifacts,
    array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'ARTIFACTS_NOT_EVALUATED' END,
      CASE state WHEN 'metadata_only' THEN 'METADATA_ONLY_RECORD' WHEN 'partial' THEN 'REVIEW_ARTIFACTS_MISSING' END,
      CASE k % 5 WHEN 0 THEN 'COMPARISON_ELIGIBILITY_UNAVAILABLE' WHEN 1 THEN 'COMPARISON_METADATA_ONLY' WHEN 2 THEN 'SAMPLE_WINDOW_PENDING'
        WHEN 3 THEN 'UNRESOLVED_EVENT_QUARANTINE' END], lambda x: x IS NOT NULL), ',') AS caveat_codes
  FROM (SELECT k, missing, CASE WHEN len(missing) = 0 THEN 'complete' WHEN len(missing) < len(req) THEN 'partial' ELSE 'metadata_only' END AS state
    FROM (SELECT k, req, list_filter(req, lambda a: NOT list_contains(pres, a)) AS missing FROM (SELECT c_custkey AS k,
      list_filter(['metrics', 'model_diagnostics', 'equity_curve', 'signals', CASE WHEN c_custkey % 3 <> 1 THEN 'validation' END,
        CASE WHEN c_custkey % 4 <> 1 THEN 'baselines' END], lambda x: x IS NOT NULL) AS req,
      list_filter([CASE WHEN k1 <> 0 THEN 'metrics' END, CASE WHEN k1 > 1 THEN 'model_diagnostics' END, CASE WHEN k1 > 1 THEN 'equity_curve' END,
        CASE WHEN k1 <> 0 THEN 'signals' END, CASE WHEN k1 > 2 THEN 'validation' END, CASE WHEN k1 > 2 THEN 'baselines' END], lambda x: x IS NOT NULL) AS pres
      FROM (SELECT c_custkey, c_nationkey % 4 AS k1 FROM customer))))""")
def _(spark, d):
    c = table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    runs = c.select(
        k.alias("run_id"), F.when(k % 7 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(k % 3 == 0, None).otherwise(k % 3 == 2).alias("wants_validation"),
        F.when(k % 4 == 0, None).otherwise(k % 4 != 1).alias("wants_baselines"),
        _names(("metrics", n != 0), ("model_diagnostics", n > 1), ("equity_curve", n > 1),
               ("signals", n != 0), ("validation", n > 2), ("baselines", n > 2)).alias("present"),
        F.when(k % 5 == 1, "comparison_metadata_only").when(k % 5 == 2, "sample_window_pending")
        .when(k % 5 == 3, "unresolved_event_quarantine").when(k % 5 == 4, "strategy_pair_comparable")
        .alias("comparison_eligibility"))
    return present(rg.artifact_completeness(runs).select(
        "run_id", "artifact_completeness", "missing_artifacts", "caveat_codes"))


@query("comparison_eligibility", """SELECT c_custkey AS run_id, CASE WHEN c_custkey % 5 = 0 THEN 'unresolved_event_quarantine'
    WHEN c_custkey % 3 = 0 OR c_nationkey % 4 = 0 THEN 'comparison_metadata_only' WHEN c_custkey % 7 = 0 THEN 'sample_window_pending'
    ELSE 'strategy_pair_comparable' END AS eligibility FROM customer""")
def _(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    runs = table(spark, d, "customer").select(
        k.alias("run_id"), F.when(k % 5 == 0, "unresolved_corporate_event").otherwise("clear")
        .alias("corporate_event_state"), F.when(k % 3 != 0, "p").alias("price_basis_version"),
        F.lit("t").alias("threshold_policy_version"), F.when(n % 4 != 0, "c").alias("execution_cost_model_version"),
        (k % 7 == 0).alias("sample_window_pending"))
    return runs.select("run_id", rg.comparison_eligibility().alias("eligibility"))


def compared_runs(spark, d):
    """Suppliers as runs, grouped by key: later groups differ in more fields."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    g = (k / 4).cast("bigint")
    odd = k % 4 == 1

    def varies(m, a, b):
        return F.when(odd & (g % m == 0), b).otherwise(a)

    caveat = F.struct(F.lit("WINDOW_ONLY").alias("code"), F.when(g % 2 == 0, "note").otherwise("blocker").alias("severity"))
    feats = F.array(F.struct(F.lit("ma").alias("name"), F.lit(5).alias("window")),
                    F.struct(F.lit("rsi").alias("name"), varies(7, F.lit(14), F.lit(20)).alias("window")))
    return s.select(
        k.alias("run_id"), g.alias("group_id"), F.lit("TW").alias("market"),
        F.when(odd, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("symbols"),
        F.lit("2020-01-01").alias("range_start"), varies(3, F.lit("2020-12-31"), F.lit("2021-12-31")).alias("range_end"),
        F.lit("open_to_open").alias("return_target"), varies(5, F.lit(1), F.lit(2)).alias("horizon_days"),
        F.when(odd, F.reverse(feats)).otherwise(feats).alias("features"),
        F.when(~(odd & (g % 11 == 0)), "trees").alias("model"),
        F.lit(0.002).alias("fees"), varies(2, F.lit(0.001), F.lit(0.002)).alias("slippage"),
        F.lit("v1").alias("execution_cost_model_version"), F.lit("p1").alias("price_basis_version"),
        F.lit("native").alias("missing_policy_state"), F.lit("m1").alias("missing_policy_version"),
        F.when(odd & (g % 6 == 1), F.array(caveat)).otherwise(F.slice(F.array(caveat), 1, 0)).alias("caveats"))


_CMP = """SELECT s_suppkey // 4 AS g, count(*) FILTER (s_suppkey % 4 = 1) AS o, count(*) AS n FROM supplier GROUP BY 1"""
_FIND = """SELECT g AS group_id, label, severity, detail FROM (
    SELECT g, 'fields absent' AS label, 'blocker' AS severity, 'model config' AS detail FROM cg WHERE o > 0 AND g % 11 = 0
    UNION ALL SELECT g, 'other data', 'blocker', 'dataset' FROM cg WHERE o > 0 AND n > 1 AND g % 3 = 0
    UNION ALL SELECT g, 'other target', 'blocker', 'target' FROM cg WHERE o > 0 AND n > 1 AND g % 5 = 0
    UNION ALL SELECT g, 'other features', 'note', 'features' FROM cg WHERE o > 0 AND n > 1 AND g % 7 = 0
    UNION ALL SELECT g, 'other model', 'note', 'model config' FROM cg WHERE o > 0 AND n > 1 AND g % 11 = 0
    UNION ALL SELECT g, 'other costs or prices', 'blocker', 'cost basis' FROM cg WHERE o > 0 AND n > 1 AND g % 2 = 0
    UNION ALL SELECT g, 'WINDOW_ONLY', CASE WHEN g % 2 = 0 THEN 'note' ELSE 'blocker' END, 'caveat' FROM cg WHERE o > 0 AND g % 6 = 1)"""


@query("run_comparison", sql("", "SELECT * FROM fd", cg=_CMP, fd=_FIND))
def _(spark, d):
    findings, _status = rg.run_comparison(compared_runs(spark, d))
    return findings


@query("run_comparison_status", sql("", """SELECT g AS group_id, CASE WHEN b THEN 'Comparison blocked' WHEN b IS NOT NULL THEN 'Compare with notes'
    ELSE 'Comparable' END AS status FROM cg LEFT JOIN (SELECT group_id AS g, bool_or(severity = 'blocker') AS b FROM fd GROUP BY 1) USING (g)""",
    cg=_CMP, fd=_FIND))
def _(spark, d):
    _findings, status = rg.run_comparison(compared_runs(spark, d))
    return status


def order_runs(spark, d):
    """Orders as saved runs."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_id"), F.to_timestamp("o_orderdate").alias("created_at"),
        F.when(k % 2 == 0, "TW").otherwise("US").alias("market"),
        F.array(F.concat(F.lit("S"), F.col("o_custkey") % 90), F.lit("X")).alias("symbols"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"),
        F.when(k % 9 != 0, F.col("o_totalprice")).alias("total_return"), F.lit(None).cast("double").alias("rmse"))


@query("search_sort_runs", """SELECT o_orderkey AS run_id, round(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END, 2) AS total_return FROM (
    SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000)
  WHERE o_orderstatus <> 'F' AND contains(o_orderkey || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'tw' ELSE 'us' END || chr(10) || 's' || (o_custkey % 90) || ',x', 's7')""")
def _(spark, d):
    out = rg.search_sort_runs(order_runs(spark, d), limit=2000, text=" S7 ", status="succeeded",
                              sort="return_desc")
    return present(out.select("run_id", "total_return"), digits=2)


@query("cohort_run_filter", "SELECT o_orderkey AS run_id FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 3 <> 0")
def _(spark, d):
    o = table(spark, d, "orders")
    body = F.when(F.col("o_orderkey") % 3 == 0, F.lit('{"note": "c1"}')).otherwise(F.concat(
        F.lit('{"prospective_evidence": {"cohort_id": "c'), F.col("o_custkey") % 4, F.lit('"}}')))
    runs = o.select(F.col("o_orderkey").alias("run_id"), body.alias("request_json"))
    return rg.cohort_run_filter(runs, "c1").select("run_id")


@query("version_pack_status", f"""SELECT c_custkey AS run_id, field,
    CASE WHEN field = 'price_basis_version' AND c_custkey % 2 = 0 THEN 'p1' WHEN field = 'split_policy_version' THEN 's' || c_nationkey END AS value,
    CASE WHEN field IN ('live_control_version', 'adaptive_contract_version') THEN 'placeholder' ELSE 'implemented' END AS status
  FROM customer, (SELECT unnest([{', '.join(repr(f) for f in rg.VERSION_FIELDS)}]) AS field)""")
def _(spark, d):
    k = F.col("c_custkey")
    runs = table(spark, d, "customer").select(
        k.alias("run_id"), F.when(k % 2 == 0, "p1").alias("price_basis_version"),
        F.concat(F.lit("s"), "c_nationkey").alias("split_policy_version"))
    done = [f for f in rg.VERSION_FIELDS if f not in ("live_control_version", "adaptive_contract_version")]
    return rg.version_pack_status(runs, done)


@query("liquidity_coverage_attach", ident_sql("""SELECT run_id, string_agg(bucket_key || ':' || full_count || ':' || execution_count, ',' ORDER BY bucket_key) AS coverages
    FROM cov WHERE date = (SELECT max(date) FROM daily) GROUP BY 1""", **_CELLS, cov=_COV))
def _(spark, d):
    last = daily_universe(spark, d).groupBy("run_id").agg(F.max_by("bucket_coverages", "date").alias("b"))
    rows = last.select("run_id", F.inline("b")).select("run_id", "bucket_key", "full_count", "execution_count")
    out = rg.liquidity_coverage_attach(last.select("run_id"), rows)
    text = F.transform("liquidity_coverages", lambda x: F.concat_ws(
        ":", x["bucket_key"], x["full_count"].cast("string"), x["execution_count"].cast("string")))
    return out.select("run_id", F.array_join(text, ",").alias("coverages"))
