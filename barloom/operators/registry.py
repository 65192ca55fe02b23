"""Run-registry analytics over one row per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Artifact names and version fields.
CORE_ARTIFACTS = ("metrics", "model_diagnostics", "equity_curve", "signals")
CONDITIONAL_ARTIFACTS = ("validation", "baselines")
VERSION_FIELDS = (
    "threshold_policy_version", "price_basis_version", "benchmark_comparability_gate",
    "comparison_eligibility", "investability_screening_active", "capacity_screening_version",
    "adv_basis_version", "missing_feature_policy_version", "execution_cost_model_version",
    "split_policy_version", "bootstrap_policy_version", "ic_overlap_policy_version",
    "factor_catalog_version", "external_lineage_version", "cluster_snapshot_version",
    "peer_comparison_policy_version", "simulation_adapter_version", "live_control_version",
    "adaptive_contract_version")
SORT_ORDERS = ("created_desc", "created_asc", "return_desc", "rmse_asc")
ELIGIBILITY_CAVEATS = {
    "comparison_metadata_only": "COMPARISON_METADATA_ONLY",
    "sample_window_pending": "SAMPLE_WINDOW_PENDING",
    "unresolved_event_quarantine": "UNRESOLVED_EVENT_QUARANTINE"}


def artifact_completeness(runs: DataFrame) -> DataFrame:
    """Adds artifact_completeness, missing_artifacts, caveat_codes.

    Needs status, wants_validation and wants_baselines (NULL when the request is
    unknown), present (array of artifact names), comparison_eligibility.
    """
    required = F.concat(
        F.array(*[F.lit(a) for a in CORE_ARTIFACTS]),
        *[F.when(F.coalesce(F.col(c), F.lit(True)), F.array(F.lit(a)))
          .otherwise(F.array().cast("array<string>"))
          for c, a in zip(("wants_validation", "wants_baselines"), CONDITIONAL_ARTIFACTS)])
    j = runs.withColumn("_req", required)
    missing = F.array_except("_req", "present")
    state = (F.when(F.size(missing) == 0, "complete")
             .when(F.size(F.array_intersect("_req", "present")) > 0, "partial")
             .otherwise("metadata_only"))
    j = j.withColumn("missing_artifacts", missing).withColumn("artifact_completeness", state)
    eligibility = F.when(F.col("comparison_eligibility").isNull(),
                         "COMPARISON_ELIGIBILITY_UNAVAILABLE")
    for value, code in ELIGIBILITY_CAVEATS.items():
        eligibility = eligibility.when(F.col("comparison_eligibility") == value, code)
    codes = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("status") == "succeeded", F.lit(False)), "ARTIFACTS_NOT_EVALUATED"),
        F.when(F.col("artifact_completeness") == "metadata_only", "METADATA_ONLY_RECORD")
        .when(F.col("artifact_completeness") == "partial", "REVIEW_ARTIFACTS_MISSING"),
        eligibility))
    return j.withColumn("caveat_codes", codes).drop("_req")


def comparison_eligibility() -> Column:
    """Over corporate_event_state, the three version columns and sample_window_pending."""
    core = (F.col("price_basis_version").isNotNull()
            & F.col("threshold_policy_version").isNotNull()
            & F.col("execution_cost_model_version").isNotNull())
    return (F.when(F.col("corporate_event_state") == "unresolved_corporate_event",
                   "unresolved_event_quarantine")
            .when(~core, "comparison_metadata_only")
            .when(F.col("sample_window_pending"), "sample_window_pending")
            .otherwise("strategy_pair_comparable"))


def _absent(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def run_comparison(runs: DataFrame, *, group: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """((group, label, severity, detail), (group, status)) for groups of runs.

    Each dimension has a signature; a group differs when its least and greatest
    signatures do, so no signature list is gathered. Columns: market, symbols
    (array), range_start, range_end, return_target, horizon_days, features (array
    of struct), model (text), fees, slippage, execution_cost_model_version,
    price_basis_version, missing_policy_state, missing_policy_version, caveats
    (array of code, severity).
    """
    def sig(*columns) -> Column:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

    dims = {
        "dataset": (sig("market", F.array_sort("symbols").alias("s"), "range_start", "range_end"),
                    _absent("market", "range_start", "range_end") | (F.size("symbols") <= 0),
                    "other data", "blocker"),
        "target": (sig("return_target", "horizon_days"), _absent("return_target", "horizon_days"),
                   "other target", "blocker"),
        "features": (sig(F.array_sort("features").alias("f")), F.size("features") <= 0,
                     "other features", "note"),
        "model config": (F.coalesce("model", F.lit("N/A")), _absent("model"),
                         "other model", "note"),
        "cost basis": (sig("fees", "slippage", "execution_cost_model_version"),
                       _absent("fees", "slippage", "execution_cost_model_version"),
                       "other costs or prices", "blocker"),
        "price basis": (F.coalesce("price_basis_version", F.lit("N/A")),
                        _absent("price_basis_version"), "other costs or prices", "blocker"),
        "missing-feature policy": (sig("missing_policy_state", "missing_policy_version"),
                                   _absent("missing_policy_state", "missing_policy_version"),
                                   "other rule for missing values", "blocker"),
    }
    aggs = []
    for i, (signature, absent, _label, _sev) in enumerate(dims.values()):
        aggs += [F.min(signature).alias(f"_a{i}"), F.max(signature).alias(f"_b{i}"),
                 F.max(F.coalesce(absent, F.lit(True))).alias(f"_m{i}")]
    g = runs.groupBy(group).agg(*aggs)
    holes = F.array_compact(F.array(*[F.when(F.col(f"_m{i}"), name)
                                      for i, name in enumerate(dims)]))

    def finding(when: Column, label: str, severity: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"),
                                     detail.alias("detail")))

    rows = [finding(F.size(holes) > 0, "fields absent", "blocker",
                    F.array_join(holes, ", "))]
    for i, (name, (_s, _a, label, severity)) in enumerate(dims.items()):
        rows.append(finding(F.col(f"_a{i}") != F.col(f"_b{i}"), label, severity, F.lit(name)))
    own = g.select(group, F.inline(F.array_compact(F.array(*rows))))
    caveats = runs.select(group, F.inline("caveats")).distinct().select(
        group, F.col("code").alias("label"), "severity", F.lit("caveat").alias("detail"))
    findings = own.unionByName(caveats)
    worst = findings.groupBy(group).agg(F.max(F.col("severity") == "blocker").alias("_b"))
    status = g.select(group).join(worst, group, "left").select(
        group, F.when(F.col("_b"), "Comparison blocked")
        .when(F.col("_b").isNotNull(), "Compare with notes")
        .otherwise("Comparable").alias("status"))
    return findings, status


def search_sort_runs(runs: DataFrame, *, limit: int, text: str = "", status: str = "all",
                     sort: str = "created_desc") -> DataFrame:
    """The newest ``limit`` runs, filtered by text and status, in one of four orders."""
    if sort not in SORT_ORDERS:
        raise ValueError(f"unknown sort {sort!r}")
    recent = runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)
    needle = text.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws("\n", F.col("run_id").cast("string"),
                                  F.coalesce("market", F.lit("")), F.array_join("symbols", ",")))
        recent = recent.where(hay.contains(needle))
    if status != "all":
        recent = recent.where(F.col("status") == status)
    order = {"created_desc": F.col("created_at").desc(), "created_asc": F.col("created_at").asc(),
             "return_desc": F.col("total_return").desc_nulls_last(),
             "rmse_asc": F.col("rmse").asc_nulls_last()}[sort]
    return recent.orderBy(order, "run_id")


def cohort_run_filter(runs: DataFrame, cohort: str, *, request: str = "request_json") -> DataFrame:
    """Runs whose request names the cohort, compared on the parsed field."""
    return runs.where(F.get_json_object(request, "$.prospective_evidence.cohort_id") == cohort)


def version_pack_status(runs: DataFrame, implemented: Sequence[str] = VERSION_FIELDS) -> DataFrame:
    """(run_id, field, value, status) for every version field of each run."""
    have = set(runs.columns)
    return runs.select("run_id", F.inline(F.array(*[F.struct(
        F.lit(f).alias("field"),
        (F.col(f).cast("string") if f in have else F.lit(None).cast("string")).alias("value"),
        F.lit("implemented" if f in implemented else "placeholder").alias("status"))
        for f in VERSION_FIELDS])))


def liquidity_coverage_attach(runs: DataFrame, coverages: DataFrame) -> DataFrame:
    """Runs with their bucket rows as one ordered array (four rows per run)."""
    rest = [c for c in coverages.columns if c != "run_id"]
    packed = coverages.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct(*rest))).alias("liquidity_coverages"))
    return runs.join(packed, "run_id", "left")
