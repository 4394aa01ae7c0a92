"""Evidence of each incident: assembly, confidence, comparison, report text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.numeric import rounded
from faultline.functions.ordered import sliced_join
from faultline.functions.text import strip
from faultline.operators.loads import RUN_KEY

# What the score reads of each evidence kind.
EVIDENCE_FIELDS = {
    "log": "status string, error_type string, error_message string, product_id string",
    "audit": "status string, error_message string",
    "product": "status string, exists boolean",
    "history": "status string, incidents_found long, has_benchmarks boolean",
    "host": "status string, overall_health string",
    "runtime": "status string, health string, has_counters boolean",
    "perf": "rows_inserted long, total_rows long",
}
# Evidence kinds with what stands in for one that is absent.
EVIDENCE_DEFAULTS = {
    "log": {},
    "audit": {},
    "product": {},
    "history": {"incidents_found": 0},
    "host": {"overall_health": "UNKNOWN"},
    "runtime": {"health": "UNKNOWN"},
    "perf": {},
}


def assemble(
    triggers: DataFrame,
    evidence: dict[str, tuple[DataFrame, list[str]]],
    key: list[str] = RUN_KEY,
    slice_rows: int = 2_000_000,
) -> DataFrame:
    """One row per trigger with a struct per evidence kind.

    ``evidence`` maps a kind to a frame and its key columns, at most one row per
    key.  An absent source gets status MISSING, be it absent for a trigger or as a
    whole kind, so the score can be taken of any selection of kinds.  Evidence that many triggers share
    (a task's audit) is joined in slices, the rest by the full, unique key.  The
    errors of all sources are collected in ``errors``.
    """
    result = triggers
    for kind, (frame, on) in evidence.items():
        fields = [c for c in frame.columns if c not in on]
        packed = frame.select(*on, F.struct(*fields).alias(kind))
        if set(on) == set(key):
            result = result.join(packed, on, "left")
        else:
            result = sliced_join(result, packed, on, F.xxhash64(*key), "left", slice_rows)
        result = result.withColumn(kind, _or_missing(frame, fields, kind))
    for kind, schema in EVIDENCE_FIELDS.items():
        if kind not in evidence:
            result = result.withColumn(kind, _missing(dict(f.split() for f in schema.split(", ")), kind))
    notes = [
        _error_note(kind, "message" in frame.columns)
        for kind, (frame, _) in evidence.items()
        if "status" in frame.columns
    ]
    return result.withColumn("errors", merge_errors(*notes))


def _or_missing(frame: DataFrame, fields: list[str], kind: str) -> Column:
    kinds = dict(frame.dtypes)
    return F.coalesce(F.col(kind), _missing({name: kinds[name] for name in fields}, kind))


def _missing(fields: dict[str, str], kind: str) -> Column:
    """The struct of an absent evidence kind; ``fields`` maps names to types."""
    defaults = {"status": "MISSING", **EVIDENCE_DEFAULTS.get(kind, {})}
    return F.struct(*[F.lit(defaults.get(n)).cast(t).alias(n) for n, t in fields.items()])


def _error_note(kind: str, has_message: bool) -> Column:
    message = F.col(f"{kind}.message") if has_message else F.lit("failed")
    note = F.concat_ws(": ", F.lit(kind), message)
    return F.array(F.when(F.col(f"{kind}.status") == "ERROR", note))


def merge_errors(*lists: Column) -> Column:
    """Error lists of several sources as one, without repeats and nulls."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(c, empty) for c in lists]) if lists else empty
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull()))


def confidence(weights: dict[str, int] = rules.CONFIDENCE) -> Column:
    """Score from 0 to 1 over the assembled evidence; every source is named, so none
    can be taken for another."""

    def ok(kind: str) -> Column:
        return F.col(f"{kind}.status").eqNullSafe("SUCCESS")

    def alarm(column: str) -> Column:
        return F.col(column).isin("WARNING", "CRITICAL")

    def given(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")) != ""

    def above_zero(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)) != 0

    found = F.coalesce(F.col("history.incidents_found"), F.lit(0))
    conditions = {
        "log": ok("log"),
        "log_type": ok("log") & given("log.error_type") & (F.col("log.error_type") != "Unknown"),
        "log_product": ok("log") & given("log.product_id"),
        "audit": ok("audit"),
        "audit_message": ok("audit") & given("audit.error_message"),
        "product": ok("product"),
        "product_exists": ok("product") & F.col("product.exists"),
        "history_many": ok("history") & (found >= 2),
        "history_one": ok("history") & (found == 1),
        "history_benchmarks": ok("history") & F.col("history.has_benchmarks"),
        "host": ok("host"),
        "host_alarm": ok("host") & alarm("host.overall_health"),
        "performance": above_zero("perf.rows_inserted") & above_zero("perf.total_rows"),
        "runtime": ok("runtime"),
        "runtime_counters": ok("runtime") & F.col("runtime.has_counters"),
        "runtime_alarm": ok("runtime") & alarm("runtime.health"),
    }
    points = [F.when(conditions[name], F.lit(points)).otherwise(0) for name, points in weights.items()]
    total = reduce(lambda a, b: a + b, points)
    return F.least(total, F.lit(100)) / F.lit(100.0)


def perf_gap(current: Column, average: Column, digits: int | None = 1) -> dict[str, Column]:
    """Gap to the historical throughput in percent, its trend and direction; null
    when either side is missing or zero."""
    usable = (current != 0) & (average != 0)
    gap = F.when(usable, (average - current) * 100.0 / F.nullif(average, F.lit(0.0)))
    return {
        "gap_pct": rounded(gap, digits),
        "gap_trend": F.when(gap > rules.GAP_BAND, "DEGRADING")
        .when(gap < -rules.GAP_BAND, "IMPROVING")
        .when(gap.isNotNull(), "STABLE"),
        "gap_direction": F.when(gap > 0, "slower").when(gap.isNotNull(), "faster"),
    }


def run_metrics(breaches: DataFrame, digits: int | None = 1) -> DataFrame:
    """Elapsed time and ETA in minutes, and seconds over the SLA."""
    over = F.col("sla_breached_at") - F.col("sla_threshold")
    return breaches.withColumns(
        {
            "elapsed_min": rounded(F.coalesce(F.col("elapsed_seconds") / 60.0, F.lit(0.0)), digits),
            "eta_min": rounded(F.coalesce(F.col("eta_seconds") / 60.0, F.lit(0.0)), digits),
            "sla_breach_by": rounded(over.cast("double"), digits),
        }
    )


def report_section(text: Column, tag: str) -> Column:
    return strip(F.coalesce(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit("")))


def report_sections(
    reports: DataFrame, text: str = "response_text", tags: list[str] = rules.REPORT_TAGS
) -> DataFrame:
    """The tagged sections of a stored report; a missing one is ``""``."""
    return reports.withColumns({tag: report_section(F.col(text), tag) for tag in tags})


def incident_status(errors: Column, crashed: Column | None = None) -> Column:
    graded = F.when(F.size(errors) == 0, "SUCCESS").otherwise("PARTIAL")
    return graded if crashed is None else F.when(crashed, "FAILED").otherwise(graded)


def publishable(incidents: DataFrame) -> DataFrame:
    """Incidents that have a report and did not fail."""
    return incidents.where(F.col("has_rca") & (F.col("workflow_status") != "FAILED"))
