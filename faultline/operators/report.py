"""Summary table of each incident: steps, impact, sections, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.text import (
    as_text, contains_any, filled, first_group, lines, safe_text,
)


def severity(error_type: Column) -> Column:
    """Severity by a small fixed table, as an expression."""
    pairs = [F.lit(x) for item in rules.SEVERITY.items() for x in item]
    table = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(table, error_type), F.lit(rules.SEVERITY_DEFAULT))


def with_severity(errors: DataFrame, dim: DataFrame) -> DataFrame:
    """The same from a severity table (``error_type, severity``; six rows as shipped).

    No broadcast is forced: Spark broadcasts the table when its size allows it.
    """
    return errors.join(dim, "error_type", "left").na.fill(
        rules.SEVERITY_DEFAULT, ["severity"]
    )


def constraint_name(message: Column) -> Column:
    return F.coalesce(first_group(as_text(message), rules.CONSTRAINT_PATTERNS), F.lit("Unknown"))


def numbered_steps(
    text: Column, defaults: list[str], padding: str, n: int = 3
) -> Column:
    """The first ``n`` numbered lines without their numbers, padded; defaults when
    there is no text."""
    numbered = F.filter(lines(text), lambda x: x.rlike(r"^\d+[.)]"))
    bare = F.transform(numbered, lambda x: F.regexp_replace(x, r"^\d+[.)]\s*", ""))
    padded = F.slice(F.concat(bare, F.array_repeat(F.lit(padding), n)), 1, n)
    return F.when(as_text(text) == "", F.array(*[F.lit(d) for d in defaults[:n]])).otherwise(padded)


def resolution_steps(text: Column) -> Column:
    return numbered_steps(text, rules.RESOLUTION_DEFAULTS, rules.RESOLUTION_PADDING)


def preventive_steps(text: Column) -> Column:
    return numbered_steps(text, rules.PREVENTION_DEFAULTS, rules.PREVENTION_PADDING)


def impact(
    error_type: Column, error_message: Column, audit_status: Column, agent_status: Column
) -> Column:
    """State of the product load, the catalog and the feeds downstream."""

    def triple(values: tuple[str, str, str]) -> Column:
        names = ["product_load", "catalog_update", "downstream_feeds"]
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names)])

    late = F.coalesce(error_type.isin(rules.SLA_ERROR_TYPES), F.lit(False)) | as_text(
        error_message
    ).contains("SLA")
    failed = audit_status.eqNullSafe("FAILED") | agent_status.eqNullSafe("ERROR")
    return (
        F.when(late, triple(rules.IMPACT_SLA))
        .when(failed, triple(rules.IMPACT_FAILED))
        .when(agent_status.eqNullSafe("NO_FAILURE_FOUND"), triple(rules.IMPACT_NONE))
        .otherwise(triple(rules.IMPACT_FAILED))
    )


# --------------------------------------------------------------- report sections
def section_lines(
    text: Column,
    start: list[str] = rules.HISTORY_START,
    stop: list[str] = rules.HISTORY_STOP,
    limit: int = rules.HISTORY_LINES,
    strict_reference: bool = False,
) -> Column:
    """Dash lines between a start marker line and the next stop marker line.

    A dash line is content and no marker.  ``strict_reference`` keeps the older rule
    by which any line that holds a marker text ends the section.
    """
    rows = lines(text)

    def marks(line: Column, words: list[str]) -> Column:
        held = contains_any(F.upper(line), words)
        return held if strict_reference else held & ~line.startswith("-")

    begin = F.array_position(F.transform(rows, lambda x: marks(x, start)), True)
    after = F.filter(rows, lambda x, i: (i >= begin) & ~marks(x, start))
    end = F.array_position(F.transform(after, lambda x: marks(x, stop)), True)
    body = F.filter(after, lambda x, i: (end == 0) | (i < end - 1))
    dashes = F.slice(F.filter(body, lambda x: x.startswith("-")), 1, limit)
    return F.when(begin == 0, F.array().cast("array<string>")).otherwise(dashes)


def word_lines(text: Column, words: list[str], chars: int = rules.LINE_CHARS) -> Column:
    """Lines that hold one of the words, cut to a length."""
    hits = F.filter(lines(text), lambda x: contains_any(F.lower(x), words))
    return F.transform(hits, lambda x: F.substring(x, 1, chars))


def comparison_lines(text: Column, strict_reference: bool = False) -> Column:
    """History section of a report, else its lines with comparison words."""
    section = section_lines(text, strict_reference=strict_reference)
    return F.when(F.size(section) > 0, section).otherwise(
        word_lines(text, rules.COMPARISON_WORDS)
    )


def best_fix_line(text: Column) -> Column:
    return F.try_element_at(word_lines(text, rules.BEST_FIX_WORDS), F.lit(1))


def first_lines(text: Column, n: int = rules.SECTION_LINES) -> Column:
    return F.slice(lines(text), 1, n)


def sla_summary(text: Column) -> Column:
    given = as_text(text)
    return F.when(
        (given == "") | (given == "Unknown"), F.lit("SLA analysis not available")
    ).otherwise(safe_text(F.array_join(first_lines(text), " | "), max_chars=rules.SUMMARY_CHARS))


# ------------------------------------------------------------------------ checks
def check_outcome(
    error_type: Column, total_rows: Column, exists: Column, product_name: Column,
    status: Column, product_id: Column,
) -> dict[str, Column]:
    """Outcome of the product check as a code and as its sentence."""
    late = F.coalesce(error_type.isin(rules.SLA_ERROR_TYPES), F.lit(False))
    rows = F.coalesce(total_rows, F.lit(0))
    shown_id = F.coalesce(product_id.cast("string"), F.lit("None"))
    found = F.coalesce(exists, F.lit(False)) & (as_text(product_name) != "")
    searched = status.eqNullSafe("SUCCESS")
    code = (
        F.when(late, "SLA_MISS").when(found, "FOUND").when(searched, "NOT_FOUND")
        .otherwise("UNAVAILABLE")
    )
    sentence = (
        F.when(late & (rows != 0), filled(rules.CHECK_SLA_ROWS, rows=F.format_number(rows, 0)))
        .when(late, rules.CHECK_SLA)
        .when(found, filled(rules.CHECK_FOUND, id=shown_id, name=product_name))
        .when(searched, filled(rules.CHECK_NOT_FOUND, id=shown_id))
        .otherwise(rules.CHECK_UNAVAILABLE)
    )
    return {"check_outcome": code, "postgresql_check": sentence}


def closest_case(found: Column, top_id: Column) -> Column:
    return F.when(
        F.coalesce(found, F.lit(0)) > 0,
        filled(rules.CLOSEST_CASE, found=found, id=F.coalesce(top_id, F.lit(""))),
    ).otherwise(rules.NO_CLOSEST_CASE)


def performance_lines(insights: Column) -> Column:
    """What the report says on history and the best fix, as one text."""
    fix = F.array_compact(F.array(best_fix_line(insights)))
    return F.array_join(F.array_distinct(F.concat(comparison_lines(insights), fix)), "\n")


#: Numbers of the run and grades that go along with the text fields.
RUN_NUMBERS = [
    "rows_inserted", "total_rows", "pct_complete", "elapsed_seconds", "rows_per_second",
    "eta_seconds", "sla_threshold", "sla_breach_by",
]
GRADES = ["cpu_health", "memory_health", "postgres_health"]


def incident_summary(incidents: DataFrame) -> DataFrame:
    """The 26 text fields of each incident, the numbers of its run and the health grades.

    Numbers and grades are columns of their own, null where there is no evidence.
    ``incidents`` has the structs of :func:`faultline.operators.rca.assemble`, the
    report sections, ``incident_id`` and ``rca_status``.
    """
    message = F.col("log.error_message")
    outcome = check_outcome(
        F.col("log.error_type"), F.col("perf.total_rows"), F.col("product.exists"),
        F.col("product.product_name"), F.col("product.status"), F.col("log.product_id"),
    )
    effect = impact(
        F.col("log.error_type"), message, F.col("audit.audit_status"), F.col("audit.status")
    )
    resolution = resolution_steps(F.col("resolution"))
    prevention = preventive_steps(F.col("preventive_actions"))
    status = F.when(F.col("rca_status").eqNullSafe("SUCCESS"), "Confirmed").otherwise(
        "Under Investigation"
    )
    fields = {
        "incident_id": safe_text(F.col("incident_id")),
        "dag": safe_text(F.col("dag_id")),
        "task": safe_text(F.col("task_id")),
        "severity": severity(F.col("log.error_type")),
        "status": status,
        "confidence": safe_text(F.col("confidence_score")),
        "error": safe_text(message),
        "product_id": safe_text(F.col("log.product_id")),
        "constraint": constraint_name(message),
        "cause": safe_text(F.col("root_cause"), max_chars=rules.SUMMARY_CHARS),
        "airflow_logs": safe_text(message),
        "postgresql_check": outcome["postgresql_check"],
        "historical_cases": closest_case(
            F.col("history.incidents_found"), F.col("history.top_match_id")
        ),
        "sla_analysis": sla_summary(F.col("sla_analysis")),
        "performance_insights": safe_text(performance_lines(F.col("performance_insights"))),
        "system_health": F.when(F.col("host.status").eqNullSafe("SUCCESS"), F.col("host.overall_health"))
        .otherwise("UNKNOWN"),
        "product_load": effect["product_load"],
        "catalog_update": effect["catalog_update"],
        "downstream_feeds": effect["downstream_feeds"],
        "remove_duplicate_record": safe_text(resolution[0]),
        "reload_source_file": safe_text(resolution[1]),
        "rerun_dag": safe_text(resolution[2]),
        "prevention_high_1": safe_text(prevention[0]),
        "prevention_high_2": safe_text(prevention[1]),
        "prevention_medium_1": safe_text(prevention[2]),
        "final_verdict": safe_text(F.col("summary"), max_chars=rules.VERDICT_CHARS),
    }
    def given(kind: str, names: list[str]) -> list[Column]:
        have = incidents.schema[kind].dataType.names
        return [F.col(f"{kind}.{n}") for n in names if n in have]

    return incidents.select(
        *[value.alias(name) for name, value in fields.items()],
        *given("perf", RUN_NUMBERS),
        *given("host", GRADES),
        F.col("runtime.health").alias("runtime_health"),
    )
