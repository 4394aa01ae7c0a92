"""Performance benchmarks over similar past incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.numeric import positive_or_zero, positive_whole_or_zero, rounded
from faultline.functions.ordered import sliced_join
from faultline.operators.search import rank_similarity

_SCALE = 1_000_000


def to_incident(cases: DataFrame, rank: str = "case_rank") -> DataFrame:
    """Cases as typed incident records; columns the schema lacks become empty."""
    have = set(cases.columns)

    def source(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")

    passed = [c for c in ("query_id", rank) if c in have]
    similarity = rank_similarity(F.col(rank)) if rank in have else F.lit(None).cast("double")
    return cases.select(
        *passed,
        *[source(c).alias(c) for c in rules.INCIDENT_TEXT_FIELDS],
        *[positive_whole_or_zero(source(c)).alias(c) for c in rules.INCIDENT_WHOLE_FIELDS],
        *[positive_or_zero(source(c)).alias(c) for c in rules.INCIDENT_DECIMAL_FIELDS],
        similarity.alias("similarity_score"),
    )


def is_perf_case() -> Column:
    return (F.col("rows_per_second") > 0) | (F.col("elapsed_seconds") > 0)


def perf_cases(incidents: DataFrame) -> DataFrame:
    """Incidents with a usable throughput or run time."""
    return incidents.where(is_perf_case())


def in_band(volume: Column, current: Column, tolerance: float = rules.VOLUME_TOLERANCE) -> Column:
    return (current > 0) & (F.abs(volume - current) <= current * tolerance)


def volume_band(
    cases: DataFrame,
    runs: DataFrame,
    by: str,
    spread: Column,
    tolerance: float = rules.VOLUME_TOLERANCE,
    slice_rows: int = 2_000_000,
) -> DataFrame:
    """Performance cases of a volume near the current run's; all of them for a run
    that has none near.

    ``runs`` holds ``by`` and ``current_volume``, one row per run.  Whether a run has
    a case in its band is found on the distinct volumes of its cases, so no window
    and no task ever holds all cases of a run, and the cases are joined once.
    """
    perf = perf_cases(cases)

    def near(volume: str) -> Column:
        current = F.col("current_volume")
        return F.coalesce(in_band(F.col(volume), current, tolerance), F.lit(False))

    volumes = perf.groupBy(by, "record_volume").agg(F.count(F.lit(1)).alias("__n"))
    graded = (
        volumes.join(runs.select(by, "current_volume"), by)
        .groupBy(by)
        .agg(
            F.max("current_volume").alias("current_volume"),
            F.max(near("record_volume")).alias("__any"),
            F.sum("__n").alias("__rows"),
        )
    )
    joined = sliced_join(
        perf, graded.drop("__rows"), [by], spread, "inner", slice_rows,
        graded.select(by, "__rows"),
    ).withColumn("volume_matched", near("record_volume"))
    return joined.where(F.col("volume_matched") | ~F.col("__any")).drop("__any")


def _mean(value: Column, keep: Column) -> Column:
    """Mean of the positive values.  They are added up as whole millionths, which is
    exact, so the order in which partial sums meet cannot show in the result."""
    moved = value * float(_SCALE) + 0.5
    # floor() would end at the largest 64-bit number
    scaled = (moved - F.pmod(moved, F.lit(1.0))).cast("decimal(28,0)")
    counted = F.when(keep & (value > 0), scaled)
    total = F.sum(counted).cast("double") / float(_SCALE)
    return total / F.nullif(F.count(counted), F.lit(0))


_MEASURES = {
    "avg_elapsed_seconds": ("elapsed_seconds", _mean),
    "best_elapsed_seconds": ("elapsed_seconds", lambda v, k: F.min(F.when(k & (v > 0), v))),
    "worst_elapsed_seconds": ("elapsed_seconds", lambda v, k: F.max(F.when(k & (v > 0), v))),
    "avg_rows_per_second": ("rows_per_second", _mean),
    "best_rows_per_second": ("rows_per_second", lambda v, k: F.max(F.when(k & (v > 0), v))),
    "avg_improvement_pct": ("fix_reduced_time_by_pct", _mean),
    "avg_estimated_improvement": ("estimated_improvement_pct", _mean),
}


def _marked(cases: DataFrame, tolerance: float) -> DataFrame:
    """Performance cases with ``__near``: whether they are in the volume band."""
    perf = perf_cases(cases)
    if "current_volume" in perf.columns:
        near = F.coalesce(
            in_band(F.col("record_volume"), F.col("current_volume"), tolerance), F.lit(False)
        )
    else:
        near = F.lit(False)
    return perf.withColumn("__near", near)


def _aggregates() -> list[Column]:
    """Every measure over all cases and over those in the band."""
    made = [
        F.count(F.lit(1)).alias("__all_count"),
        F.count_if("__near").alias("__near_count"),
    ]
    for name, (column, make) in _MEASURES.items():
        made.append(make(F.col(column), F.lit(True)).alias(f"__all_{name}"))
        made.append(make(F.col(column), F.col("__near")).alias(f"__near_{name}"))
    return made


def _chosen(digits: int | None) -> list[Column]:
    """The measures over the band where it holds cases, else over all."""
    use_near = F.col("__near_count") > 0

    def choose(name: str) -> Column:
        return F.when(use_near, F.col(f"__near_{name}")).otherwise(F.col(f"__all_{name}"))

    return [
        choose("count").alias("benchmark_incident_count"),
        *[F.coalesce(rounded(choose(name), digits), F.lit(0.0)).alias(name) for name in _MEASURES],
        use_near.alias("volume_matched"),
    ]


def benchmarks(
    cases: DataFrame, by: list[str], digits: int | None = 1,
    tolerance: float = rules.VOLUME_TOLERANCE,
) -> DataFrame:
    """Statistics over the performance cases of each group.

    When ``cases`` has ``current_volume``, groups with cases in the volume band use
    those alone.  Both variants come from one pass of conditional aggregates with
    map-side partial results, so a hot group costs no more than a cold one.
    """
    return _marked(cases, tolerance).groupBy(*by).agg(*_aggregates()).select(*by, *_chosen(digits))


def common_value(
    cases: DataFrame, column: str, by: list[str], default: Column, usable: Column | None = None
) -> DataFrame:
    """Most frequent usable value per group; the smallest one wins a tie.

    Counted per group and value first, so only one row per distinct value moves on.
    """
    fine = usable if usable is not None else (F.col(column) != "")
    counted = (
        cases.withColumn("__value", F.when(fine, F.col(column)))
        .groupBy(*by, "__value")
        .agg(F.count(F.lit(1)).alias("__count"))
    )
    best = F.min(
        F.when(
            F.col("__value").isNotNull(),
            F.struct((-F.col("__count")).alias("n"), F.col("__value").alias("v")),
        )
    )
    return counted.groupBy(*by).agg(F.coalesce(best["v"], default).alias(f"common_{column}"))


def best_fix(
    cases: DataFrame, by: list[str], order: Column, chars: int = rules.BEST_FIX_CHARS
) -> DataFrame:
    """Start of the fix with the highest measured improvement, if any improved.

    ``order`` (the case rank) decides between equal improvements.
    """
    best = _best_gain(order, chars)
    return cases.groupBy(*by).agg(F.coalesce(best["fix"], F.lit("")).alias("most_successful_fix"))


def _best_gain(order: Column, chars: int) -> Column:
    gain = F.col("fix_reduced_time_by_pct")
    return F.max(
        F.when(
            gain > 0,
            F.struct(
                gain.alias("gain"),
                (-order).alias("first"),
                F.substring("fix_applied", 1, chars).alias("fix"),
            ),
        )
    )


def full_benchmarks(
    cases: DataFrame, by: list[str], order: Column, digits: int | None = 1,
    tolerance: float = rules.VOLUME_TOLERANCE, chars: int = rules.BEST_FIX_CHARS,
) -> DataFrame:
    """Benchmarks with the common method, common batch size and best fix.

    ``cases`` must already be reduced by :func:`volume_band` where bands apply.  One
    aggregate makes the measures and the best fix, a second one counts methods and batch
    sizes as grouping sets, so that their rows carry a count and not every measure.
    """
    marked = _marked(cases, tolerance)
    measured = marked.groupBy(*by).agg(*_aggregates(), _best_gain(order, chars).alias("__best"))
    values = marked.select(
        *by,
        F.when(F.col("insert_method") != "", F.col("insert_method")).alias("__method"),
        F.when(F.col("batch_size") > 0, F.col("batch_size")).alias("__batch"),
    )
    counted = values.groupingSets([[*by, "__method"], [*by, "__batch"]], *by, "__method", "__batch").agg(
        F.count(F.lit(1)).alias("__count")
    )

    def common(value: str) -> Column:
        # the column of the other set is null here, so it can name no value
        ranked = F.struct((-F.col("__count")).alias("n"), F.col(value).alias("v"))
        return F.min(F.when(F.col(value).isNotNull(), ranked))["v"]

    picked = counted.groupBy(*by).agg(
        F.coalesce(common("__method"), F.lit("Unknown")).alias("common_insert_method"),
        F.coalesce(common("__batch"), F.lit(0).cast("bigint")).alias("common_batch_size"),
    )
    return measured.join(picked, by).select(
        *by,
        *_chosen(digits),
        "common_insert_method",
        "common_batch_size",
        F.coalesce("__best.fix", F.lit("")).alias("most_successful_fix"),
    )
