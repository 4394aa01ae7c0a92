"""All open triggers to scored incidents and their summary table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import rca, report
from faultline.operators.loads import RUN_KEY


def store_evidence(
    evidence: dict[str, tuple[DataFrame, list[str]]], folder: str
) -> dict[str, tuple[DataFrame, list[str]]]:
    """Writes each kind once below ``folder``; the same mapping over what was written.

    Score, status and summary of an incident then read the small evidence tables and not
    the logs, audits and snapshots behind them.  The kinds are jobs of their own and run
    side by side, so that a short one does not wait for a long one.
    """

    def stored(kind: str, frame: DataFrame) -> DataFrame:
        path = f"{folder}/{kind}"
        frame.write.mode("overwrite").parquet(path)
        return frame.sparkSession.read.schema(frame.schema).parquet(path)

    if not evidence:
        return {}
    session = next(iter(evidence.values()))[0].sparkSession
    with ThreadPoolExecutor(len(evidence)) as pool:
        jobs = {
            kind: pool.submit(inheritable_thread_target(session)(stored), kind, frame)
            for kind, (frame, _) in evidence.items()
        }
        return {kind: (job.result(), evidence[kind][1]) for kind, job in jobs.items()}


def analyse(
    triggers: DataFrame,
    evidence: dict[str, tuple[DataFrame, list[str]]],
    reports: DataFrame,
) -> DataFrame:
    """Evidence, confidence, report sections and status of every trigger.

    ``reports`` holds the run key, ``incident_id`` and ``response_text``.  A trigger
    without a report keeps empty sections and has ``rca_status`` ERROR.  A trigger whose
    column ``crashed``, where there is one, is true has ``workflow_status`` FAILED.
    """
    crashed = F.coalesce(F.col("crashed"), F.lit(False)) if "crashed" in triggers.columns else None
    assembled = rca.assemble(triggers, evidence)
    sections = rca.report_sections(reports).drop("confidence_score")
    joined = assembled.join(sections, RUN_KEY, "left")
    answered = F.coalesce(F.col("response_text"), F.lit("")) != ""
    late = F.array(F.when(~answered, F.lit("rca: no stored response")))
    return joined.withColumns(
        {
            "confidence_score": rca.confidence(),
            "rca_status": F.when(answered, "SUCCESS").otherwise("ERROR"),
            "has_rca": F.lit(True),
            "errors": rca.merge_errors(F.col("errors"), late),
        }
    ).withColumn("workflow_status", rca.incident_status(F.col("errors"), crashed))


def summarise(analysed: DataFrame) -> DataFrame:
    return report.incident_summary(rca.publishable(analysed))
