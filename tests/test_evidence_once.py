"""Error evidence makes its lines once, however often it reads them."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.evidence import error_evidence


def test_lines_are_made_once(spark, frame):
    made = spark.sparkContext.accumulator(0)

    def count(text):
        made.add(1)
        return text

    rows = [(n, i // 5, i, "Traceback (most recent call last)" if i == 7 else f"line {i}") for n in range(3) for i in range(20)]
    lines = frame(rows, "log int, block int, line_pos int, line string")
    lines = lines.withColumn("line", F.udf(count, T.StringType(), useArrow=False)("line"))
    got = error_evidence(lines, ["log"]).select("log", "traceback").collect()
    assert sorted((r.log, r.traceback.count("\n")) for r in got) == [(n, 12) for n in range(3)]
    assert made.value == len(rows)
