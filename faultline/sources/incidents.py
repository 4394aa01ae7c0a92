"""Incident datasets: CSV files with a schema of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = "input_pos"
MALFORMED = "__malformed_record"
SURPLUS = "an incident record has more cells than its header"


def read_incidents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every cell as text; empty cells are ``""``; "NA" and "null" stay text.

    Column names are the header cells as written, repeats included, so columns are
    to be addressed only after :func:`faultline.operators.cases.normalize_columns`.
    Reading the header is a one-record action.  ``input_pos`` holds the input order.
    Missing cells at the end of a record are empty.  A record with more cells than the
    header, and a file whose header differs from the first one, fail the read.

    With ``multi_line`` a file is one task, as quoted cells may hold line feeds;
    switch it off for large files that are known to hold none.
    """
    def reader():
        return (
            spark.read.option("quote", '"')
            .option("escape", '"')
            .option("multiLine", str(multi_line).lower())
            .option("inferSchema", "false")
        )

    first = reader().csv(path, header=False)
    names = _header(first, path)
    known = {name.lower() for name in names}
    if "" in known or len(known) < len(names):
        # such names are no schema, so the other headers are compared here
        for file in first.inputFiles():
            if _header(reader().csv(file, header=False), file) != names:
                raise ValueError(f"the header of {file} differs from the first one in {path}")
        fields, check = [f"c{i}" for i in range(len(names))], False
    else:
        fields, check = names, True
    # parsed rows take names of their own, as header cells may be any text
    schema = T.StructType([T.StructField(p, T.StringType()) for p in [*fields, MALFORMED]])
    rows = (
        reader()
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", "false")
        .schema(schema)
        .csv(path, header=True, enforceSchema=not check)
    )
    places = [f"c{i}" for i in range(len(names))]
    placed = rows.toDF(*places, MALFORMED)
    # always true; it names a cell, as a query may not take the malformed text alone
    parsed = F.coalesce(F.length(places[0]), F.lit(0)) >= 0
    kept = placed.where(
        F.when(_surplus(F.col(MALFORMED), len(names)), F.raise_error(SURPLUS).cast("boolean"))
        .otherwise(parsed)
    )
    cells = [F.coalesce(F.col(p), F.lit("")).alias(p) for p in places]
    numbered = kept.select(*cells, F.monotonically_increasing_id().alias(POSITION))
    return numbered.toDF(*names, POSITION)


def _header(rows: DataFrame, path: str) -> list[str]:
    header = rows.head()
    if header is None:
        raise ValueError(f"no header record in {path}")
    return [cell if cell is not None else "" for cell in header]


def _surplus(record: Column, cells: int) -> Column:
    """Whether the text of a malformed record has more than ``cells`` cells."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(",")))
    return F.coalesce(commas >= cells, F.lit(False))
