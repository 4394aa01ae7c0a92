"""Work on log lines where they were read.

A file split is read by one task, in order.  So what follows a line, and which lines belong to a
record, is known in place but for the ends of the split.  Those ends alone travel: the first two
lines of a split and the two that wait for them, or the lines before its first header and its
last, still open record.  ``lines`` must come from the file source through row-wise steps only,
so that the rows of a split lie together and in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import strip

PATH, BLOCK = "path", "block"


def _split_finder():
    """A function that tells where in a table another split begins.  It is made here so that it
    goes to the tasks as a value; they need not have this package."""
    path_name, block_name = PATH, BLOCK

    def starts_of(rows: pa.Table) -> np.ndarray:
        n = rows.num_rows
        if n < 2:
            return np.zeros(n, np.int64)
        path, block = rows.column(path_name), rows.column(block_name)
        other = pc.or_kleene(
            pc.not_equal(path.slice(1), path.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1))
        )
        return np.concatenate([[0], np.flatnonzero(other.to_numpy()) + 1])

    return starts_of


def with_next_lines(lines: DataFrame, line: str = "line", ends: bool | None = None) -> DataFrame:
    """Adds ``next_line`` and ``third_line`` as far as the split holds them.

    ``__first`` numbers the first two lines of a split from 1, ``__missing`` says how many of the
    two lines the split does not hold.  With ``ends`` only such lines are given, without it all
    others.
    """
    schema = T.StructType(
        [
            *lines.schema.fields,
            T.StructField("next_line", T.StringType()),
            T.StructField("third_line", T.StringType()),
            T.StructField("__first", T.IntegerType()),
            T.StructField("__missing", T.IntegerType()),
        ]
    )

    starts_of, made_names = _split_finder(), schema.names[-4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, 0  # rows that wait for their followers, and how many rows of their split came before

        def given(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table, int]:
            starts = starts_of(rows)
            stops = np.append(starts[1:], len(rows))
            at = np.arange(len(rows))
            stop = np.repeat(stops, stops - starts)
            place = at - np.repeat(starts, stops - starts)
            place[: stops[0] if len(stops) else 0] += known
            missing = np.clip(3 - (stop - at), 0, 2)
            texts = rows.column(line).combine_chunks()
            found = [texts.take(pa.array(at + n, mask=at + n >= stop)) for n in (1, 2)]
            marks = [pa.array(place + 1, pa.int32(), mask=place > 1), pa.array(missing, pa.int32(), mask=missing == 0)]
            whole = rows
            for name, values in zip(made_names, [*found, *marks]):
                whole = whole.append_column(name, values)
            # the last split may go on: its last two rows wait
            keep = len(rows) if last else max(len(rows) - 2, int(starts[-1]) if len(starts) else 0)
            rest = rows.slice(keep)
            return whole.slice(0, keep), rest, int(place[keep]) if keep < len(rows) else 0

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            made, held, known = given(rows, False)
            yield from wanted(made)
        if held is not None and len(held):
            yield from wanted(given(held, True)[0])

    def wanted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if ends is not None and len(rows):
            edge = pc.is_valid(rows.column("__missing"))
            if ends:
                edge = pc.or_(edge, pc.is_valid(rows.column("__first")))
            rows = rows.filter(edge if ends else pc.invert(edge))
        yield from rows.to_batches()

    return lines.mapInArrow(run, schema)


def ends_with_next_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The last two lines of each split with the lines that follow them in later splits."""
    edges = with_next_lines(lines, line, ends=True)
    heads = F.sort_array(F.collect_list(F.when(F.col("__first").isNotNull(), F.struct("__first", line))))
    order = Window.partitionBy(PATH).orderBy(BLOCK)
    empty = F.array().cast("array<string>")
    # a row per split; a split may hold one line, so two of those after it are looked at
    splits = edges.groupBy(PATH, BLOCK).agg(
        F.transform(heads, lambda h: h[line]).alias("__heads"),
        F.collect_list(
            F.when(F.col("__missing").isNotNull(), F.struct(*[c for c in edges.columns if c not in (PATH, BLOCK)]))
        ).alias("__open"),
    )
    later = splits.withColumn("__after", F.concat(*[F.coalesce(F.lead("__heads", n).over(order), empty) for n in (1, 2)]))
    rows = later.select(PATH, BLOCK, "__after", F.inline("__open"))
    first, second = F.get("__after", F.lit(0)), F.get("__after", F.lit(1))
    return rows.select(
        *lines.columns,
        F.coalesce("next_line", first).alias("next_line"),
        F.when(F.col("__missing") == 2, second).otherwise(F.coalesce("third_line", first)).alias("third_line"),
    )


def chained_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """All lines with the two that follow each; text is not shuffled, ends of splits apart.  The
    files are read twice, once for those ends."""
    inner = with_next_lines(lines, line, ends=False).drop("__first", "__missing")
    return inner.unionByName(ends_with_next_lines(lines, line))


def _folded(lines: DataFrame, identity: list[str], line: str, pos: str) -> DataFrame:
    """Per split: its records, and one row with what may belong to a record of its neighbours.

    ``edge`` is null for a whole record.  It is true for the row of the split's end: ``head`` (lines
    before its first header) and the open record, whose ``header`` is null if the split has none.
    """
    schema = T.StructType(
        [lines.schema[c] for c in identity]
        + [lines.schema[BLOCK], T.StructField("header_pos", lines.schema[pos].dataType)]
        + [T.StructField(c, T.StringType()) for c in ("header", "traceback", "head")]
        + [T.StructField("edge", T.BooleanType())]
    )

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, starts_of, taken = to_arrow_schema(schema), _split_finder(), (*identity, BLOCK, pos, line, "is_header")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None  # identity and block, head lines, open header, its position, its lines
        out: list[tuple] = []

        def closed():
            ids, head, header, at, texts = split
            return (*ids, at, header, "\n".join(texts), "\n".join(head), True)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in taken]
            starts = starts_of(pa.Table.from_batches([batch]))
            for first, last in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                ids = tuple(c[first] for c in columns[:-3])
                if split is None or split[0] != ids:
                    if split is not None:
                        out.append(closed())
                    split = [ids, [], None, None, []]
                texts, marks = columns[-2], columns[-1]
                heads = [i for i in range(first, last) if marks[i]]
                before = texts[first : heads[0] if heads else last]
                (split[1] if split[2] is None else split[4]).extend(before)
                for i, j in zip(heads, [*heads[1:], last]):
                    if split[2] is not None:
                        out.append((*ids, split[3], split[2], "\n".join(split[4]), None, None))
                    split[2], split[3], split[4] = texts[i], columns[-3][i], texts[i + 1 : j]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)
            out = []
        if split is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, closed()))], schema=arrow)

    return lines.mapInArrow(run, schema)


def fold_lines(
    lines: DataFrame, identity: list[str], is_header: Column, line: str = "line", pos: str = "line_pos",
    staged: str | None = None,
) -> DataFrame:
    """One row per record: ``identity``, ``header_pos``, ``header`` and ``traceback``, its further lines.

    Lines are stripped, blank ones dropped, and those before the first header of a file too.
    Records are folded within their split; of a record that goes on in later splits only the parts
    are grouped.  ``staged`` names a folder to which the folded splits are written once; without
    it the files are read twice.
    """
    text = lines.withColumn(line, strip(F.col(line))).where(F.col(line) != "")
    folded = _folded(text.withColumn("is_header", is_header), identity, line, pos)
    if staged:
        folded.write.mode("overwrite").parquet(staged)
        folded = lines.sparkSession.read.schema(folded.schema).parquet(staged)
    whole = folded.where(F.col("edge").isNull()).select(*identity, "header_pos", "header", "traceback")
    # a row per split from here on; headless splits and heads go to the last open record before
    order = Window.partitionBy(*identity).orderBy(BLOCK)
    edges = folded.where("edge").withColumn(
        "__record", F.count("header").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    opened = edges.where(F.col("header").isNotNull())
    parts = edges.select(
        *identity, BLOCK,
        (F.col("__record") - F.col("header").isNotNull().cast("long")).alias("__record"),
        F.lit(None).cast("string").alias("header"),
        F.lit(None).cast(folded.schema["header_pos"].dataType).alias("header_pos"),
        F.col("head").alias("__text"),
    ).unionByName(
        opened.select(*identity, BLOCK, "__record", "header", "header_pos", F.col("traceback").alias("__text"))
    )
    ordered = F.sort_array(F.collect_list(F.when(F.col("__text") != "", F.struct(BLOCK, "__text"))))
    joined = parts.where(F.col("__record") > 0).groupBy(*identity, "__record").agg(
        F.max("header").alias("header"),
        F.max("header_pos").alias("header_pos"),
        F.array_join(F.transform(ordered, lambda x: x["__text"]), "\n").alias("traceback"),
    )
    return whole.unionByName(joined.select(whole.columns)).withColumn("traceback", strip(F.col("traceback")))
