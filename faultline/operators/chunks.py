"""Case documents to overlapping chunks with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.text import clean_text, strip
from faultline.operators.cases import COPIES, snake_name
from faultline.sources.incidents import POSITION


def chunk_documents(
    cases: DataFrame,
    size: int = rules.CHUNK_CHARS,
    overlap: int = rules.CHUNK_OVERLAP,
    document: str = "case_document",
    key: str = "incident_id",
) -> DataFrame:
    """One row per chunk: id, index, total and text; other columns are kept.

    Chunks have ``size`` characters and start ``size - overlap`` apart; they are
    stripped and empty ones are left out.  A text up to one chunk stays as it is.

    The text is cut into step-long tiles in one pass and each chunk is put together
    from its tiles, so the work grows with the text length and not with its square.
    Text and tiles are columns of their own, as lambdas compute what is inlined into
    them once per element.  There is no shuffle.  No chunk list is ever empty, so the
    outer form of the explode adds no rows; the inner form would have Spark compute
    all chunks a second time to filter empty lists before the explode.
    """
    if size <= overlap:
        raise ValueError("the chunk size must be greater than the overlap")
    step = size - overlap
    span = -(-size // step)
    rest = [c for c in cases.columns if c not in (document, key)]
    tiled = cases.withColumn("__text", clean_text(F.col(document))).withColumn(
        "__tiles", F.regexp_extract_all(F.col("__text"), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    )

    def chunk(_, i: Column) -> Column:
        tiles = F.slice(F.col("__tiles"), i + 1, span)
        return strip(F.substring(F.array_join(tiles, ""), 1, size))

    pieces = F.filter(F.transform("__tiles", chunk), lambda piece: piece != "")
    whole = F.length("__text") <= size
    cut = tiled.withColumn(
        "__chunks", F.when(whole, F.array("__text")).otherwise(pieces)
    )
    spread = cut.select(
        key,
        *rest,
        F.size("__chunks").alias("total_chunks"),
        F.posexplode_outer("__chunks").alias("chunk_index", "chunk_text"),
    )
    return spread.select(
        F.concat_ws("_", key, F.lit("chunk"), "chunk_index").alias("chunk_id"),
        key,
        "chunk_index",
        "total_chunks",
        "chunk_text",
        *rest,
    )


def metadata_columns(columns: list[str], override: str = "") -> list[str]:
    """Columns that go into chunk metadata; chosen from the schema alone."""
    if override:
        wanted = [snake_name(part) for part in override.split(",")]
        return [c for c in wanted if c in columns]
    chosen = [c for c in rules.METADATA_HINTS if c in columns]
    skipped = {*rules.INTERNAL_COLUMNS, POSITION, COPIES}
    for column in columns:
        if column not in chosen and column not in skipped:
            if any(token in column for token in rules.METADATA_TOKENS):
                chosen.append(column)
            if len(chosen) >= rules.METADATA_MAX_COLUMNS:
                break
    return chosen[: rules.METADATA_MAX_COLUMNS]


_FIXED = ["incident_id", "incident_number", "plim_incident_id", "chunk_index",
          "total_chunks", "source_dataset", "schema_signature"]


def case_metadata(cases: DataFrame, chosen: list[str]) -> DataFrame:
    """Adds ``case_metadata``: the chosen columns of a case that are neither empty
    nor over-long and that no fixed entry overrides."""
    free = [c for c in chosen if c not in _FIXED]
    cleaned = cases.withColumn(
        "__values", F.array(*[clean_text(F.col(c)) for c in free]).cast("array<string>")
    )
    entries = F.map_from_arrays(
        F.array(*[F.lit(c) for c in free]).cast("array<string>"), F.col("__values")
    )
    short = F.map_filter(
        entries, lambda _, v: (v != "") & (F.length(v) <= rules.METADATA_MAX_CHARS)
    )
    return cleaned.withColumn("case_metadata", short).drop("__values")


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Adds ``metadata``: the fixed entries of a chunk and its ``case_metadata``."""
    steady = F.map_from_arrays(
        F.array(*[F.lit(c) for c in _FIXED]), F.array(*[F.col(c).cast("string") for c in _FIXED])
    )
    return chunks.withColumn("metadata", F.map_concat(steady, "case_metadata"))


def chunk_rows(
    cases: DataFrame,
    size: int = rules.CHUNK_CHARS,
    overlap: int = rules.CHUNK_OVERLAP,
    override: str = "",
) -> DataFrame:
    """Chunk store rows of a case store.

    The free metadata of a case is made once, before its text is cut.
    """
    chosen = metadata_columns(cases.columns, override)
    kept = ["incident_id", "incident_number", "plim_incident_id", "source_dataset",
            "schema_signature", "case_document"]
    slim = case_metadata(cases, chosen).select(*kept, "case_metadata")
    return chunk_metadata(chunk_documents(slim, size, overlap)).select(
        "chunk_id",
        "incident_id",
        "chunk_index",
        "total_chunks",
        "chunk_text",
        "metadata",
        "source_dataset",
    )
