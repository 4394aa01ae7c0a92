"""Incident rows to cases: names, cleaning, duplicates, ids, documents.

Header and column-choice logic works on the schema alone, so it is plain Python on
the driver; every pass over the data is a DataFrame expression.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.text import as_text, clean_text, sha16, strip
from faultline.sources.incidents import POSITION

COPIES = "input_copies"
_ROW_JSON = {"ignoreNullFields": "false"}


# ------------------------------------------------------------------ schema only
def snake_name(header: str) -> str:
    name = re.sub("[^a-z0-9]+", "_", header.lower()).strip("_")
    return name if name else "column"


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get the first free suffix from ``_2`` on."""
    taken: set[str] = set(names)
    used: set[str] = set()
    result = []
    for name in names:
        candidate, number = name, 2
        while candidate in used or (candidate != name and candidate in taken):
            candidate = f"{name}_{number}"
            number += 1
        used.add(candidate)
        result.append(candidate)
    return result


def normalize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Snake-case, unique column names, and the original-to-new mapping.

    The input position column keeps its name and is no source column.  Every source column
    is in the mapping: of equal headers, the later ones go under their header with the
    first free suffix, as their names do.
    """
    originals = [c for c in df.columns if c != POSITION]
    fresh = unique_names([snake_name(c) for c in originals])
    renamed = dict(zip(unique_names(originals), fresh))
    stream = iter(fresh)
    full = [c if c == POSITION else next(stream) for c in df.columns]
    return df.toDF(*full), renamed


def sorted_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def schema_signature(columns: list[str]) -> str:
    return sha256(sorted_json(columns).encode("utf-8")).hexdigest()[:16]


def source_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (POSITION, COPIES)]


# -------------------------------------------------------------------- row level
def clean_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c)) for c in columns})


def row_json(columns: list[str]) -> Column:
    """All source cells of a row as one JSON object with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), _ROW_JSON)


def raw_fields_json(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("raw_fields_json", row_json(columns))


def drop_exact(df: DataFrame, columns: list[str], position: str = POSITION) -> DataFrame:
    """One row per distinct content: the first position and the number of copies.

    Copies meet in the map-side part of the aggregation, so a text that fills a
    third of the input travels once per map task.
    """
    return df.groupBy(*columns).agg(
        F.min(position).alias(position), F.count(F.lit(1)).alias(COPIES)
    )


def choose_case_id(df: DataFrame, override: str = "") -> str | None:
    """The id column: the override when present, else the first candidate that has
    a value.  One aggregation row is read, and none when no candidate exists."""
    if override and snake_name(override) in df.columns:
        return snake_name(override)
    present = [c for c in rules.CASE_ID_CANDIDATES if c in df.columns]
    if not present:
        return None
    filled = df.agg(*[F.max(strip(as_text(F.col(c))) != "").alias(c) for c in present])
    row = filled.first()
    return next((c for c in present if row[c]), None)


def assign_case_id(
    df: DataFrame,
    columns: list[str],
    id_column: str | None,
    mapping: dict[str, str],
    source_dataset: str = rules.SOURCE_DATASET,
) -> DataFrame:
    """The id contract: three equal ids, where they came from, and the schema."""
    generated = F.concat(F.lit(rules.GENERATED_ID_PREFIX), sha16(row_json(columns)))
    given = clean_text(F.col(id_column)) if id_column else F.lit("")
    case_id = F.when(given == "", generated).otherwise(given)

    kept = df
    if "incident_id" in columns and id_column != "incident_id":
        spare, number = "source_original_incident_id", 2
        while spare in df.columns:
            spare, number = f"source_original_incident_id_{number}", number + 1
        kept = df.withColumn(spare, F.col("incident_id"))
    return kept.withColumns(
        {
            "incident_id": case_id,
            "incident_number": case_id,
            "plim_incident_id": case_id,
            "rag_case_id_source_column": F.lit(id_column or rules.GENERATED_ID_SOURCE),
            "source_dataset": F.lit(source_dataset),
            "source_schema_json": F.lit(sorted_json(columns)),
            "source_column_mapping_json": F.lit(sorted_json(mapping)),
            "schema_signature": F.lit(schema_signature(columns)),
        }
    )


def merge_cases(
    df: DataFrame, key: str = "incident_id", position: str = POSITION
) -> DataFrame:
    """One row per id.  Each column joins its distinct non-empty values, in the
    order in which they first occur, with a blank line; raw rows become an array.

    Only ids that occur more than once are reshaped.  Their cells are first reduced
    to distinct values per id and column, which map tasks do before any shuffle, so
    what meets in one task is never more than the merged cell itself.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    repeated = counts.where(F.col("__rows") > 1).select(key)
    singles = df.join(repeated, key, "left_anti")
    several = df.join(repeated, key, "left_semi")

    content = [c for c in df.columns if c not in (key, position, COPIES)]
    cells = several.select(
        key,
        position,
        F.posexplode(F.array(*[F.col(c).cast("string") for c in content])).alias(
            "__column", "__value"
        ),
    ).where(F.col("__value") != "")
    distinct = cells.groupBy(key, "__column", "__value").agg(F.min(position).alias("__at"))
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("__at", "__value"))), lambda x: x["__value"]
    )
    joined = distinct.groupBy(key, "__column").agg(ordered.alias("__values"))
    raw = content.index("raw_fields_json") if "raw_fields_json" in content else -1
    merged = joined.withColumn(
        "__text",
        F.when(
            F.col("__column") == raw,
            F.concat(F.lit("["), F.array_join("__values", ","), F.lit("]")),
        ).otherwise(F.array_join("__values", "\n\n")),
    )
    wide = merged.groupBy(key).agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("__column") == i, F.col("__text"))), F.lit("")
            ).alias(c)
            for i, c in enumerate(content)
        ]
    )
    extra = {
        c: expression
        for c, expression in {
            position: F.min(position),
            COPIES: F.sum(COPIES) if COPIES in df.columns else None,
        }.items()
        if c in df.columns
    }
    firsts = several.groupBy(key).agg(*[e.alias(c) for c, e in extra.items()])
    rebuilt = firsts.join(wide, key, "left").na.fill("", content)
    same_ids = {
        c: F.col(key) for c in ("incident_number", "plim_incident_id") if c in content
    }
    return singles.unionByName(rebuilt.withColumns(same_ids).select(*df.columns))


# -------------------------------------------------------------------- documents
def column_label(name: str) -> str:
    return name.replace("_", " ").strip().title()


def document_columns(columns: list[str]) -> list[str]:
    """Document order: columns holding a priority token, in token order, then the
    others in schema order."""
    hidden = {*rules.INTERNAL_COLUMNS, "incident_number", "plim_incident_id", POSITION, COPIES}
    shown = [c for c in columns if c not in hidden]

    def rank(column: str) -> int:
        hits = [i for i, token in enumerate(rules.DOCUMENT_TOKENS) if token in column]
        return min(hits, default=len(rules.DOCUMENT_TOKENS))

    return sorted(shown, key=rank)


def case_document(columns: list[str], cleaned: dict[str, str]) -> Column:
    """The whole case as ``Label: value`` lines; long or multi-line values below
    their label; empty values left out.  ``cleaned`` names the cleaned columns."""
    parts = [F.concat(F.lit("Incident ID: "), F.col(cleaned["incident_id"]), F.lit("\n"))]
    for name in document_columns(columns):
        value = F.col(cleaned[name])
        label = column_label(name)
        long = value.contains("\n") | (F.length(value) > rules.DOCUMENT_INLINE_CHARS)
        block = F.concat(F.lit(f"{label}:\n"), value, F.lit("\n"))
        inline = F.concat(F.lit(f"{label}: "), value)
        parts.append(F.when(value != "", F.when(long, block).otherwise(inline)))
    return strip(F.concat_ws("\n", *parts))


def case_store(df: DataFrame) -> DataFrame:
    """Parent rows: the document, its length, contract columns first."""
    columns = [c for c in df.columns if c not in (POSITION, COPIES)]
    shown = list(dict.fromkeys(["incident_id", *document_columns(columns)]))
    cleaned = {c: f"__clean_{c}" for c in shown}
    documented = (
        df.withColumns({cleaned[c]: clean_text(F.col(c)) for c in shown})
        .withColumn("case_document", case_document(columns, cleaned))
        .withColumn("comment_length", F.length("case_document"))
    )
    first = [c for c in rules.CASE_FIRST_COLUMNS if c in documented.columns]
    rest = [c for c in columns if c not in first]
    return documented.select(*first, *rest)


# ------------------------------------------------------------------- statistics
def ingest_stats(
    raw: DataFrame, columns: int, distinct: DataFrame, assigned: DataFrame, merged: DataFrame,
    chunks: DataFrame,
) -> DataFrame:
    """One row of counts per ingest: raw, exact copies, merged, generated, final.

    Counts of the stages are scalar subqueries of one plan, each a partial
    aggregation; equal sub-plans are computed once.
    """
    rows = F.count(F.lit(1))
    copies = distinct.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0))).scalar()
    generated = F.count_if(F.col("incident_id").startswith(rules.GENERATED_ID_PREFIX))
    repeats = assigned.agg(rows - F.count_distinct("incident_id")).scalar()
    return raw.agg(rows.alias("raw_rows")).select(
        "raw_rows",
        F.lit(columns).cast("bigint").alias("raw_columns"),
        copies.cast("bigint").alias("exact_duplicate_rows_removed"),
        repeats.cast("bigint").alias("duplicate_case_ids_merged"),
        assigned.agg(generated).scalar().alias("generated_case_ids"),
        merged.agg(rows).scalar().alias("final_case_rows"),
        chunks.agg(rows).scalar().alias("chunks_created"),
    )


# ---------------------------------------------------------------------- reading
def expand_case(cases: DataFrame) -> DataFrame:
    """Cases as read back: nulls become ``""`` where text, JSON columns are parsed,
    text that is no JSON gives an empty map or list.  A merged case has several raw
    rows, so ``raw_fields`` is a list of maps."""
    empty = F.create_map().cast("map<string,string>")
    texts = {
        name: F.coalesce(F.col(name), F.lit(""))
        for name, kind in cases.dtypes
        if kind == "string"
    }
    raw = F.col("raw_fields_json")
    listed = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    names, rows = F.array().cast("array<string>"), F.array().cast("array<map<string,string>>")
    parsed = {
        target: F.coalesce(F.from_json(text, kind), fallback)
        for source, text, target, kind, fallback in [
            ("raw_fields_json", listed, "raw_fields", "array<map<string,string>>", rows),
            ("source_schema_json", F.col("source_schema_json"), "source_schema",
             "array<string>", names),
            ("source_column_mapping_json", F.col("source_column_mapping_json"),
             "source_column_mapping", "map<string,string>", empty),
        ]
        if source in cases.columns
    }
    return cases.withColumns(texts).withColumns(parsed)
