"""Case ingestion over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.common import Registry, fresh_folder, table
from faultline.functions.text import clean_text
from faultline.operators import cases as c
from faultline.operators import chunks as ch
from faultline.operators import sinks
from faultline.operators.chunk_store import bucket_number, read_store, write_chunks
from faultline.plans.ingest import Prepared, ingest, prepare
from faultline.sources import tables
from faultline.sources.incidents import POSITION, read_incidents

REGISTRY = Registry()
query = REGISTRY.query

_WS = r"\t\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A[\n{_WS}]+|[\n{_WS}]+\z', '', 'g')"


def clean_sql(x: str) -> str:
    ends = rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
    spaces = rf"regexp_replace({ends}, '[ \t]+', ' ', 'g')"
    edges = rf"regexp_replace({spaces}, '(?m)^[{_WS}]+|[{_WS}]+$', '', 'g')"
    blank = rf"regexp_replace({edges}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(blank)


def chunk_list_sql(text: str, size: int = 1200, overlap: int = 200) -> str:
    step = size - overlap
    pieces = (
        f"list_filter(list_transform(generate_series(1, length({text}), {step}), "
        f"lambda s: {strip_sql(f'substring({text}, s, {size})')}), lambda p: p <> '')"
    )
    return f"case when length({text}) <= {size} then [{text}] else {pieces} end"


# ------------------------------------------------------------ documents as cases
def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", clean_text(F.col("text")).alias("text"), "lang", "source")


@query("PRJ-03", f"select doc_id, {clean_sql('text')} as clean_text from documents")
def clean_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("clean_text"))
    return c.clean_cells(docs, ["clean_text"])


DISTINCT_SQL = (
    f"select text, lang, min(doc_id) as doc_id, count(*) as copies from "
    f"(select {clean_sql('text')} as text, lang, doc_id from documents) group by text, lang"
)


@query("AGG-01", DISTINCT_SQL)
def exact_duplicates(spark, folder):
    rows = document_rows(spark, folder)
    return c.drop_exact(rows, ["text", "lang"], "doc_id").withColumnRenamed(c.COPIES, "copies")


@query(
    "PRJ-03 AGG-01 PRJ-12 PRJ-13 WIN-09",
    f"select lang, sum(len({chunk_list_sql('text')}))::bigint as chunks, "
    f"count(*) as documents from ({DISTINCT_SQL}) group by lang",
)
def chunks_per_language(spark, folder):
    rows = document_rows(spark, folder)
    distinct = c.drop_exact(rows, ["text", "lang"], "doc_id")
    pieces = ch.chunk_documents(
        distinct.select("doc_id", "text", "lang"), document="text", key="doc_id"
    )
    return pieces.groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("chunk_index") == 0).alias("documents"),
    )


CHUNKS_SQL = (
    "select doc_id || '_chunk_' || (i - 1) as chunk_id, (i - 1)::int as chunk_index, "
    "len(pieces)::int as total_chunks, pieces[i] as chunk_text from "
    "(select doc_id, pieces, unnest(generate_series(1, len(pieces))) as i from "
    f"(select doc_id, {chunk_list_sql('text')} as pieces from "
    f"(select doc_id, {clean_sql('text')} as text from documents)))"
)


@query("PRJ-12 PRJ-13 WIN-09", CHUNKS_SQL)
def document_chunks(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ch.chunk_documents(docs, document="text", key="doc_id").drop("doc_id")


@query(
    "PRJ-01 PRJ-02",
    "select doc_id, n_chars as doc_id_2, lang as source, source as source_2, "
    "text as column from documents",
)
def normalized_names(spark, folder):
    docs = table(spark, folder, "documents")
    clashing = docs.select("doc_id", "n_chars", "lang", "source", "text").toDF(
        "Doc ID", "doc-id", " SOURCE ", "source", "***"
    )
    return c.normalize_columns(clashing)[0]


# -------------------------------------------------- an incident dataset of its own
def incident_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw incidents: labelled documents come in pairs of one ticket, the others
    have no ticket; headers as a person would write them."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    ticket = F.concat(F.lit("T"), F.floor(F.col("doc_id") / 2).cast("string"))
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.when(F.col("quality").isNull(), "").otherwise(ticket).alias("Ticket ID"),
        F.concat(F.lit("P"), F.coalesce(F.col("quality").cast("string"), F.lit("?"))).alias("Priority"),
        F.when(F.col("toxic") == 1, "blocked").otherwise("").alias("Status"),
        F.col("lang").alias("Category"),
        F.col("source").alias("Source System"),
        F.col("text").alias("Root Cause"),
        F.col("doc_id").alias(POSITION),
    )


COLUMNS = ["ticket_id", "priority", "status", "category", "source_system", "root_cause"]
RAW_SQL = f"""
    select case when quality is null then '' else 'T' || (doc_id // 2) end as ticket_id,
           'P' || coalesce(quality::varchar, '?') as priority,
           case when toxic = 1 then 'blocked' else '' end as status,
           lang as category, source as source_system,
           {clean_sql('text')} as root_cause, doc_id as pos
    from documents left join labels using (doc_id)"""
ROWS_SQL = f"""
    select {', '.join(COLUMNS)}, min(pos) as pos, count(*) as copies
    from ({RAW_SQL}) group by all"""
_JSON_SQL = "to_json({" + ", ".join(f"'{x}': {x}" for x in sorted(COLUMNS)) + "})::varchar"
ASSIGNED_SQL = f"""
    select *, case when ticket_id = ''
                   then 'GENERATED_CASE_' || substring(sha256(raw_fields_json), 1, 16)
                   else ticket_id end as incident_id
    from (select *, {_JSON_SQL} as raw_fields_json from ({ROWS_SQL}))"""


def merged_column_sql(name: str) -> str:
    # the first position of each distinct value orders the values
    return f"""coalesce((select string_agg(v, chr(10) || chr(10) order by p) from
        (select {name} as v, min(pos) as p from assigned a
         where a.incident_id = ids.incident_id and {name} <> '' group by 1)), '') as {name}"""


def merged_sql() -> str:
    parts = []
    for name in COLUMNS:
        parts.append(f"""
        m_{name} as (select incident_id, string_agg(v, chr(10) || chr(10) order by p) as {name}
            from (select incident_id, {name} as v, min(pos) as p from assigned
                  where {name} <> '' group by 1, 2) group by 1)""")
    joins = " ".join(f"left join m_{n} using (incident_id)" for n in COLUMNS)
    fields = ", ".join(f"coalesce({n}, '') as {n}" for n in COLUMNS)
    return f"""
    assigned as ({ASSIGNED_SQL}),
    ids as (select incident_id, min(pos) as pos, count(*) as merged_rows,
                   case when count(*) = 1 then min(raw_fields_json)
                        else '[' || string_agg(raw_fields_json, ',' order by pos) || ']' end
                        as raw_fields_json
            from assigned group by 1),
    {','.join(parts)},
    merged as (select incident_id, pos, raw_fields_json, {fields} from ids {joins})"""


def stages(spark: SparkSession, folder: str) -> Prepared:
    """The stages of an ingest, with the distinct rows written to the shared folder."""
    staged = fresh_folder(spark, "distinct-rows")
    return prepare(incident_rows(spark, folder), "shared_documents", staged=staged)


@query("AGG-04", f"select 'ticket_id' as id_column, count(*) as rows, "
       f"count(*) filter (ticket_id <> '') as with_id from ({RAW_SQL})")
def chosen_id_column(spark, folder):
    named, _ = c.normalize_columns(incident_rows(spark, folder))
    cleaned = c.clean_cells(named, c.source_columns(named))
    chosen = c.choose_case_id(cleaned)
    return cleaned.groupBy(F.lit(chosen).alias("id_column")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(chosen) != "").alias("with_id")
    )


@query("PRJ-04 PRJ-06", f"select incident_id, raw_fields_json, pos from ({ASSIGNED_SQL})")
def case_ids(spark, folder):
    rows = stages(spark, folder).assigned
    return rows.select("incident_id", "raw_fields_json", F.col(POSITION).alias("pos"))


_SCHEMA_JSON = c.sorted_json(COLUMNS)
_MAPPING_JSON = c.sorted_json(
    {"Ticket ID": "ticket_id", "Priority": "priority", "Status": "status",
     "Category": "category", "Source System": "source_system", "Root Cause": "root_cause"}
)


@query(
    "PRJ-08",
    f"""select incident_id, incident_id as incident_number, incident_id as plim_incident_id,
        'ticket_id' as rag_case_id_source_column, 'shared_documents' as source_dataset,
        '{_SCHEMA_JSON}' as source_schema_json, '{_MAPPING_JSON}' as source_column_mapping_json,
        substring(sha256('{_SCHEMA_JSON}'), 1, 16) as schema_signature
        from ({ASSIGNED_SQL})""",
)
def contract_columns(spark, folder):
    return stages(spark, folder).assigned.select(
        "incident_id", "incident_number", "plim_incident_id", "rag_case_id_source_column",
        "source_dataset", "source_schema_json", "source_column_mapping_json", "schema_signature",
    )


@query(
    "PRJ-07",
    "select 'D' || doc_id as incident_id, source as source_original_incident_id, lang "
    "from documents",
)
def displaced_ids(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.select(
        F.col("source").alias("incident_id"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("case_id"),
        "lang",
    )
    assigned = c.assign_case_id(rows, rows.columns, "case_id", {})
    return assigned.select("incident_id", "source_original_incident_id", "lang")


@query("AGG-02", f"with {merged_sql()} select * from merged")
def merged_cases(spark, folder):
    rows = stages(spark, folder).merged
    return rows.select("incident_id", F.col(POSITION).alias("pos"), "raw_fields_json", *COLUMNS)


STATS_FIELDS = """
    (select count(*) from documents) as raw_rows, 6::bigint as raw_columns,
    (select sum(copies - 1) from assigned)::bigint as exact_duplicate_rows_removed,
    (select count(*) - count(distinct incident_id) from assigned) as duplicate_case_ids_merged,
    (select count(*) from assigned where ticket_id = '') as generated_case_ids,
    (select count(*) from merged) as final_case_rows"""
STATS_SQL = f"with {merged_sql()} select {STATS_FIELDS}"


@query("AGG-03", STATS_SQL)
def ingest_statistics(spark, folder):
    s = stages(spark, folder)
    chunks = ch.chunk_rows(c.case_store(s.merged))
    stats = c.ingest_stats(s.raw, len(s.columns), s.distinct, s.assigned, s.merged, chunks)
    return stats.drop("chunks_created")


# order of the lines: tokens first (ticket_id, priority, status, root_cause), then the rest
_DOCUMENT = [("incident_id", "Incident Id"), ("ticket_id", "Ticket Id"), ("priority", "Priority"),
             ("status", "Status"), ("root_cause", "Root Cause"), ("category", "Category"),
             ("source_system", "Source System")]


def document_sql() -> str:
    parts = ["'Incident ID: ' || incident_id || chr(10)"]
    for name, label in _DOCUMENT:
        # a merged cell is cleaned once more, which can only touch its line breaks
        value = clean_sql(name)
        parts.append(
            f"case when {value} <> '' then case when contains({value}, chr(10)) "
            f"or length({value}) > 120 then '{label}:' || chr(10) || {value} || chr(10) "
            f"else '{label}: ' || {value} end end"
        )
    return strip_sql(f"concat_ws(chr(10), {', '.join(parts)})")


STORE_SQL = f"""{merged_sql()}, store as (select incident_id, document as case_document,
    length(document) as comment_length from
    (select incident_id, {document_sql()} as document from merged))"""


@query("PRJ-10 PRJ-11", f"with {STORE_SQL} select * from store")
def case_documents(spark, folder):
    store = c.case_store(stages(spark, folder).merged)
    return store.select(
        "incident_id", "case_document", F.col("comment_length").cast("bigint").alias("comment_length")
    )


@query(
    "PRJ-15",
    f"with {STORE_SQL}, pieces as (select incident_id, {chunk_list_sql('case_document')} as p "
    f"from store) select incident_id || '_chunk_' || (i - 1) as chunk_id, "
    "(i - 1)::varchar as chunk_index, len(p)::varchar as total_chunks, "
    "case when length(priority) between 1 and 300 then priority end as priority, "
    "case when length(status) between 1 and 300 then status end as status, "
    "case when length(source_system) between 1 and 300 then source_system end as source_system, "
    "7 + (length(ticket_id) between 1 and 300)::int + (length(priority) between 1 and 300)::int "
    "+ (length(status) between 1 and 300)::int + (length(category) between 1 and 300)::int "
    "+ (length(source_system) between 1 and 300)::int as entries "
    "from (select incident_id, p, unnest(generate_series(1, len(p))) as i from pieces) "
    "join merged using (incident_id)",
)
def chunk_metadata(spark, folder):
    rows = ch.chunk_rows(c.case_store(stages(spark, folder).merged))
    return rows.select(
        "chunk_id",
        *[F.col("metadata")[k].alias(k)
          for k in ("chunk_index", "total_chunks", "priority", "status", "source_system")],
        F.size("metadata").alias("entries"),
    )


@query(
    "PRJ-17",
    f"""with {merged_sql()}, n as (select incident_id, count(*) as raw_rows from assigned group by 1)
    select incident_id, raw_rows::int as raw_rows, 6 as schema_columns, 6 as mapped_columns,
           (select a.source_system from assigned a where a.incident_id = m.incident_id
            order by a.pos limit 1) as first_source
    from merged m join n using (incident_id)""",
)
def expanded_cases(spark, folder):
    cases = c.expand_case(c.case_store(stages(spark, folder).merged))
    return cases.select(
        "incident_id",
        F.size("raw_fields").alias("raw_rows"),
        F.size("source_schema").alias("schema_columns"),
        F.size("source_column_mapping").alias("mapped_columns"),
        F.col("raw_fields")[0]["source_system"].alias("first_source"),
    )


# ----------------------------------------------------------------------- stores
@query("SNK-01 SRC-06", f"with {STORE_SQL} select incident_id, comment_length from store")
def stored_cases(spark, folder):
    path = fresh_folder(spark, "cases")
    sinks.write_cases(c.case_store(stages(spark, folder).merged), path)
    cases = tables.read_cases(spark, path)
    return cases.select("incident_id", F.col("comment_length").cast("bigint").alias("comment_length"))


def dataset_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.col("source").alias("source_dataset")
    )
    return ch.chunk_documents(docs, document="text", key="doc_id")


def relabelled_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Toxic documents come again with their verdict in front."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(F.col("toxic") == 1)
    again = docs.join(labels, "doc_id").select(
        "doc_id",
        F.concat(F.lit("TOXIC "), F.col("text")).alias("text"),
        F.col("source").alias("source_dataset"),
    )
    return ch.chunk_documents(again, document="text", key="doc_id")


def _pieces_sql(source: str, text: str, extra: str = "") -> str:
    return (
        "select doc_id || '_chunk_' || (i - 1) as chunk_id, pieces[i] as chunk_text, source_dataset "
        "from (select doc_id, source_dataset, pieces, unnest(generate_series(1, len(pieces))) as i "
        f"from (select doc_id, source_dataset, {chunk_list_sql('t')} as pieces from "
        f"(select doc_id, source as source_dataset, {clean_sql(text)} as t from {source} {extra})))"
    )


OLD_SQL = _pieces_sql("documents", "text")
NEW_SQL = _pieces_sql("documents join labels using (doc_id)", "'TOXIC ' || text", "where toxic = 1")


@query(
    "SNK-02 JON-02 SET-01",
    f"with old as ({OLD_SQL}), new as ({NEW_SQL}) select * from new union all "
    "select * from old where chunk_id not in (select chunk_id from new)",
)
def upserted_chunks(spark, folder):
    """Through the store: the whole of it first, then the relabelled chunks merged in."""
    return _stored_chunks(spark, folder, replace=False)


def whole_store(spark: SparkSession, folder: str) -> str:
    """A store of the chunks of all documents."""
    path = fresh_folder(spark, "chunks")
    buckets = bucket_number(table(spark, folder, "documents").count())
    write_chunks(dataset_chunks(spark, folder), path, buckets=buckets)
    return path


def _stored_chunks(spark: SparkSession, folder: str, replace: bool) -> DataFrame:
    path = whole_store(spark, folder)
    write_chunks(relabelled_chunks(spark, folder), path, reset=False, replace=replace)
    return read_store(spark, path).select("chunk_id", "chunk_text", "source_dataset")


@query(
    "SNK-03",
    f"with old as ({OLD_SQL}), new as ({NEW_SQL}) select * from new union all "
    "select * from old where source_dataset not in (select source_dataset from new)",
)
def replaced_datasets(spark, folder):
    return _stored_chunks(spark, folder, replace=True)


@query(
    "SRC-07 FIL-09",
    f"select count(*) as chunk_count from ({OLD_SQL}) where source_dataset = 'src0'",
)
def chunk_store_count(spark, folder):
    return tables.chunk_count(tables.read_chunks(spark, whole_store(spark, folder), "src0"))


@query(
    "SRC-01",
    f"select ticket_id, priority, status, category, source_system, "
    f"{clean_sql('root_cause')} as root_cause from ({RAW_SQL})",
)
def incident_csv(spark, folder):
    path = fresh_folder(spark, "incidents")
    incident_rows(spark, folder).drop(POSITION).write.option("escape", '"').csv(path, header=True)
    named, _ = c.normalize_columns(read_incidents(spark, path))
    return c.clean_cells(named, COLUMNS).drop(POSITION)


@query(
    "SRC-01 PRJ-11 SNK-01 SNK-03 AGG-03",
    f"with {STORE_SQL} select {STATS_FIELDS}, "
    f"(select sum(len({chunk_list_sql('case_document')})) from store)::bigint as chunks_created",
)
def ingested_dataset(spark, folder):
    """The whole ingest over a CSV export of the shared documents."""
    path = fresh_folder(spark, "ingest")
    # a file is one task of the reader, so files are kept small
    rows = incident_rows(spark, folder).drop(POSITION).write.option("maxRecordsPerFile", 20_000)
    rows.option("escape", '"').csv(f"{path}/csv", header=True)
    return ingest(spark, f"{path}/csv", f"{path}/cases", f"{path}/chunks", f"{path}/stage")

