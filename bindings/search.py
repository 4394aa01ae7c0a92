"""Search over ``embeddings`` and benchmarks over ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.common import Registry, fresh_folder, table
from faultline import rules
from faultline.operators import benchmarks as b
from faultline.operators import case_index, pivot_search, search
from faultline.plans.evidence import history_evidence as past_incidents
from faultline.plans.retrieve import matched_chunks, retrieve

REGISTRY = Registry()
query = REGISTRY.query


# ------------------------------------------------------- vectors: chunks and queries
def vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector is a chunk; five vectors in a row belong to one case."""
    rows = table(spark, folder, "embeddings")
    case = F.concat(F.lit("CASE_"), F.floor(F.col("vec_id") / 5).cast("string"))
    return rows.select(
        F.col("vec_id").alias("chunk_id"), case.alias("incident_id"), "embedding", "label"
    )


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean vector of the label."""
    rows = table(spark, folder, "embeddings")
    values = rows.select("label", F.posexplode("embedding").alias("place", "value"))
    exact = F.sum(F.col("value").cast("decimal(38,12)")).cast("double")
    means = values.groupBy("label", "place").agg((exact / F.count("value")).alias("mean"))
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]
    )
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))


HITS_SQL = """
    values_ as (select vec_id, label, unnest(embedding) as value,
                       unnest(generate_series(1, len(embedding))) as place from embeddings),
    means as (select label as query_id, place,
                     sum(value::decimal(38,12))::double / count(*) as mean
              from values_ group by 1, 2),
    distances as (select query_id, vec_id as chunk_id,
                         sum((value::double - mean) * (value::double - mean)) as distance
                  from values_ join means using (place) group by 1, 2),
    ranked as (select *, row_number() over (partition by query_id order by distance, chunk_id)
                      as semantic_rank from distances),
    hits as (select * from ranked where semantic_rank <= 28),
    cases_ as (select query_id, 'CASE_' || (chunk_id // 5) as case_id,
                      min(semantic_rank) as best_rank from hits group by 1, 2),
    ordered as (select *, row_number() over (partition by query_id order by best_rank)
                       as case_rank from cases_)"""

K = rules.EVIDENCE_TOP_K


def hits(spark: SparkSession, folder: str) -> DataFrame:
    chunks = vector_chunks(spark, folder)
    return matched_chunks(label_queries(spark, folder), chunks, K, rules.CANDIDATE_MULTIPLIER)


@query(
    "JON-08 WIN-04 SRT-01",
    f"with {HITS_SQL} select query_id, chunk_id, semantic_rank, "
    "round(distance, 6) as semantic_distance from hits",
)
def nearest_chunks(spark, folder):
    return hits(spark, folder).select(
        "query_id", "chunk_id", F.col("semantic_rank").cast("bigint").alias("semantic_rank"),
        F.round("semantic_distance", 6).alias("semantic_distance"),
    )


FIFTIETH_SQL = """asked as (select vec_id as query_id, embedding from embeddings where vec_id % 50 = 0),
    distances as (select query_id, vec_id as chunk_id, list_sum(list_transform(list_zip(a.embedding, e.embedding),
            lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as distance
        from asked a, embeddings e),
    ranked as (select *, row_number() over (partition by query_id order by distance, chunk_id) as semantic_rank
        from distances)"""
FIFTIETH = (
    f"with {FIFTIETH_SQL} select query_id, chunk_id, semantic_rank, round(distance, 6) as semantic_distance "
    "from ranked where semantic_rank <= 10"
)


def fiftieth_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def ranked_hits(found: DataFrame) -> DataFrame:
    return search.rank_hits(found, 10).select(
        "query_id", "chunk_id", F.col("semantic_rank").cast("bigint").alias("semantic_rank"),
        F.round("semantic_distance", 6).alias("semantic_distance"),
    )


@query("JON-08 SRT-01", FIFTIETH)
def nearest_by_blocks(spark, folder):
    """Every fiftieth vector asks all vectors, in blocks of four queries."""
    chunks, asked = vector_chunks(spark, folder), fiftieth_queries(spark, folder)
    return ranked_hits(search.nearest(asked, chunks, 10, block_queries=4))


@query("JON-08 SRT-01", FIFTIETH)
def nearest_by_pivots(spark, folder):
    """Every fiftieth vector asks all vectors, through pivots."""
    index = pivot_search.build_index(vector_chunks(spark, folder), fresh_folder(spark, "pivots"), 64)
    return ranked_hits(pivot_search.nearest_by_pivots(fiftieth_queries(spark, folder), index, 10))


@query(
    "WIN-05 SRT-02 WIN-10",
    f"with {HITS_SQL} select query_id, case_id, best_rank, case_rank, "
    "round(1 - (case_rank - 1) * 0.05, 4)::double as similarity from ordered where case_rank <= 7",
)
def unique_top_cases(spark, folder):
    top = search.top_cases(search.unique_cases(hits(spark, folder)), K)
    return top.select(
        "query_id", "case_id",
        F.col("best_rank").cast("bigint").alias("best_rank"),
        F.col("case_rank").cast("bigint").alias("case_rank"),
        search.rank_similarity(F.col("case_rank")).alias("similarity"),
    )


def vector_cases(spark: SparkSession, folder: str) -> DataFrame:
    """One stored case per five vectors, with a label count and a vector count."""
    chunks = vector_chunks(spark, folder)
    return chunks.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("vectors"),
        F.min("label").cast("string").alias("category"),
        F.min("chunk_id").alias("first_chunk"),
    ).withColumn("issue_title", F.concat(F.lit("case from "), F.col("first_chunk").cast("string")))


CASES_SQL = """select 'CASE_' || (vec_id // 5) as incident_id, count(*) as vectors,
    min(label)::varchar as category, 'case from ' || min(vec_id) as issue_title
    from embeddings group by 1"""


@query(
    "JON-04 JON-08 WIN-04 WIN-05 SRT-01 SRT-02 PRJ-17",
    f"with {HITS_SQL}, stored as ({CASES_SQL}) select query_id, case_rank, incident_id, category, "
    "issue_title, vectors from ordered join stored on case_id = incident_id where case_rank <= 5",
)
def retrieved_cases(spark, folder):
    found = retrieve(
        label_queries(spark, folder), vector_chunks(spark, folder), vector_cases(spark, folder)
    )
    return found.select(
        "query_id", F.col("case_rank").cast("bigint").alias("case_rank"), "incident_id",
        "category", "issue_title", "vectors",
    )


@query(
    "SRT-05",
    f"with {HITS_SQL} select query_id, string_agg(case_rank || ':' || case_id, ' ' order by case_rank) "
    "as incidents from ordered where case_rank <= 3 group by 1",
)
def leading_incidents(spark, folder):
    cases = search.unique_cases(hits(spark, folder)).drop("best_rank")
    shown = F.transform(
        "incidents", lambda x: F.concat_ws(":", x["case_rank"].cast("string"), x["case_id"])
    )
    return search.top_incidents(cases).select(
        "query_id", F.array_join(shown, " ").alias("incidents")
    )


# ------------------------------------------------------------- lookup by many ids
def ticketed_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("incident_id"),
        F.col("source").alias("ticket_id"),
        F.col("lang").alias("issue_id"),
        "n_chars",
    )


@query(
    "JON-04",
    """with wanted as (select l.doc_id, case when quality = 1 then 'D' || l.doc_id
                              when toxic = 1 then lang else source end as case_id
                       from labels l join documents using (doc_id)),
        places as (select 'D' || doc_id as id, 0 as priority, 'D' || doc_id as incident_id, n_chars from documents
            union all select source, 1, 'D' || doc_id, n_chars from documents
            union all select lang, 2, 'D' || doc_id, n_chars from documents)
        select w.doc_id, w.case_id, p.incident_id, p.n_chars from wanted w join places p on p.id = w.case_id
        qualify row_number() over (partition by w.doc_id order by p.priority, p.incident_id) = 1""",
)
def looked_up_cases(spark, folder):
    wanted = wanted_cases(spark, folder)
    found = search.lookup_cases(ticketed_documents(spark, folder), wanted, F.xxhash64("doc_id"))
    return found.select("doc_id", "case_id", "incident_id", "n_chars")


def wanted_cases(spark, folder):
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.concat(F.lit("D"), F.col("doc_id").cast("string")))
        .when(F.col("toxic") == 1, F.col("lang"))
        .otherwise(F.col("source"))
        .alias("case_id"),
    )


@query("JON-04", REGISTRY.sql["looked_up_cases"])
def indexed_cases(spark, folder):
    """The same lookup through an index of the ids, which is written first."""
    index = case_index.write_case_index(ticketed_documents(spark, folder), fresh_folder(spark, "case-index"), 16)
    found = index.lookup(wanted_cases(spark, folder), F.xxhash64("doc_id"))
    return found.select("doc_id", "case_id", "incident_id", "n_chars")


@query(
    "PRJ-18",
    "select event_id, event_type || ' ' || props as query_text from events",
)
def search_texts(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        "event_id", search.query_text(F.col("event_type"), F.col("props")).alias("query_text")
    )


# --------------------------------------------------------------------- benchmarks
def line_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as stored cases, all text: quantity is the volume, price the
    throughput, tax and discount the improvements, order key and line the rank."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, folder, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )

    def text(column: str):
        return F.col(column).cast("bigint").cast("string")

    return lines.select(
        F.col("o_custkey").alias("query_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_rank"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("incident_id"),
        text("l_quantity").alias("record_volume"),
        F.when(F.col("l_linestatus") == "F", text("l_extendedprice")).otherwise("n/a").alias("rows_per_second"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(
            (F.round(F.col("l_tax") * 100).cast("bigint")).cast("string")).alias("elapsed_seconds"),
        F.round(F.col("l_discount") * 100).cast("bigint").cast("string").alias("fix_reduced_time_by_pct"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("insert_method"),
        F.concat(text("l_quantity"), F.lit(".7")).alias("batch_size"),
        F.col("o_orderpriority").alias("priority"),
        F.concat_ws(" ", F.lit("fix"), "l_suppkey", "l_partkey").alias("fix_applied"),
    )


LINES_SQL = """lines as (select o_custkey as query_id, l_orderkey * 10 + l_linenumber as case_rank,
    l_orderkey || '-' || l_linenumber as incident_id,
    l_quantity::bigint as record_volume,
    case when l_linestatus = 'F' then trunc(l_extendedprice) else 0 end as rows_per_second,
    case when l_returnflag = 'R' then 0 else round(l_tax * 100) end as elapsed_seconds,
    round(l_discount * 100) as fix_reduced_time_by_pct,
    case when l_returnflag = 'N' then '' else l_returnflag end as insert_method,
    l_quantity::bigint as batch_size, o_orderpriority as priority,
    'fix ' || l_suppkey || ' ' || l_partkey as fix_applied
    from lineitem join orders on l_orderkey = o_orderkey)"""

RUNS_SQL = """runs as (select o_custkey as query_id,
    case when count(*) % 3 = 0 then 0 else max(o_totalprice)::bigint // 10000 end as current_volume
    from orders group by 1)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Volume of each customer's current run; unknown (0) for a third of them."""
    top = F.floor(F.round(F.max("o_totalprice")) / 10000)
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("query_id"))
        .agg(F.when(F.count(F.lit(1)) % 3 == 0, 0).otherwise(top).cast("bigint").alias("current_volume"))
    )


BAND_SQL = f"""{LINES_SQL}, {RUNS_SQL},
    perf as (select * from lines where rows_per_second > 0 or elapsed_seconds > 0),
    marked as (select p.*, current_volume, coalesce(current_volume > 0 and
        abs(record_volume - current_volume) <= current_volume * 0.5, false) as volume_matched
        from perf p join runs using (query_id)),
    band as (select * from (select *, max(volume_matched::int) over (partition by query_id) as any_
        from marked) where volume_matched or any_ = 0)"""


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The same order lines as typed incident records."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )

    def hundredths(column: str):
        return F.floor(F.col(column) * 100 + 0.5).cast("double")

    return lines.select(
        F.col("o_custkey").alias("query_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_rank"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("incident_id"),
        F.col("l_quantity").cast("bigint").alias("record_volume"),
        F.when(F.col("l_linestatus") == "F", F.floor("l_extendedprice").cast("double"))
        .otherwise(0.0).alias("rows_per_second"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(hundredths("l_tax")).alias("elapsed_seconds"),
        hundredths("l_discount").alias("fix_reduced_time_by_pct"),
        F.lit(0.0).alias("estimated_improvement_pct"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("insert_method"),
        F.col("l_quantity").cast("bigint").alias("batch_size"),
        F.concat_ws(" ", F.lit("fix"), "l_suppkey", "l_partkey").alias("fix_applied"),
    )


def banded(spark: SparkSession, folder: str) -> DataFrame:
    return b.volume_band(
        incidents(spark, folder), runs(spark, folder), "query_id", F.xxhash64("incident_id")
    )


@query(
    "PRJ-16",
    f"with {LINES_SQL} select query_id, incident_id, record_volume, rows_per_second::double as rows_per_second, "
    "elapsed_seconds::double as elapsed_seconds, batch_size, priority, '' as root_cause, "
    "0::bigint as recurrence_count, 0::double as sla_breached_by_seconds from lines",
)
def incident_records(spark, folder):
    return b.to_incident(line_cases(spark, folder)).select(
        "query_id", "incident_id", "record_volume", "rows_per_second", "elapsed_seconds",
        "batch_size", "priority", "root_cause", "recurrence_count", "sla_breached_by_seconds",
    )


@query(
    "FIL-06",
    f"with {LINES_SQL} select query_id, count(*) as perf_cases from lines "
    "where rows_per_second > 0 or elapsed_seconds > 0 group by 1",
)
def performance_cases(spark, folder):
    return b.perf_cases(incidents(spark, folder)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("perf_cases")
    )


@query(
    "JON-05",
    f"with {BAND_SQL} select query_id, incident_id, record_volume, current_volume, volume_matched from band",
)
def volume_band(spark, folder):
    return banded(spark, folder).select(
        "query_id", "incident_id", "record_volume", "current_volume", "volume_matched"
    )


def _avg(column: str) -> str:
    kept = f"case when {column} > 0 then {column}::decimal(38,6) end"
    return f"coalesce(sum({kept})::double / nullif(count({kept}), 0), 0)::double"


BENCH_SQL = f"""bench as (select query_id, count(*) as benchmark_incident_count,
    {_avg('elapsed_seconds')} as avg_elapsed_seconds,
    coalesce(min(case when elapsed_seconds > 0 then elapsed_seconds end), 0)::double as best_elapsed_seconds,
    coalesce(max(case when elapsed_seconds > 0 then elapsed_seconds end), 0)::double as worst_elapsed_seconds,
    {_avg('rows_per_second')} as avg_rows_per_second,
    coalesce(max(case when rows_per_second > 0 then rows_per_second end), 0)::double as best_rows_per_second,
    {_avg('fix_reduced_time_by_pct')} as avg_improvement_pct,
    0::double as avg_estimated_improvement, bool_or(volume_matched) as volume_matched
    from band group by 1)"""


@query("AGG-10 FIL-07", f"with {BAND_SQL}, {BENCH_SQL} select * from bench")
def run_benchmarks(spark, folder):
    cases = incidents(spark, folder).join(runs(spark, folder), "query_id")
    return b.benchmarks(cases, ["query_id"], digits=None)


METHOD_SQL = """method as (select query_id, coalesce(first(insert_method order by n desc, insert_method)
    filter (insert_method <> ''), 'Unknown') as common_insert_method
    from (select query_id, insert_method, count(*) as n from band group by 1, 2) group by 1),
    batch as (select query_id, coalesce(first(batch_size order by n desc, batch_size)
    filter (batch_size > 0), 0) as common_batch_size
    from (select query_id, batch_size, count(*) as n from band group by 1, 2) group by 1)"""


@query(
    "AGG-11",
    f"with {BAND_SQL}, {METHOD_SQL} select * from method join batch using (query_id)",
)
def common_settings(spark, folder):
    cases = banded(spark, folder)
    methods = b.common_value(cases, "insert_method", ["query_id"], F.lit("Unknown"))
    batches = b.common_value(
        cases, "batch_size", ["query_id"], F.lit(0).cast("bigint"), F.col("batch_size") > 0
    )
    return methods.join(batches, "query_id")


FIX_SQL = """fix as (select query_id, coalesce(first(fix_applied order by fix_reduced_time_by_pct desc,
    case_rank, fix_applied desc) filter (fix_reduced_time_by_pct > 0), '') as most_successful_fix from band group by 1)"""


@query("AGG-12", f"with {BAND_SQL}, {FIX_SQL} select * from fix")
def best_fixes(spark, folder):
    return b.best_fix(banded(spark, folder), ["query_id"], F.col("case_rank"))


@query(
    "AGG-10 AGG-11 AGG-12 JON-05",
    f"with {BAND_SQL}, {BENCH_SQL}, {METHOD_SQL}, {FIX_SQL} select * exclude (volume_matched) "
    "from bench join method using (query_id) join batch using (query_id) join fix using (query_id)",
)
def full_benchmarks(spark, folder):
    cases = banded(spark, folder).drop("current_volume")
    full = b.full_benchmarks(cases, ["query_id"], F.col("case_rank"), digits=None)
    return full.drop("volume_matched")


@query(
    "JON-04 JON-05 JON-08 PRJ-16 AGG-10 AGG-11 AGG-12 FIL-09",
    f"""with {HITS_SQL.replace("label, unnest", "label, vec_id // 5 % 2 as half, unnest").replace(
        "group by 1, 2),\n    ranked", "where half = 0 group by 1, 2),\n    ranked")},
    stored as (select vec_id // 5 as n, count(*) as vectors from embeddings group by 1),
    found as (select query_id, case_rank, case_id, n % 60 as volume, (n % 7)::double as speed,
        (n % 3)::double as seconds, case n % 3 when 0 then 'copy' when 1 then 'insert' else '' end as method,
        (n % 11)::double as gain, 'fix ' || n as fix, query_id * 7 % 60 as current_volume
        from ordered join stored on case_id = 'CASE_' || n where case_rank <= 7),
    perf as (select *, current_volume > 0 and abs(volume - current_volume) <= current_volume * 0.5 as near
        from found where speed > 0 or seconds > 0),
    band as (select * from (select *, max(near::int) over (partition by query_id) as any_ from perf)
        where near or any_ = 0),
    methods as (select query_id, first(method order by c desc, method) as common_insert_method
        from (select query_id, method, count(*) as c from band where method <> '' group by 1, 2) group by 1),
    marks as (select query_id, count(*) as benchmark_incident_count,
        coalesce(sum(speed) / nullif(count(*) filter (speed > 0), 0), 0)::double as avg_rows_per_second,
        coalesce(max(speed) filter (speed > 0), 0)::double as best_rows_per_second,
        bool_or(near) as volume_matched,
        coalesce(first(fix order by gain desc, case_rank) filter (gain > 0), '') as most_successful_fix
        from band group by 1)
    select q.query_id, coalesce(incidents_found, 0) as incidents_found, top_match_id, top_similarity,
        benchmark_incident_count is not null as has_benchmarks, benchmark_incident_count, avg_rows_per_second,
        best_rows_per_second, volume_matched,
        case when benchmark_incident_count is not null then coalesce(common_insert_method, 'Unknown') end
            as common_insert_method, most_successful_fix
    from (select distinct label as query_id from embeddings) q
    left join (select query_id, count(*) as incidents_found, first(case_id order by case_rank) as top_match_id,
        max(round(1 - (case_rank - 1) * 0.05, 4))::double as top_similarity from found group by 1) f using (query_id)
    left join marks using (query_id) left join methods using (query_id)""",
)
def history_evidence(spark, folder):
    """Label means search the half of the vectors that belongs to the dataset of even cases."""
    number = F.floor(F.col("vec_id") / 5)
    rows = table(spark, folder, "embeddings")
    chunks = rows.select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("CASE_"), number.cast("string")).alias("incident_id"),
        "embedding",
        F.when(number % 2 == 0, "even").otherwise("odd").alias("source_dataset"),
    )
    case = F.col("n")
    cases = rows.groupBy(number.alias("n")).agg(F.count(F.lit(1)).alias("vectors")).select(
        F.concat(F.lit("CASE_"), case.cast("string")).alias("incident_id"),
        (case % 60).cast("string").alias("record_volume"),
        (case % 7).cast("string").alias("rows_per_second"),
        (case % 3).cast("string").alias("elapsed_seconds"),
        F.when(case % 3 == 0, "copy").when(case % 3 == 1, "insert").otherwise("").alias("insert_method"),
        (case % 11).cast("string").alias("fix_reduced_time_by_pct"),
        F.concat(F.lit("fix "), case.cast("string")).alias("fix_applied"),
    )
    asked = label_queries(spark, folder).withColumn(
        "current_volume", (F.col("query_id") * 7 % 60).cast("bigint")
    )
    return past_incidents(asked, chunks, cases, "even", K, digits=None).select(
        "query_id", "incidents_found", "top_match_id", "top_similarity", "has_benchmarks",
        "benchmark_incident_count", "avg_rows_per_second", "best_rows_per_second", "volume_matched",
        "common_insert_method", "most_successful_fix",
    )
