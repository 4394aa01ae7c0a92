"""Loads, audits and products over ``orders``, ``lineitem``, ``part`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.common import Registry, fresh_folder, table
from faultline import rules
from faultline.operators import audit, loads, rca, sinks
from faultline.plans.load import export_products, load_products
from faultline.plans.load import rejected_products as refused_products
from faultline.sources import tables

REGISTRY = Registry()
query = REGISTRY.query


# ------------------------------------------------------------------- load progress
def load_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each order is a chunk of its customer's load; days since 1995 are seconds."""
    return table(spark, folder, "orders").select(
        F.lit("d").alias("dag_id"),
        F.lit("t").alias("task_id"),
        F.col("o_custkey").alias("run_id"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("chunk_no"),
        F.trunc("o_orderdate", "quarter").alias("quarter"),
        F.floor("o_totalprice").cast("bigint").alias("chunk_rows"),
        F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("elapsed_seconds"),
        F.lit(2_000_000).cast("bigint").alias("total_rows"),
        F.lit(1500).cast("bigint").alias("sla_threshold"),
        F.lit(rules.LOAD_CHUNK_ROWS).cast("bigint").alias("chunk_size"),
        F.lit(rules.LOAD_INSERT_METHOD).alias("insert_method"),
        F.lit("2M").alias("data_volume"),
    )


CHUNKS_SQL = """chunks as (select 'd' as dag_id, 't' as task_id, o_custkey as run_id,
    o_orderdate::date as day, o_orderkey as chunk_no, floor(o_totalprice)::bigint as chunk_rows,
    date_diff('day', date '1995-01-01', o_orderdate::date)::double as elapsed_seconds,
    2000000 as total_rows, 1500 as sla_threshold from orders),
    progress as (select *, case when elapsed_seconds > 0 then rows_inserted / elapsed_seconds else 0 end
        as rows_per_second, rows_inserted * 100.0::double / total_rows as pct_complete from
        (select *, coalesce(sum(chunk_rows) over (partition by run_id order by day, chunk_no
         rows between unbounded preceding and 1 preceding), 0)::bigint as rows_inserted from chunks)),
    full_progress as (select *, case when rows_per_second > 0 then (total_rows - rows_inserted)
        / rows_per_second else 0 end as eta_seconds from progress),
    breaches as (select * from full_progress where elapsed_seconds > sla_threshold
        qualify row_number() over (partition by run_id order by day, chunk_no) = 1)"""


def progressed(spark: SparkSession, folder: str) -> DataFrame:
    return loads.progress(
        load_chunks(spark, folder), loads.RUN_KEY, "quarter",
        [F.col("day"), F.col("chunk_no")], digits=None,
    )


def breached(spark: SparkSession, folder: str) -> DataFrame:
    return loads.first_breach(
        progressed(spark, folder), loads.RUN_KEY, [F.col("day"), F.col("chunk_no")], digits=None
    )


@query(
    "WIN-07",
    f"with {CHUNKS_SQL} select run_id, chunk_no, rows_inserted, pct_complete, rows_per_second, "
    "eta_seconds from full_progress",
)
def load_progress(spark, folder):
    return progressed(spark, folder).select(
        "run_id", "chunk_no", "rows_inserted", "pct_complete", "rows_per_second", "eta_seconds"
    )


@query(
    "WIN-08",
    f"with {CHUNKS_SQL} select dag_id, task_id, run_id, total_rows::bigint as total_rows, rows_inserted, "
    "pct_complete, elapsed_seconds, rows_per_second, eta_seconds, sla_threshold::bigint as sla_threshold, "
    "elapsed_seconds as sla_breached_at, 10000::bigint as chunk_size, 'execute_values' as insert_method, "
    "'2M' as data_volume from breaches",
)
def first_breaches(spark, folder):
    return breached(spark, folder)


@query(
    "RCA-03",
    f"with {CHUNKS_SQL} select run_id, elapsed_seconds / 60 as elapsed_min, eta_seconds / 60 as eta_min, "
    "elapsed_seconds - sla_threshold as sla_breach_by from breaches",
)
def run_metrics(spark, folder):
    return rca.run_metrics(breached(spark, folder), digits=None).select(
        "run_id", "elapsed_min", "eta_min", "sla_breach_by"
    )


@query(
    "RCA-02",
    f"""with {CHUNKS_SQL}, history as (select o_custkey as run_id, sum(o_totalprice::decimal(18,2))::double
        / count(*) / 100 as average from orders group by 1),
    gaps as (select run_id, case when rows_per_second <> 0 and average <> 0
        then (average - rows_per_second) * 100.0::double / average end as gap_pct
        from breaches join history using (run_id))
    select run_id, gap_pct, case when gap_pct > 10 then 'DEGRADING' when gap_pct < -10 then 'IMPROVING'
        when gap_pct is not null then 'STABLE' end as gap_trend,
        case when gap_pct > 0 then 'slower' when gap_pct is not null then 'faster' end as gap_direction
    from gaps""",
)
def performance_gaps(spark, folder):
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    history = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        (exact / F.count(F.lit(1)) / 100.0).alias("average")
    )
    gap = rca.perf_gap(F.col("rows_per_second"), F.col("average"), digits=None)
    joined = breached(spark, folder).join(history, "run_id")
    return joined.select("run_id", *[value.alias(name) for name, value in gap.items()])


@query(
    "WIN-11",
    "select user_id, event_type, event_id, substr(ts::varchar, 1, 19) as at from events "
    "where event_type in ('error', 'purchase') "
    "qualify row_number() over (partition by user_id order by ts, event_id) = 1",
)
def first_triggers(spark, folder):
    events = table(spark, folder, "events").where(F.col("event_type").isin("error", "purchase"))
    first = loads.first_trigger(events, ["user_id"], [F.col("ts"), F.col("event_id")])
    return first.select(
        "user_id", "event_type", "event_id", F.substring(F.col("ts").cast("string"), 1, 19).alias("at")
    )


# ----------------------------------------------------------------- insert if absent
def finished_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Target of the insert: orders that are finished are in the table already."""
    orders = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    return orders.select(F.col("o_orderkey").alias("l_orderkey"))


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def line_order():
    return [F.col(c.strip()) for c in LINE_ORDER.split(",")]


def line_batch(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )


_FRESH = "l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')"


@query(
    "JON-01",
    f"select l_orderkey, count(*) as lines from lineitem where {_FRESH} group by 1",
)
def absent_rows(spark, folder):
    rows = sinks.absent_rows(finished_orders(spark, folder), line_batch(spark, folder), "l_orderkey")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "WIN-12",
    f"select l_orderkey, {LINE_ORDER} from lineitem qualify row_number() over "
    f"(partition by l_orderkey order by {LINE_ORDER}) = 1",
)
def first_per_key(spark, folder):
    return sinks.first_per_key(line_batch(spark, folder), "l_orderkey", line_order())


@query(
    "SNK-04 JON-01 WIN-12",
    f"select l_orderkey, {LINE_ORDER} from lineitem where {_FRESH} qualify row_number() over "
    f"(partition by l_orderkey order by {LINE_ORDER}) = 1",
)
def inserted_if_absent(spark, folder):
    return sinks.insert_absent(
        finished_orders(spark, folder), line_batch(spark, folder), "l_orderkey", line_order()
    )


@query(
    "SET-02",
    "select case l_returnflag when 'R' then '1M' when 'A' then '2M' else '3M' end as data_volume, "
    "count(*) as rows, sum(l_quantity)::bigint as quantity from lineitem group by 1",
)
def united_loads(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    flags = {"1M": "R", "2M": "A", "3M": "N"}
    rows = loads.union_loads(
        {tag: lines.where(F.col("l_returnflag") == flag) for tag, flag in flags.items()}
    )
    return rows.groupBy("data_volume").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )


# ---------------------------------------------------------------------------- audit
def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("audit_id"),
        F.lit("d").alias("dag_id"),
        F.col("user_id").alias("task_id"),
        F.col("event_type").alias("run_id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        F.floor("value").cast("bigint").alias("records_processed"),
        F.col("props").alias("error_message"),
    )


@query(
    "FIL-01",
    "select event_id as audit_id, user_id as task_id, props as error_message from events "
    "where event_type = 'error'",
)
def failed_audits(spark, folder):
    return audit.failed_audits(audit_rows(spark, folder)).select(
        "audit_id", "task_id", "error_message"
    )


AUDIT_SQL = """audits as (select c_custkey as task_id, audit_id, records_processed, error_message,
    case when audit_id is null then 'NO_FAILURE_FOUND' else 'SUCCESS' end as status,
    case when audit_id is not null then 'FAILED' end as audit_status
    from customer left join (select user_id, event_id as audit_id, floor(value)::bigint as records_processed,
        props as error_message from events where event_type = 'error'
        qualify row_number() over (partition by user_id order by event_id desc) = 1) on user_id = c_custkey)"""


def latest_audits(spark: SparkSession, folder: str) -> DataFrame:
    tasks = table(spark, folder, "customer").select(
        F.lit("d").alias("dag_id"), F.col("c_custkey").alias("task_id")
    )
    return audit.latest_failed(audit_rows(spark, folder), tasks).select(
        "dag_id", "task_id", "audit_id", "records_processed", "error_message", "status", "audit_status"
    )


@query("WIN-01 FIL-01", f"with {AUDIT_SQL} select 'd' as dag_id, * from audits")
def latest_failed_audits(spark, folder):
    return latest_audits(spark, folder)


# ------------------------------------------------------------------------- products
def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as products; the price is unknown (0) for parts of size 1."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("string").alias("supplier_id"),
        F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_retailprice")).alias("cost_price"),
        F.col("p_retailprice").alias("selling_price"),
    )


def product_errors(spark: SparkSession, folder: str) -> DataFrame:
    """An error per event; the product id is text and often unknown or no number."""
    number = F.regexp_extract("props", "[0-9]+", 0)
    return table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", None)
        .when(F.col("event_type") == "view", F.concat(F.lit("x"), number))
        .when(F.col("event_type") == "error", F.concat(number, F.lit("000000")))
        .otherwise(number)
        .alias("product_id"),
    )


_NUMBER = "regexp_extract(props, '[0-9]+', 0)"


@query(
    "JON-07",
    f"""with errors as (select event_id, case event_type when 'click' then null when 'view' then 'x' || {_NUMBER}
        when 'error' then {_NUMBER} || '000000' else {_NUMBER} end as product_id from events)
    select event_id, e.product_id, p_partkey is not null as exists, p_name as product_name, p_brand as brand,
        p_type as category, p_size::varchar as supplier_id,
        case when p_size <> 1 then p_retailprice end as cost_price, p_retailprice as selling_price,
        false as duplicate_detected, (select count(*) from part) as total_rows
    from errors e left join part on p_partkey = try_cast(e.product_id as bigint)""",
)
def product_checks(spark, folder):
    return loads.product_check(
        products(spark, folder), product_errors(spark, folder), F.xxhash64("event_id")
    )


@query(
    "AGG-13",
    "select l_partkey, count(*) as key_rows, count(*) > 1 as duplicate_detected, "
    "(select count(*) from lineitem) as total_rows from lineitem group by 1",
)
def key_counts(spark, folder):
    return loads.key_counts(table(spark, folder, "lineitem").select("l_partkey"), "l_partkey")


# ------------------------------------------------------------- files, tables, sinks
def product_file(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as rows of a product file: all 19 columns, keys that repeat."""
    return table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.col("l_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.lit("").alias("collection"), F.lit("red, \"dark\"").alias("color"),
        F.col("p_size").cast("string").alias("size"), F.lit("u").alias("gender"),
        F.col("p_brand").alias("supplier_id"), F.lit("s").alias("supplier_name"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("cost_price"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("selling_price"),
        F.lit(0.5).alias("discount_pct"), F.col("p_size").alias("inventory_qty"),
        F.lit(3).alias("reorder_level"), F.lit(4.5).alias("rating"),
        F.lit(7).alias("review_count"), F.lit("active").alias("status"),
        F.lit("2024-01-02").cast("date").alias("created_date"),
    )


def written_products(spark: SparkSession, folder: str) -> str:
    path = fresh_folder(spark, "products")
    product_file(spark, folder).write.option("escape", '"').csv(path, header=True)
    return path


@query(
    "SRC-02",
    "select l_partkey as product_id, p_name as product_name, p_size::int as inventory_qty, "
    "'red, \"dark\"' as color, p_retailprice as cost_price, '2024-01-02' as created, count(*) as rows "
    "from lineitem join part on l_partkey = p_partkey group by all",
)
def product_csv(spark, folder):
    rows = tables.read_products(spark, written_products(spark, folder))
    return rows.groupBy(
        "product_id", "product_name", "inventory_qty",
        "color",
        F.col("cost_price").cast("double").alias("cost_price"),
        F.col("created_date").cast("string").alias("created"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "SRC-02 SNK-04 SNK-05 SRC-08",
    "select count(distinct l_partkey) as exported, count(distinct l_partkey) as products, "
    "count(distinct l_partkey) as after_repeat from lineitem",
)
def loaded_products(spark, folder):
    """A product file loaded twice, then exported."""
    source, target = written_products(spark, folder), fresh_folder(spark, "product-table")
    once = load_products(spark, source, target)
    again = load_products(spark, source, target)
    exported = export_products(spark, target, fresh_folder(spark, "export"))
    total = once.agg(F.count(F.lit(1))).scalar()
    return again.agg(F.count(F.lit(1)).alias("after_repeat")).select(
        F.lit(exported).cast("bigint").alias("exported"), total.alias("products"), "after_repeat"
    )


@query(
    "SRC-02 SNK-04",
    """with rows as (select l_partkey, case when p_size in (3, 5) then 'malformed' when p_size = 4 then 'no key'
        else 'loaded' end as fate from lineitem join part on l_partkey = p_partkey)
    select fate, case when fate = 'loaded' then count(distinct l_partkey) else count(*) end as rows
    from rows group by fate""",
)
def rejected_products(spark, folder):
    """A product file in which some ids and prices are no numbers and some ids are missing."""
    size = F.col("inventory_qty")
    key, price = F.col("product_id").cast("string"), F.col("cost_price").cast("string")
    rows = product_file(spark, folder).withColumns(
        {
            "product_id": F.when(size == 3, F.concat(key, F.lit("x"))).when(size != 4, key),
            "cost_price": F.when(size == 5, "abc").otherwise(price),
        }
    )
    source, target = fresh_folder(spark, "bad-products"), fresh_folder(spark, "product-table")
    rows.write.option("escape", '"').csv(source, header=True)
    loaded = load_products(spark, source, target).select(F.lit("loaded").alias("fate"))
    refused = refused_products(spark, target)
    both = loaded if refused is None else loaded.union(refused.select("reason"))
    return both.groupBy("fate").agg(F.count(F.lit(1)).alias("rows"))


@query("SNK-05", "select doc_id, md5('  ' || text || chr(10) || ' ') as digest from documents")
def exported_texts(spark, folder):
    """Cells with blanks and line ends around them, read back as they were."""
    path = fresh_folder(spark, "texts-export")
    text = F.concat(F.lit("  "), F.col("text"), F.lit("\n "))
    sinks.export_csv(table(spark, folder, "documents").select("doc_id", text.alias("text")), path)
    back = spark.read.schema("doc_id bigint, text string").csv(
        path, header=True, escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "SNK-05",
    "select o_orderstatus, count(*) as orders, (select count(*) from orders) as exported "
    "from orders group by 1",
)
def exported_csv(spark, folder):
    path = fresh_folder(spark, "orders-export")
    rows = sinks.export_csv(table(spark, folder, "orders"), path)
    back = spark.read.csv(path, header=True)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.lit(rows).cast("bigint").alias("exported")
    )


@query("SRC-05", "select status, count(*) as rows from "
       "(select case event_type when 'error' then 'FAILED' else 'SUCCESS' end as status from events) group by 1")
def audit_snapshot(spark, folder):
    root = fresh_folder(spark, "snapshots")
    audit_rows(spark, folder).write.parquet(f"{root}/etl_audit")
    rows = tables.read_table(spark, "etl_audit", root)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query("SRC-08", "select p_partkey as product_id, p_name as product_name from part")
def whole_product_table(spark, folder):
    products(spark, folder).createOrReplaceTempView("product_details")
    return tables.read_products_table(spark, "product_details").select("product_id", "product_name")


# ------------------------------------------------------------------ report repository
@query(
    "SNK-07",
    """select (select max(o_orderkey) from orders) + row_number() over (order by ts, event_id) as incident_id,
        'd' as dag_id, user_id::varchar as task_id, event_type as root_cause, '' as impact, props as resolution,
        '' as preventive_action, case when event_type = 'view' then 0.5 when event_type = 'click' then null
        else (event_id % 10) / 10.0 end::double as confidence_score from events""",
)
def appended_reports(spark, folder):
    repository = table(spark, folder, "orders").select(F.col("o_orderkey").alias("incident_id"))
    score = F.concat((F.col("event_id") % 10 / 10.0).cast("string"), F.lit(" | high"))
    reports = table(spark, folder, "events").select(
        F.lit("d").alias("dag_id"),
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_type").alias("root_cause"),
        F.lit(None).cast("string").alias("business_impact"),
        F.col("props").alias("resolution"),
        F.lit(None).cast("string").alias("preventive_actions"),
        F.when(F.col("event_type") == "view", None)
        .when(F.col("event_type") == "click", "unsure | low").otherwise(score).alias("confidence_score"),
        F.col("ts").alias("created_ts"),
        F.to_date("ts").alias("day"),
        "event_id",
    )
    rows = sinks.append_rca(repository, reports, "day", [F.col("created_ts"), F.col("event_id")])
    return rows.drop("created_ts")
