"""An inverted index of case ids.

Every id under which a case can be asked for has one row, with the case it stands for, in a bucket
by the hash of the id; the cases stand in buckets by the hash of their own id.  A lookup reads the
buckets of the ids it asks for, and then those of the cases found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.search import case_places, first_places, with_cases

BUCKET = "id_bucket"


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def _in_buckets(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """The rows, a file per bucket; many rows of one bucket may share out among tasks."""
    return rows.withColumn(BUCKET, _bucket(name, buckets)).repartition(BUCKET)


@dataclass
class CaseIndex:
    spark: SparkSession
    path: str
    case_schema: T.StructType
    buckets: int

    def _read(self, part: str, schema: T.StructType, sought: DataFrame, name: str) -> DataFrame:
        """Rows of the buckets of ``sought``; the numbers of the buckets pass through the driver."""
        asked = [r[0] for r in sought.select(_bucket(name, self.buckets)).distinct().collect()]
        full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(full).parquet(f"{self.path}/{part}")
        return rows.where(F.col(BUCKET).isin(asked)).drop(BUCKET)

    def lookup(self, wanted: DataFrame, spread: Column, slice_rows: int = 2_000_000) -> DataFrame:
        """Like ``search.lookup_cases`` on the indexed cases."""
        sought = wanted.select("case_id").where(F.col("case_id").isNotNull()).distinct()
        ids = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("__found", T.StringType())])
        match = self._read("ids", ids, sought, "case_id").join(sought, "case_id", "left_semi")
        found = match.select(F.col("__found").alias("incident_id")).distinct()
        cases = self._read("cases", self.case_schema, found, "incident_id")
        return with_cases(wanted, match, cases, spread, slice_rows)


def write_case_index(cases: DataFrame, path: str, buckets: int = 64) -> CaseIndex:
    """Indexes ``cases`` by all their ids, in place of what the folder holds."""
    spark = cases.sparkSession
    keyed = cases.withColumn("incident_id", F.col("incident_id").cast("string"))
    places = first_places(case_places(keyed))
    _in_buckets(places, "case_id", buckets).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/ids")
    _in_buckets(keyed, "incident_id", buckets).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/cases")
    facts = spark.createDataFrame([(buckets, keyed.schema.json())], "buckets int, schema string")
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    return CaseIndex(spark, path, keyed.schema, buckets)


def open_case_index(spark: SparkSession, path: str) -> CaseIndex:
    import json

    facts = spark.read.parquet(f"{path}/facts").first()
    return CaseIndex(spark, path, T.StructType.fromJson(json.loads(facts["schema"])), facts["buckets"])
