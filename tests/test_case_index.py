"""Lookups through the index of ids read only the buckets asked for."""

from pyspark.sql import functions as F

from faultline.operators import search
from faultline.operators.case_index import open_case_index, write_case_index

CASES = "incident_id string, ticket_id string, issue_id string, text string"


def test_index_equals_the_full_pass_and_follows_the_store(spark, frame, tmp_path):
    cases = frame([(f"D{i}", f"T{i % 7}", "" if i % 3 else f"D{i + 1}", f"text {i}") for i in range(60)], CASES)
    wanted = frame([(i, c) for i, c in enumerate(["D5", "T3", "D61", "D1", "none", None, "T3", ""])], "n int, case_id string")
    path = str(tmp_path / "index")

    def rows(df):
        return sorted(map(tuple, df.select("n", "case_id", "incident_id", "text").collect()))

    index = write_case_index(cases, path, 16)
    want = rows(search.lookup_cases(cases, wanted, F.xxhash64("n")))
    assert rows(index.lookup(wanted, F.xxhash64("n"))) == want == rows(open_case_index(spark, path).lookup(wanted, F.xxhash64("n")))
    assert [w[0] for w in want] == [0, 1, 3, 6]

    # buckets that nobody asks for may be broken
    asked = {r[0] for r in wanted.where("case_id = 'D5'").select(F.pmod(F.xxhash64("case_id"), F.lit(16))).collect()}
    for part in ("ids", "cases"):
        for folder in (tmp_path / "index" / part).glob("id_bucket=*"):
            if int(folder.name.split("=")[1]) not in asked:
                for file in folder.glob("*.parquet"):
                    file.write_bytes(b"no parquet")
    one = open_case_index(spark, path).lookup(wanted.where("case_id = 'D5'"), F.xxhash64("n"))
    assert rows(one) == [(0, "D5", "D5", "text 5")]

    replaced = write_case_index(cases.where("incident_id <> 'D5'"), path, 16)
    assert [r[0] for r in rows(replaced.lookup(wanted, F.xxhash64("n")))] == [1, 3, 6]
    nothing = write_case_index(cases.where("false"), path, 16)
    assert nothing.lookup(wanted, F.xxhash64("n")).count() == 0
