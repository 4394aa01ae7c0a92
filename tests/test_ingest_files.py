"""The CSV export that the ingest query reads comes in files of bounded size, as a file is one task."""

import glob

from bindings import cases


def test_exported_incidents_are_several_files(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 45_000, 1, 2).selectExpr(
        "id as doc_id", "concat('text ', id, chr(10), 'end') as text", "'en' as lang", "'s' as source", "10L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").where("doc_id % 3 = 0").write.parquet(str(tmp_path / "labels.parquet"))
    read = {}
    monkeypatch.setattr(cases, "ingest", lambda spark, csv, *rest: read.update(path=csv))
    cases.ingested_dataset(spark, str(tmp_path))
    files = glob.glob(f"{read['path']}/*.csv")
    rows = [spark.read.csv(f, header=True, multiLine=True).count() for f in files]
    assert sum(rows) == 45_000 and max(rows) <= 20_000
