import json

from auditloom.__main__ import main
from auditloom.plans import registry
from auditloom.sources import files
from auditloom.streaming import ledgers as stream


def test_folders(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.md").write_text("# A\ntext é\n")
    (tmp_path / "p/b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "p/a.pdf").write_bytes(b"%PDF")
    (tmp_path / "p/c.txt").write_text("no")
    rows = {r["doc_id"]: r for r in files.manuscripts(spark, str(tmp_path / "p")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["media_type"] == "application/pdf" and rows["b"]["problem"] == "not valid UTF-8"
    (tmp_path / "e/a/nested").mkdir(parents=True)
    (tmp_path / "e/a/nested/experiments.jsonl").write_text('{"trial": "x"}\n\n{"trial": "y"}')
    got = [(r["doc_id"], r["line"], r["raw"]) for r in files.ledgers(spark, str(tmp_path / "e")).where("raw != ''").collect()]
    assert got == [("a", 1, '{"trial": "x"}'), ("a", 3, '{"trial": "y"}')]
    assert files.bundle_hashes(spark, str(tmp_path / "e")).count() == 1
    (tmp_path / "env").write_text("# c\nexport A='1'\nB=2\n")
    assert {(r["key"], r["value"]) for r in files.settings(spark, str(tmp_path / "env")).collect()} == {("A", "1"), ("B", "2")}


def test_command_line(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.md").write_text("# A\n\n## Results\nWe reached 3.0 accuracy today.\n")
    (tmp_path / "e/a").mkdir(parents=True)
    (tmp_path / "e/a/experiments.jsonl").write_text(json.dumps({"trial": "baseline", "accuracy": 3.0}))
    assert main([str(tmp_path / "p"), str(tmp_path / "e"), str(tmp_path / "o"), "--cpus", "2"]) == 0
    assert spark.read.parquet(str(tmp_path / "o/verdicts")).first()["label"] == "supported"


def test_stream(spark, tmp_path):
    rows = [(1, 1, "f.jsonl", "r", 1, '{"status":"Keep"}'), (2, 1, "f.jsonl", "r", 1, '{"status":"Keep"}'), (3, 1, "f.jsonl", "r", 2, "broken")]
    frame = spark.createDataFrame(rows, "line_id long, paper_id long, ledger_path string, run_tag string, line_no int, raw_line string")
    stamped = frame.selectExpr("*", "timestamp_ntz'2026-01-01 00:00:00' AS logged_at", "timestamp_ntz'2026-01-02 00:00:00' AS received_at")
    stamped.write.parquet(str(tmp_path / "in"))
    stream.write(stream.once(stream.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    query = stream.outcomes(stream.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("outcomes").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["status"], r["n"]) for r in spark.table("outcomes").collect()] == [("keep", 2)]


def test_registry_names_and_sql_agree():
    names, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 70
