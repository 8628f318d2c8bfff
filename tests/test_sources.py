import time

import pytest
from pyspark.sql import functions as F

from corpuskiln.plans.ingestion import Store, ingest_file, ingest_folder
from corpuskiln.sources import files
from corpuskiln.streaming.ingest import distinct_traces, ingest_stream, trace_windows


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    (src / ".deep").mkdir(parents=True)
    (src / "a.txt").write_bytes(b"h\xffi there")
    (src / ".deep" / "b.html").write_text("<title>T</title><p>body</p>")
    (src / "_c.md").write_text("# Head\n\ntext `code`")
    (src / ".hidden.txt").write_text("no")
    (src / "bad.xyz").write_text("no")
    (src / "empty.txt").write_text(" \n")
    (src / "broken.pdf").write_bytes(b"no pdf")
    return src


def counts(df):
    return {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}


def test_scan_and_load(spark, folder):
    rows = {r["metadata"]["source_file"].rsplit("/", 1)[1]: r for r in files.documents(files.scan(spark, str(folder)), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(rows) == {"a.txt", "b.html", "_c.md", "bad.xyz", "empty.txt", "broken.pdf"}
    assert rows["a.txt"]["content"] == "h�i there" and rows["a.txt"]["metadata"]["file_type"] == "txt"
    assert rows["b.html"]["content"] == "T\nbody" and rows["b.html"]["metadata"]["custom"] == {"title": "T"}
    assert rows["bad.xyz"]["reason"] == "unsupported type: .xyz" and rows["empty.txt"]["reason"] == "empty" and rows["broken.pdf"]["status"] == "failed"
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(folder / "none"))


def test_pdf_with_a_reader(spark):
    pdf = spark.createDataFrame([("x.pdf", bytearray(b"1"))], "path string, content binary")
    row = files.documents(pdf, F.current_timestamp(), lambda: lambda raw: ("page one\n\npage two", 2)).first()
    assert row["content"] == "page one\n\npage two" and row["metadata"]["custom"] == {"page_count": "2"}


def test_ingest_twice_and_heal(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert counts(ingest_folder(spark, str(folder), store)) == {"ingested": 3, "failed": 3}
    assert counts(ingest_folder(spark, str(folder), store)) == {"skipped": 3, "failed": 3}
    assert store.docs().count() == 3 and store.chunks().count() == 3
    lost = store.chunks().filter("text like '%body%'").first()["parent_doc_id"]
    kept = store.chunks().filter(F.col("parent_doc_id") != lost).collect()
    spark.createDataFrame(kept, store.chunks().schema).write.mode("overwrite").parquet(str(tmp_path / "store" / "chunks"))
    assert counts(ingest_folder(spark, str(folder), store)) == {"ingested": 1, "skipped": 2, "failed": 3}
    assert store.docs().count() == 3 and store.chunks().count() == 3
    assert counts(ingest_file(spark, str(folder / "a.txt"), store)) == {"skipped": 1}
    with pytest.raises(FileNotFoundError):
        ingest_file(spark, str(folder / "none.txt"), store)
    store.healed()
    assert store.docs().count() == 3 and store.chunks().count() == 3


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.txt").write_text("first text")
    store = Store(spark, str(tmp_path / "store"))
    for expected in (1, 2):
        ingest_stream(spark, str(src), store, str(tmp_path / "checkpoint")).awaitTermination(60)
        assert store.docs().count() == expected
        (src / "two.txt").write_text("second text")
        time.sleep(0.1)


def test_trace_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00", True, 5.0), ("a", "2024-01-01 00:10:00", True, 5.0), ("b", "2024-01-01 00:20:00", False, -1.0), ("c", "2024-02-01 00:00:00", True, 1.0)]
    df = spark.createDataFrame(rows, "trace_id string, at string, success boolean, duration_ms double").select("trace_id", F.col("at").cast("timestamp").alias("started_at"), "success", "duration_ms")
    df.write.parquet(str(tmp_path / "t"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    for name, made, mode in (("d", distinct_traces(stream()), "append"), ("w", trace_windows(stream()), "complete")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("d").count() == 3
    assert {r["runs"] for r in spark.table("w").collect()} == {3, 1}


def test_json_lines_and_articles(spark, tmp_path):
    path = str(tmp_path / "e.jsonl")
    with open(path, "w") as f:
        f.write('{"query": "a", "source_doc_id": "1"}\n\n{"query": "b", "source_doc_id": "2", "source_title": ""}\n')
    assert files.json_lines(spark, path).count() == 2 and files.json_lines(spark, path, limit=1).count() == 1
    out = str(tmp_path / "out")
    rows = files.json_lines(spark, path)
    assert files.write_json_lines(rows, out, least=2) is True and files.write_json_lines(rows, out, least=2) is False and files.write_json_lines(rows, out, force=True) is True
    articles = spark.createDataFrame([(1, "Java", "x"), (2, "Cooking", "y"), (3, "Linux kernels", " "), (4, "SQL", "z")], "id int, title string, text string")
    found = files.matching_articles(articles, "id", "title", "text", target=5, max_scan=4)
    assert [r["id"] for r in found.orderBy("id").collect()] == [1, 4]
    written = files.write_articles(found, str(tmp_path / "raw")).collect()
    assert open(written[0]["path"]).read() == "Title: Java\n\nx"
    assert files.report(spark.createDataFrame([("recall", 0.5)], "metric string, value double"), "Evaluation").startswith("# Evaluation")
