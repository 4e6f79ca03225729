import json

from textloom.streaming import ingest


def test_running_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"doc_id": str(i), "text": "The cats sat. A cat.", "ts": "2024-01-01T00:00:00Z"}))
    stream = ingest.running_counts(ingest.stream_tokens(ingest.read_documents(spark, str(tmp_path / "in"), files_a_trigger=1)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.term: r.n for r in spark.table("counts").collect()}["cat"] == 4
