"""Files of many sources: what is written for a source must not cost a file each."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentlake.plans import record_queries
from momentlake.sources import files


def test_documents_line_by_line(spark, tmp_path):
    (tmp_path / "many.json").write_text('{"source_id": "a", "moments": [{"gold_start": 1.0}, {"gold_start": 2.0}]}\n{"source_id": "b", "moments": [{"gold_start": 3.0}]}\n[{"gold_start": 4.0}]\n')
    got = files.read_gold(spark, str(tmp_path), lines=True).select("source_id", "item_id", "gold_start").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("many", 0, 4.0)]


def test_files_don_t_grow_with_sources(spark):
    rows = spark.range(500).select(F.col("id").alias("source_id"), F.lit(1.0).alias("gold_start"))
    path = record_queries._json_files(spark, rows, "moments", ["gold_start"])
    assert spark.read.text(path).select(F.input_file_name()).distinct().count() <= 8
    assert files.read_gold(spark, path, lines=True).select("source_id").distinct().count() == 500


def test_named_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("chunk_a.ts", "1\n"), ("chunk_b.ts", "22\n")], "name string, value string").repartition(2)
    for _ in range(2):  # again: each is replaced by itself
        assert files.write_named(rows, f"file:{tmp_path}/in") == 2
    assert {p.name: p.read_text() for p in (tmp_path / "in").iterdir()} == {"chunk_a.ts": "1\n", "chunk_b.ts": "22\n"}


def test_chunk_files_need_no_driver(spark, monkeypatch, tmp_path):
    """Numbered through, past midnight, without a call of the driver per file."""
    rows = spark.range(3000).select(F.col("id").alias("conv_id"))
    monkeypatch.setattr(record_queries, "table", lambda *a: rows)
    record_queries._chunk_files(spark, "", str(tmp_path))
    names = sorted(p.name for p in (tmp_path / "in").iterdir())
    assert len(names) == 3000 and names[0] == "chunk_20240101_000000.ts" and names[2880] == "chunk_20240102_000000.ts"
