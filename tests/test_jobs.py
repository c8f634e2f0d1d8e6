import logging
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import fact_sheets, ingest_chunks

DATA = "/root/testdata/sf0.001"
DOCS = ingest_chunks.LANDED


def land(spark, rows, path):
    """Files that land: documents (id, text, language)."""
    spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def table(frame):
    return sorted(tuple(r) for r in frame.select("document_id", "chunk_index", "section_path", "text", "lang").collect())


@pytest.fixture
def at(tmp_path):
    return {k: str(tmp_path / k) for k in ("documents", "out", "checkpoint")}


def test_growing_input(spark, at, caplog):
    caplog.set_level(logging.INFO)
    land(spark, [(1, "one two three\nfour", "en"), (2, "fünf", "de"), (3, None, "en"), (4, "x", None), (None, "nobody's", "en")], at["documents"])
    small = {"chunk_tokens": 2, "chunk_overlap": 0}
    told = ingest_chunks.run(spark, **at, config=small)
    assert [(t["documents_read"], t["documents_taken"], t["chunks_written"]) for t in told] == [(5, 4, 5)]
    first = [("1", 0, "p0", "one two", "en"), ("1", 1, "p0", "three", "en"), ("1", 2, "p1", "four", "en"), ("2", 0, "p0", "fünf", "de"), ("4", 0, "p0", "x", None)]
    assert table(ingest_chunks.current(spark, at["out"])) == first
    assert ingest_chunks.run(spark, **at, config=small) == [] and "nothing new" in caplog.text
    assert table(ingest_chunks.current(spark, at["out"])) == first

    # a new document, one that lands again as it was, one that changed, one that lost its text
    land(spark, [(5, "new", "fr"), (2, "fünf", "de"), (1, "one", "en"), (4, " \n ", None)], at["documents"])
    told = ingest_chunks.run(spark, **at, config=small)
    assert [(t["documents_read"], t["documents_taken"], t["chunks_written"]) for t in told] == [(4, 3, 2)]
    assert table(ingest_chunks.current(spark, at["out"])) == [("1", 0, "p0", "one", "en"), ("2", 0, "p0", "fünf", "de"), ("5", 0, "p0", "new", "fr")]
    assert ingest_chunks.run(spark, **at, config=small) == []


def test_a_batch_that_comes_again(spark, at, tmp_path):
    """A run that was ended between its writes and its checkpoint's mark leaves the same table."""
    land(spark, [(1, "a b c", "en"), (2, "d", "de")], at["documents"])
    ingest_chunks.run(spark, **at)
    land(spark, [(1, "a b", "en"), (3, "e", "en")], at["documents"])
    ingest_chunks.run(spark, **at)
    want = table(ingest_chunks.current(spark, at["out"]))
    for mark in (".1.crc", "1"):
        (Path(at["checkpoint"]) / "commits" / mark).unlink(missing_ok=True)
    told = ingest_chunks.run(spark, **at)
    assert [t["batch"] for t in told] == [1] and told[0]["documents_taken"] == 2
    assert table(ingest_chunks.current(spark, at["out"])) == want == [("1", 0, "p0", "a b", "en"), ("2", 0, "p0", "d", "de"), ("3", 0, "p0", "e", "en")]


def test_rows_of_one_id_in_a_batch(spark, at):
    """One of them is taken, and every run takes the same one."""
    land(spark, [(7, "left", "en"), (7, "right", "en"), (7, "left", "en")], at["documents"])
    ingest_chunks.run(spark, **at)
    got = table(ingest_chunks.current(spark, at["out"]))
    assert len(got) == 1 and got[0][3] in ("left", "right")


def test_no_documents(spark, at):
    land(spark, [], at["documents"])
    ingest_chunks.run(spark, **at)
    assert ingest_chunks.current(spark, at["out"]).collect() == []


def test_one_file_and_small_batches(spark, at):
    """A path may be a file, and batches may be small; the table is the same."""
    at["documents"] = f"{DATA}/documents.parquet"
    ingest_chunks.run(spark, **at, config={"files_per_batch": 1})
    n = spark.read.parquet(at["documents"]).filter("trim(text) <> ''").count()
    assert ingest_chunks.current(spark, at["out"]).select("document_id").distinct().count() == n


def test_fact_sheets_twice(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    out = str(tmp_path / "out")
    told = fact_sheets.run(spark, DATA, out)
    rows = sorted(map(str, fact_sheets.read(spark, out).collect()))
    assert told["statements_written"] == len(rows) == 2 * told["edges_written"] and "statements_written" in caplog.text
    assert {p.name for p in Path(out, "sheets").iterdir() if p.is_dir()} == {f"relationship_type={t}" for t in fact_sheets.load()["relationship_types"]}
    assert fact_sheets.run(spark, DATA, out) == told
    assert sorted(map(str, fact_sheets.read(spark, out).collect())) == rows
    some = {(r["entity"], r["relationship_type"]): r for r in fact_sheets.summary(spark, out).collect()}
    one = some["Supplier#000000001", "REGULATED_BY"]
    assert one["neighbors"] == one["statements"] == 1


def test_fact_sheets_config(spark, tmp_path):
    out = str(tmp_path / "out")
    fact_sheets.run(spark, DATA, out, {"relationship_types": ["SUPPLIES"], "least_confidence": 0.05})
    kinds = fact_sheets.read(spark, out).select("relationship_type", "confidence").distinct().collect()
    assert {r[0] for r in kinds} == {"SUPPLIES"} and min(r[1] for r in kinds) >= 0.05
    with pytest.raises(ValueError, match="relationship type"):
        fact_sheets.run(spark, DATA, out, {"relationship_types": ["NOT_A_TYPE"]})


def test_command_line(tmp_path):
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-m", "jobs.fact_sheets", "--tables", DATA, "--out", str(tmp_path / "o")], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "statements_written" in out.stderr and (tmp_path / "o" / "summary" / "_SUCCESS").exists()


def test_nothing_of_the_other_package():
    root = Path(__file__).resolve().parents[1]
    for path in [*(root / "jobs").glob("*.py"), Path(__file__)]:
        lines = [x for x in path.read_text().splitlines() if x.startswith(("import ", "from "))]
        assert not any("llm" in x or "corpus_pipeline" in x for x in lines)


def test_neighbours_of_several_edges_count_once(spark, tmp_path, monkeypatch):
    """Edges both ways, of other types' namesakes, loops and a missing name: as count_distinct has it, with pairs sent or dealt."""
    ends = [("C", "a", "C", "b"), ("C", "b", "C", "a"), ("C", "a", "P", "b"), ("C", "a", "C", "a"), ("C", "a", "P", "a"), ("C", "a", "C", "c"), ("C", "d", "C", None)]
    edges = [(st, s, r, dt, d, ["1"], 0.5) for st, s, dt, d in ends for r in ("SUPPLIES", "ACQUIRED")] + [("C", "a", "OWNS", "C", "b", ["2"], 0.5)]
    out = str(tmp_path)
    fact_sheets.T.write_edges(spark.createDataFrame(edges, "src_type string, src string, rel_type string, dst_type string, dst string, source_chunk_ids array<string>, confidence double"), f"{out}/edges")
    fact_sheets.sheets(fact_sheets.T.edges(spark, f"{out}/edges"), fact_sheets.Ontology()).write.partitionBy("relationship_type").parquet(f"{out}/sheets")
    key = ["entity_type", "entity", "relationship_type"]
    want = sorted(map(str, fact_sheets.read(spark, out).groupBy(*key).agg(F.count_distinct("neighbor").alias("neighbors"), F.count(F.lit(1)).alias("statements")).collect()))
    assert any("neighbors=0" in w for w in want) and sorted(map(str, fact_sheets.summarised(spark, out).collect())) == want
    monkeypatch.setattr(fact_sheets, "SENT", 0)
    assert sorted(map(str, fact_sheets.summarised(spark, out).collect())) == want
