import json

import pytest
from pyspark.sql import functions as F

from sparkwright import config, schemas
from sparkwright.functions import vectors as V
from sparkwright.ontology import Ontology
from sparkwright.operators import extraction, vector_search
from sparkwright.sources import filings, tables
from sparkwright.streaming import incremental


def test_tickers(spark):
    raw = spark.createDataFrame([(0, "qqx", 7, "old"), (1, "QQX", 4711, "Quux")], "pos int, ticker string, cik long, title string")
    mapping = filings.ticker_table(raw)
    assert tuple(mapping.first()) == ("QQX", "0000004711", "Quux")
    with pytest.raises(filings.UnknownTickers, match="AAA, ZZZ"):
        filings.resolve_tickers(spark.createDataFrame([("zzz",), ("qqx",), ("aaa",)], "ticker string"), mapping)


def test_latest_filing(spark):
    feed = spark.createDataFrame([("1", ["8-K", "10-K", "10-K"], ["2024-05-01", "2024-02-01", "2024-02-01"], ["a", "b", "c"], ["x", "y", "z"]), ("2", ["8-K"], ["2024-01-01"], ["d"], ["w"])], "cik string, form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>")
    (r,) = filings.latest_filing(feed).collect()
    assert r["accessionNumber"] == "b" and [x["cik"] for x in filings.without_filing(feed).collect()] == ["2"]


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert filings.read_manifest(spark, path).count() == 0
    row = ("Acme", "ACM", "1", "a", "10-K", None, "f.html", "2024-01-01T00:00:00Z", "0" * 64)
    rows = spark.createDataFrame([row], schemas.MANIFEST.simpleString().replace("struct<", "").rstrip(">"))
    filings.write_manifest(rows.withColumn("filing_date", F.to_date(F.lit("2024-01-02"))), path)
    manifest = filings.read_manifest(spark, path)
    wanted, there = spark.createDataFrame([("ACM",), ("NEW",)], "ticker string"), spark.createDataFrame([("f.html",)], "path string")
    assert [r[0] for r in filings.to_fetch(wanted, manifest, there).collect()] == ["NEW"]
    assert filings.to_fetch(wanted, manifest, there.limit(0)).count() == 2


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"a")
    assert filings.raw_files(spark, str(tmp_path)).first()["content_hash"].startswith("ca978112")


def test_golden(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"id": "q1", "difficulty": "two_hop", "gold_entities": [["A", "B"]]}]}))
    (tmp_path / "q.json").write_text(json.dumps({"items": [{"id": "q1", "question": "why?"}]}))
    r = tables.benchmark_items(tables.golden(spark, str(tmp_path / "g.json")), tables.questions(spark, str(tmp_path / "q.json"))).first()
    assert r["gold_entities"] == [["A", "B"]] and r["question"] == "why?"


def test_settings():
    with pytest.raises(config.MissingSettings, match="WAREHOUSE"):
        config.Settings.load({})
    s = config.Settings.load({"SPARKWRIGHT_WAREHOUSE": "/w/", "SPARKWRIGHT_CHUNK_TOKENS": "5"})
    assert s.chunk_tokens == 5 and s.table("edges") == "/w/edges"


def test_ontology(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("status: DRAFT\n")
    with pytest.raises(ValueError):
        Ontology.load(str(tmp_path / "o.yaml"))
    (tmp_path / "o.yaml").write_text("status: DEFINED\nentity_types: [{name: X}]\nrelationship_types: [{name: OWNS, source: X, target: X}]\n")
    o = Ontology.load(str(tmp_path / "o.yaml"))
    assert o.relationships == (("OWNS", "X", "X", "owns"),) and o.json_schema()["properties"]["entities"]["items"]["properties"]["entity_type"]["enum"] == ["X"]
    claims = spark.createDataFrame([("SUPPLIES", "Company", "Product"), ("SUPPLIES", "Company", "Company")], "relationship_type string, source_type string, target_type string")
    assert Ontology().off_range(claims).count() == 1 and o.outside(claims).count() == 2


def test_extraction(spark):
    chunks = spark.createDataFrame([("c1", "S", "Acme supplies Beta. We compete.", {"company": "Acme"}), ("c2", "S", "", {})], "chunk_id string, section_path string, text string, metadata map<string,string>")
    extract = extraction.rule_extractor({"Acme": "Company", "Beta": "Company"})
    first = extraction.extract_chunks(chunks, extract)
    rows = {r["chunk_id"]: r for r in first.collect()}
    assert [tuple(x) for x in rows["c1"]["result"]["relationships"]] == [("SUPPLIES", "Acme", "Beta", 0.9)]
    own = extraction.parsed(extract("S", "US regulators asked us. The Company supplies Beta; our tests passed.", 9, "Gamma"), Ontology())
    assert [(r["source_entity"], r["target_entity"]) for r in own["relationships"]] == [("Gamma", "Beta")] and {e["raw_name"] for e in own["entities"]} == {"Gamma", "Beta"}
    side_by_side = {r["chunk_id"]: r["result"] for r in extraction.extract_chunks(chunks, extract, workers=4).collect()}
    assert side_by_side == {k: r["result"] for k, r in rows.items()}
    cache = spark.createDataFrame([tuple(rows["c1"][c] for c in ("cache_key", "result", "input_tokens", "output_tokens"))], schemas.CACHE)
    assert {r["chunk_id"]: r["from_cache"] for r in extraction.extract_chunks(chunks, extract, cache).collect()} == {"c1": True, "c2": False}
    assert extraction.total_cost(cache.limit(0)).first()["cost"] == 0.0


def test_retries():
    budgets = []

    def extract(section, text, budget, filer):
        budgets.append(budget)
        if budget < 32768:
            raise extraction.Truncated
        return '{"entities": [], "relationships": [{"relationship_type": "SUPPLIES", "source_entity": "x", "target_entity": "y", "confidence": 1}]}'

    assert extraction.extract_once(extract, "", "", Ontology()) == {"entities": [], "relationships": []} and budgets == [8192, 16384, 32768]
    with pytest.raises(ValueError):
        extraction.extract_once(lambda *_: "no json", "", "", Ontology())


def test_vectors(spark):
    rows = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(10)], "chunk_id string, embedding array<float>")
    got = vector_search.top_k(rows, [1.0, 0.0], 3).collect()
    assert [r["chunk_id"] for r in got] == ["9", "8", "7"] and vector_search.top_k(rows, [1.0, 0.0], 3, 0.993).count() == 1
    with pytest.raises(ValueError):
        vector_search.top_k(rows, [1.0, 0.0], 0)
    centres = vector_search.fit_clusters(rows, 4)
    assert vector_search.top_k_clusters(vector_search.assign_clusters(rows, centres), centres, [1.0, 0.0], 3, probes=4).count() == 3
    e = rows.limit(1).select(V.embedder(16)(F.lit("a b")).alias("e")).first()["e"]
    assert len(e) == 16 and abs(sum(x * x for x in e) - 1) < 1e-6 and not V.embed_text("", 8).any()


def test_stream_merges_twice(spark, tmp_path):
    claims = "src_type string, src string, relationship_type string, dst_type string, dst string, source_chunk_id string, confidence double"
    out = str(tmp_path / "edges")
    for k in range(2):
        spark.createDataFrame([("Company", "A", "SUPPLIES", "Company", "B", f"c{k}", 0.5)], claims).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(claims).parquet(str(tmp_path / "in"))
        incremental.merge_claims(stream, out, str(tmp_path / "check")).awaitTermination()
        spark.createDataFrame([("Company", "A", "ACQUIRED", "Company", "C", f"d{k}", 0.5)], claims).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.merge_claims(spark.readStream.schema(claims).parquet(str(tmp_path / "in")), out, str(tmp_path / "check")).awaitTermination()
    found = {r["rel_type"]: r["source_chunk_ids"] for r in incremental.current_edges(spark, out).collect()}
    assert found == {"SUPPLIES": ["c0", "c1"], "ACQUIRED": ["d0", "d1"]} and len(incremental._pointers(spark, out)) == 2
    incremental.merge_claims(spark.readStream.schema(claims).parquet(str(tmp_path / "in")), out, str(tmp_path / "anew")).awaitTermination()  # all of it again
    assert {r["rel_type"]: r["source_chunk_ids"] for r in incremental.current_edges(spark, out).collect()} == found
    assert incremental.current_edges(spark, str(tmp_path / "none")).count() == 0


def test_nearest_of_many_passages_by_hashed_words():
    """One word in common outweighs what thousands of passages have in common with the question by chance."""
    import numpy as np

    said = [f"Supplier#{i:09d} widget{i} filed." for i in range(1, 6001)]
    vectors = np.array([V.embed_text(t, 2048) for t in said])
    for question, want in (("Why does who regulate Supplier#000000001 so?", 0), ("widget7 filed.", 6)):
        assert int((vectors @ V.embed_text(question, 2048)).argmax()) == want
