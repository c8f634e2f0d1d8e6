"""Every source and sink once, round trips, the engine on stored tables, the question-set runner and the streams."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sparkwright import schemas
from sparkwright.functions import vectors as V
from sparkwright.ontology import Ontology
from sparkwright.operators import extraction, html_blocks, resolve, routing, sections, validate
from sparkwright.plans import benchmark
from sparkwright.plans.engine import Engine
from sparkwright.sources import filings, tables
from sparkwright.streaming import incremental


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("warehouse"))
    nodes = [("Company", "Alpha", ["Alpha Works"]), ("Company", "Beta", None), ("RegulatoryBody", "Office of Things", [])]
    tables.write_nodes(spark.createDataFrame(nodes, schemas.NODE), f"{at}/nodes")
    edges = [("Company", "Alpha", "SUPPLIES", "Company", "Beta", ["d_00000"], 0.9), ("Company", "Alpha", "REGULATED_BY", "RegulatoryBody", "Office of Things", ["d_00001"], 0.8)]
    tables.write_edges(spark.createDataFrame(edges, schemas.EDGE), f"{at}/edges")
    texts = ["Alpha supplies Beta.", "Weather is a thing of clouds.", "The office looks after things."]
    rows = [(f"d_{i:05d}", "d", "S", t, "Alpha", "ALP", "text", date(2024, 1, 2), None, None) for i, t in enumerate(texts)]
    vectors = spark.createDataFrame(rows, "chunk_id string, document_id string, section_path string, text string, company string, ticker string, document_type string, filing_date date, embedding array<float>, created_at timestamp")
    tables.write_vectors(vectors.withColumn("embedding", V.embedder(64)("text")).withColumn("created_at", F.current_timestamp()), f"{at}/vectors")
    return at


def test_round_trips(spark, tmp_path, warehouse):
    assert {r["canonical_name"]: r["aliases"] for r in tables.nodes(spark, f"{warehouse}/nodes").collect()} == {"Alpha": ["Alpha Works"], "Beta": [], "Office of Things": []}
    assert tables.edges(spark, f"{warehouse}/edges").filter("rel_type = 'SUPPLIES'").first()["dst"] == "Beta" and tables.vectors(spark, f"{warehouse}/vectors").count() == 3
    doc = ("d", "s", "text", "T", date(2024, 1, 2), {"company": "Alpha"}, [("S", "body")], "body", "u", "A" * 64)
    docs = spark.createDataFrame([doc, (*doc[:-1], "no hash")], schemas.DOCUMENT)
    good, bad = validate.normalised_documents(docs)
    assert good.first()["content_hash"] == "a" * 64 and bad.count() == 1
    tables.write_documents(good, str(tmp_path / "docs"))
    assert tables.documents(spark, str(tmp_path / "docs"), "parquet").collect() == good.collect()
    good.write.json(str(tmp_path / "json"))
    assert tables.documents(spark, str(tmp_path / "json")).collect() == good.collect()
    found = {"entities": [("Company", "Alpha", 1.0), ("Company", "Beta", 1.0)], "relationships": [("SUPPLIES", "Alpha", "Beta", 0.9)]}
    for _ in range(2):  # a job that is run again
        tables.add_to_cache(spark.createDataFrame([("k", found, 3, 4)], schemas.CACHE), str(tmp_path / "cache"))
    cache = tables.extraction_cache(spark, str(tmp_path / "cache"))
    assert cache.count() == 1 and extraction.total_cost(cache).first()["results"] == 1
    results = cache.select(F.lit("d").alias("document_id"), F.lit("d_00000").alias("source_chunk_id"), "result")
    for document in ("d", "e", "d"):
        tables.write_results(results.withColumn("document_id", F.lit(document)), str(tmp_path / "results"))
    back = tables.results(spark, str(tmp_path / "results"))
    assert {r["document_id"] for r in back.collect()} == {"d", "e"} and back.count() == 2
    mentions, claims = tables.extracted(back.filter("document_id = 'd'"))
    assert mentions.count() == 2 and claims.first()["target_entity"] == "Beta"
    for content in (b"one", b"two"):
        filings.write_raw(spark.createDataFrame([("p.html", bytearray(content))], schemas.RAW), str(tmp_path / "raw"))
    assert bytes(filings.raw_pages(spark, str(tmp_path / "raw")).first()["content"]) == b"one"
    seeds = resolve.manifest_seeds(spark.createDataFrame([("ALP", "Alpha")], "ticker string, company string"))
    assert seeds.first()["names"] == ["ALP", "Alpha"]


def test_chunk_index_and_documents(spark):
    rows = spark.createDataFrame([("d_00000", "d", 0, "t"), ("d_x", "d", -1, "t"), ("d_y", None, 1, "t")], "chunk_id string, document_id string, chunk_index int, text string")
    good, bad = validate.split_valid(rows, validate.valid_chunk())
    assert [r["chunk_id"] for r in good.collect()] == ["d_00000"] and bad.count() == 2
    pages = spark.createDataFrame([(1, "alp_2023", "Alpha", "ALP", "10-K", date(2024, 1, 2), "u", "raw")], "page_id long, stem string, company string, ticker string, document_type string, date date, source_uri string, raw string")
    parts = spark.createDataFrame([(1, 1, "B", "two"), (1, 0, "A", "one")], "page_id long, section_pos int, section_path string, text string")
    doc = sections.assemble_documents(pages, parts).first()
    assert doc["title"] == "Alpha 10-K (FY2023)" and doc["text"] == "one\n\ntwo" and [s["section_path"] for s in doc["sections"]] == ["A", "B"]


def test_embedder_checks():
    with pytest.raises(ValueError):
        V.embedder(8, provider="remote")


def test_embedder_length(spark):
    with pytest.raises(Exception, match="numbers for each text"):
        spark.range(1).select(V.embedder(8, lambda: lambda texts: [[1.0] * 7 for _ in texts])(F.lit("x"))).collect()


def test_engine_on_stored_tables_with_its_log(spark, tmp_path, warehouse):
    engine = Engine.open(spark, warehouse, dim=64, log=str(tmp_path / "log"))
    assert engine.health() == {"status": "ok"}
    r = engine.ask("Who regulates Alpha?").first()
    assert r["answer_text"] == "Alpha is regulated by Office of Things." and [c["chunk_id"] for c in r["claims"]] == ["d_00001"] and r["graph_evidence_count"] == 1
    assert engine.ask("What are clouds?").first()["vector_evidence_count"] == 3 and engine.ask("What is it?", 1, vector_only=True).first()["route"] == "VECTOR"
    log = tables.decisions(spark, str(tmp_path / "log"))
    assert log.count() == 2 and log.filter("latency_ms > 0 and route in ('GRAPH', 'VECTOR')").count() == 2
    assert routing.vector_branch(log).count() == 1 and log.filter(routing.valid_route(F.col("route"))).count() == 2
    few = Engine.open(spark, warehouse, dim=64, facts_shown=1)
    assert few.ask("Whom does Alpha supply?").first()["graph_evidence_count"] == 1
    assert "SUPPLIES: Company -> Company" in Ontology().prompt_block()


def test_question_set(spark, tmp_path, warehouse):
    gold = [("q1", "single_hop", "GRAPH", 1, [["Office of Things"]], None, None, None, None), ("q2", "two_hop", "GRAPH", 2, [["Nobody"], ["Beta"]], None, None, None, None)]
    asked = spark.createDataFrame([("q1", "Who regulates Alpha?"), ("q2", "Whom does Alpha supply?")], "id string, question string")
    gold = spark.createDataFrame(gold, schemas.GOLDEN)
    report = benchmark.compare(Engine.open(spark, warehouse, dim=64), gold, asked, str(tmp_path / "report"))
    rows = {(r["system"], r["difficulty"]): r for r in report.collect()}
    assert rows["hybrid", "single_hop"]["accuracy"] == 1.0 and rows["hybrid", "two_hop"]["accuracy"] == 0.0 and rows["hybrid", None]["accuracy"] == 0.5
    assert rows["vector_only", None]["n"] == 2 and all(r["avg_latency_ms"] > 0 for r in rows.values())
    assert spark.read.json(str(tmp_path / "report")).count() == len(rows)
    outcomes = benchmark.run(Engine.open(spark, warehouse, dim=64), tables.benchmark_items(gold, asked))
    assert outcomes.columns == schemas.OUTCOME.names and outcomes.count() == 2


def test_streams(spark, tmp_path):
    doc = ("d", "s", "text", "T", date(2024, 1, 2), {}, [("S", " ".join(f"w{i}" for i in range(12)))], "body", "u", "a" * 64)
    spark.createDataFrame([doc], schemas.DOCUMENT).write.json(str(tmp_path / "in"))
    got = []
    pieces = incremental.piece_stream(incremental.document_stream(spark, str(tmp_path / "in")), 5, 1)
    incremental.for_each(pieces, lambda b: got.extend(r["piece"] for r in b.orderBy("window_pos").collect()), str(tmp_path / "c1")).awaitTermination()
    assert [len(p.split()) for p in got] == [5, 5, 4]
    spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 10:25:00', 'a', 3.0D UNION ALL SELECT timestamp'2024-01-02 10:00:00', 'b', 1.0D").write.parquet(str(tmp_path / "events"))
    counts = incremental.event_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "events")))
    counts.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("counted").collect()] == [(2, 5.0)]


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<p><b>" * 30_000 + "x", "<div>" * 30_000 + "</p>" * 30_000, "<div>" + "<b>x" * 50_000):
        html_blocks.leaf_blocks(page)
    assert time.time() - began < 30


def test_a_bad_chunk_ends_nothing(spark):
    """Good answers, cached ones and rejects each have their table; an answer that the JVM's schema refuses is a reject, too."""
    import json

    good = {"entities": [{"entity_type": "Company", "raw_name": "A", "confidence": 1.0}], "relationships": [{"relationship_type": "SUPPLIES", "source_entity": "A", "target_entity": "B", "confidence": 1.0}]}

    def extract(section, text, budget, filer):
        if text == "raise":
            raise RuntimeError("no")
        return {"good": json.dumps(good), "list": "[1]", "none": "null", "word": json.dumps({"entities": [{**good["entities"][0], "confidence": True}], "relationships": []}), "bad": "{", "lacks": "{}"}[text]

    rows = spark.createDataFrame([(k, k, k, {"company": "X"}) for k in ("good", "list", "none", "word", "bad", "lacks", "raise")], "chunk_id string, section_path string, text string, metadata map<string,string>")
    made, rejects = extraction.extract_all(rows, extract)
    kept = made.collect()
    assert [r["chunk_id"] for r in kept] == ["good"] and kept[0]["result"]["relationships"] == [] and kept[0]["result"]["entities"][0]["raw_name"] == "A"
    why = {r["chunk_id"]: (r["reason"].split(":")[0], r["tries"]) for r in rejects.collect()}
    assert why == {"list": ("not in form", 3), "none": ("not in form", 3), "word": ("not in the schema", 1), "bad": ("not JSON", 3), "lacks": ("not in form", 3), "raise": ("failed", 3)}
    cache = made.select("cache_key", "result", "input_tokens", "output_tokens")
    again, rejects = extraction.extract_all(rows, extract, cache)
    assert [(r["chunk_id"], r["from_cache"]) for r in again.collect()] == [("good", True)] and rejects.count() == 6
