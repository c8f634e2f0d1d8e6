from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkwright import schemas
from sparkwright.plans.engine import Engine
from sparkwright.sources import filings, tables


def test_addresses(spark):
    row = spark.createDataFrame([("0000001234", "0001-22-000333", "page.htm"), (None, "1", "p")], "cik string, acc string, page string")
    got = [r[0] for r in row.select(filings.page_address(F.col("cik"), F.col("acc"), F.col("page"))).collect()]
    assert got[0] == "https://www.sec.gov/Archives/edgar/data/1234/000122000333/page.htm"


def test_pages_are_fetched_politely(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def get(url):
        import time
        import uuid

        (seen / uuid.uuid4().hex).write_text(f"{time.monotonic()} {url}")
        if url.endswith("3"):
            raise ConnectionError("gone")
        return url.encode()

    wanted = spark.createDataFrame([(f"n{i}", f"u{i}") for i in range(5)] + [("again", "u1"), ("none", None)], "name string, url string")
    rows = {r["url"]: r for r in filings.fetch(wanted, get, pause=0.1).collect()}
    assert set(rows) == {f"u{i}" for i in range(5)} and rows["u1"]["name"] == "again"
    assert rows["u2"]["content"] == b"u2" and rows["u2"]["reason"] is None
    assert rows["u3"]["content"] is None and rows["u3"]["reason"] == "ConnectionError: gone"
    times = sorted(float(p.read_text().split()[0]) for p in seen.iterdir())
    assert len(times) == 5 and min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.099
    filings.write_raw(filings.fetch(wanted, lambda u: u.encode(), pause=0, lanes=3), str(tmp_path / "raw"))
    assert filings.raw_pages(spark, str(tmp_path / "raw")).count() == 5
    assert filings.fetch(wanted.limit(0), get).collect() == []


@pytest.fixture
def engine(spark, tmp_path):
    nodes = spark.createDataFrame([("Company", "Alpha", []), ("RegulatoryBody", "Office", [])], schemas.NODE)
    edges = spark.createDataFrame([("Company", "Alpha", "REGULATED_BY", "RegulatoryBody", "Office", ["c1"], 0.9)], schemas.EDGE)
    return Engine(spark, nodes, edges, spark.createDataFrame([], schemas.VECTOR), log=str(tmp_path / "log"))


def test_a_set_is_logged_once(spark, engine):
    asked = spark.createDataFrame([(1, "Who regulates Alpha?"), (2, "What is the weather?"), (3, "")], "question_id long, question string")
    plain, _ = engine.facts(asked)
    rows = lambda f: sorted(map(str, f.collect()))
    for _ in range(2):
        facts, decided = engine.facts(asked, batch="b/1")
        assert rows(facts) == rows(plain) and facts.count() == 1
    engine.facts(asked.filter("question_id = 2"), batch="2024-01-01")
    log = tables.logged_batches(spark, f"{engine.log}_sets")
    assert sorted((r["batch"], r["question_id"], r["route"]) for r in log.collect()) == [("2024-01-01", "2", "VECTOR"), ("b/1", "1", "GRAPH"), ("b/1", "2", "VECTOR"), ("b/1", "3", "VECTOR")]
    one = log.filter("question_id = '1'").first()
    assert one["question"] == "Who regulates Alpha?" and one["entity_names"] == ["Alpha"] and isinstance(one["asked_at"], datetime) and one["latency_ms"] is None
    assert dict(decided.dtypes)["question_id"] == "bigint" and decided.count() == 3


def test_a_smaller_run_of_a_batch_takes_its_place(spark, engine):
    asked = spark.createDataFrame([("x", "Who regulates Alpha?"), ("y", None)], "question_id string, question string")
    engine.facts(asked, batch="1")
    engine.facts(asked.filter("question_id = 'x'"), batch="1")
    assert [r["question_id"] for r in tables.logged_batches(spark, f"{engine.log}_sets").collect()] == ["x"]
