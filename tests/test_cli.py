"""The commands, one after another, from documents to a report."""

import json
from datetime import date

import pytest

from sparkwright import schemas
from sparkwright.__main__ import main
from sparkwright.config import MissingSettings
from sparkwright.sources import tables


def test_from_documents_to_a_report(spark, tmp_path):
    at = str(tmp_path / "w")
    texts = [("d1", "Alpha is regulated by Office of Things. Alpha supplies Beta."), ("d2", "Clouds are made of water.")]
    docs = [(i, "s", "text", "T", date(2024, 1, 2), {"company": "Alpha", "ticker": "ALP"}, [("S", t)], t, "u", "a" * 64) for i, t in texts]
    tables.write_documents(spark.createDataFrame(docs, schemas.DOCUMENT), f"{at}/documents")
    (tmp_path / "names.json").write_text(json.dumps({"Alpha": "Company", "Beta": "Company", "Office of Things": "RegulatoryBody"}, indent=1))
    run = lambda *a: [json.loads(x) for x in main(["--warehouse", at, *a], spark)]

    assert run("extract", "--names", str(tmp_path / "names.json"))[0]["results"] == 2
    assert run("extract", "--names", str(tmp_path / "names.json"))[0]["results"] == 2  # from the cache
    assert tables.results(spark, f"{at}/results").count() == 2
    assert run("graph") == [{"written": 2, "skipped": 0}]
    assert run("graph") == [{"written": 2, "skipped": 0}] and tables.edges(spark, f"{at}/edges").count() == 2
    assert run("embed") == [{"chunks": 2}]
    near = run("search", "What are clouds made of?", "-k", "1")
    assert [r["chunk_id"] for r in near] == ["d2_00000"]
    answer = run("ask", "Who regulates Alpha?")[0]
    assert answer["answer_text"] == "Alpha is regulated by Office of Things." and answer["claims"][0]["chunk_id"] == "d1_00000"
    assert run("ask", "Who regulates Alpha?", "--vector-only")[0]["route"] == "VECTOR"
    assert tables.decisions(spark, f"{at}/decisions").count() == 1

    (tmp_path / "golden.json").write_text(json.dumps({"items": [{"id": "q", "difficulty": "single_hop", "gold_entities": [["Office of Things"]]}]}))
    (tmp_path / "asked.json").write_text(json.dumps({"items": [{"id": "q", "question": "Who regulates Alpha?"}]}))
    report = run("benchmark", "--golden", str(tmp_path / "golden.json"), "--questions", str(tmp_path / "asked.json"))
    assert {r["accuracy"] for r in report if r["system"] == "hybrid"} == {1.0}


def test_the_warehouse_must_be_named(spark, monkeypatch):
    monkeypatch.delenv("SPARKWRIGHT_WAREHOUSE", raising=False)
    with pytest.raises(MissingSettings):
        main(["graph"], spark)
