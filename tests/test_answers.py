from pyspark.sql import functions as F

from sparkwright.operators import answers, grading, routing

STATED = "pos int, text string, source_chunk_ids array<string>"
PASSAGES = "pos int, chunk_id string, section_path string, company string, text string"


def shown(spark, stated=(), passages=()):
    return answers.evidence(spark.createDataFrame(list(stated), STATED), spark.createDataFrame(list(passages), PASSAGES))


def test_context(spark):
    rows = shown(spark, [(0, "A supplies B.", ["c1", "c2"]), (1, "A acquired 0 entities ().", [])], [(0, "c9", "S", "Acme", "hello")])
    assert answers.context(rows).first()[0] == "=== GRAPH FACTS ===\n[c1] A supplies B.\n[graph_fact_1] A acquired 0 entities ().\n\n=== VECTOR PASSAGES ===\n[c9] (S, Acme) hello"
    assert answers.context(shown(spark)).first()[0] == "(no evidence retrieved)"
    assert {r[0] for r in answers.retrieved_ids(rows).collect()} == {"c1", "graph_fact_1", "c9"}


def test_regenerates_once(spark):
    asked = []

    def answerer(question, lines, correction):
        asked.append(correction)
        return [("good", "c1"), ("bad", "zz"), ("worse", "yy")], None

    r = answers.answer(shown(spark, [(0, "t", ["c1"])]), "q", answerer).first()
    assert asked == [None, "yy, zz"] and r["answer_text"] == "good" and len(r["rejected_claims"]) == 2


def test_accepts_at_once_and_without_evidence(spark):
    r = answers.answer(shown(spark, [(0, "A supplies B.", ["c1"])])).first()
    assert r["answer_text"] == "A supplies B." and [tuple(c) for c in r["claims"]] == [("A supplies B.", "c1")]
    assert answers.answer(shown(spark)).first()["answer_text"] == "The retrieved evidence does not answer the question."
    assert answers.answer(shown(spark), "q", lambda *_: ([], None)).first()["answer_text"] == answers.NO_ANSWER


def test_claims_split(spark):
    claims = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "text string, chunk_id string")
    good, bad = answers.split_claims(claims, spark.createDataFrame([("1",)], "chunk_id string"))
    assert good.count() == 2 and [r["text"] for r in bad.collect()] == ["b"] and answers.invalid_list(bad) == "2"


def test_grading(spark):
    rows = [("out_of_scope", 0, "x", None, True), ("out_of_scope", 1, "x", None, False), ("single_hop", 1, "x", [], True), ("single_hop", 0, "x", None, False), ("two_hop", 1, "Amd and INTEL", [["AMD", "Advanced"], ["Intel"]], True), ("two_hop", 1, "amd", [["AMD"], ["Intel"]], False)]
    got = grading.grade(spark.createDataFrame(rows, "difficulty string, n_claims int, answer_text string, gold_entities array<array<string>>, want boolean"))
    assert all(r["correct"] == r["want"] for r in got.collect())
    acc = {r["difficulty"]: r["accuracy"] for r in grading.accuracy(got).collect()}
    assert acc[None] == 0.5 and acc["two_hop"] == 0.5
    empty = got.limit(0)
    assert [tuple(r) for r in grading.accuracy(empty).collect()] == [(None, None, 0)] and grading.mean_latency(empty.withColumn("latency_ms", F.lit(1.0))).first()[0] == 0.0


def test_routing(spark):
    rows = spark.createDataFrame([("GRAPH", 0.4), ("GRAPH", 0.95), ("BOTH", 0.1), ("VECTOR", 0.6)], "route string, confidence double")
    assert [(r["route"], r["overridden"]) for r in routing.override(rows).collect()] == [("BOTH", True), ("GRAPH", False), ("BOTH", False), ("VECTOR", False)]
    asked = spark.createDataFrame([("Whom does Acme supply?",), ("How many companies does Acme supply?",), ("How are Acme and Beta connected?",), ("What is the weather?",)], "question string")
    got = [(r["route"], r["query_type"], r["entity_names"]) for r in routing.classify(asked, ["Acme", "Beta"]).collect()]
    assert got == [("GRAPH", "one_hop", ["Acme"]), ("GRAPH", "aggregate_count", ["Acme"]), ("GRAPH", "path_between", ["Acme", "Beta"]), ("VECTOR", None, [])]
