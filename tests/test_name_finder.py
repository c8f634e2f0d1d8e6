import random

from sparkwright.operators import name_finder


def brute(texts, names):
    return sorted((k, t.lower().find(n.lower()), n) for k, t in texts if t for n in set(names) if n and n.lower() in t.lower())


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_one_automaton_and_parts(spark):
    """Overlapping names, names within names, names that differ in case only, odd rows; in one automaton and in several."""
    rng = random.Random(2)
    names = ["".join(rng.choice("abAB ") for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["Ab", "aB", "über", None, "", "Σ"]
    texts = [(i, "".join(rng.choice("abcABü ") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "ÜBER alles"), (103, "x" * 50_000 + "ab")]
    rows = spark.createDataFrame(texts, "id int, text string")
    known = spark.createDataFrame([(n,) for n in names * 2], "name string")
    want = brute(texts, [n for n in names if n])
    assert told(name_finder.find_names(rows, known, "id")) == want and len(want) > 500
    assert told(name_finder.find_names(rows, known, "id", automaton_bytes=100)) == want


def test_nothing(spark):
    rows = spark.createDataFrame([(1, "some text")], "id int, text string")
    none = spark.createDataFrame([], "name string")
    assert told(name_finder.find_names(rows, none, "id")) == []
    assert told(name_finder.find_names(rows.limit(0), spark.createDataFrame([("a",)], "name string"), "id")) == []


def test_a_set_of_questions_is_routed_as_each_by_itself(spark):
    from sparkwright.operators import routing

    names = ["Acme", "Acme Labs", "Borel", "Supplies Inc", "FTC"]
    asked = ["Who is regulated by the FTC?", "How are Acme Labs and Borel connected?", "How many companies does Supplies Inc supply?", "Why does acme compete with Borel?", "What is the weather?", "Acme?", "What do competitors of borel supply?", ""]
    rows = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    fields = ["question_id", "route", "confidence", "entity_names", "query_type", "relationship_type", "second_relationship_type", "max_hops"]
    got = {r[0]: r for r in routing.classify_set(rows, spark.createDataFrame([(n,) for n in names], "name string")).select(fields).collect()}
    for i, q in enumerate(asked):
        known = [n for n in names if n.lower() in q.lower()]
        want = routing.classify(rows.filter(f"question_id = {i}"), known).select(fields).first()
        assert got[i] == want, q


def test_texts_do_not_meet_each_part_of_the_names(spark):
    """However many names there are, a text is not sent to all of them: what is shuffled grows with what is found."""
    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    names = [f"name{i:05d}x" for i in range(500)]
    texts = [(i, f"of name{i:05d}X and nobody") for i in range(400)]
    before = shuffled()
    got = told(name_finder.find_names(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "id", automaton_bytes=100))
    assert got == [(i, 3, names[i]) for i in range(400)]
    assert shuffled() - before < 20_000  # each text to each of the 100 parts would be 40,000
