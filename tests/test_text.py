import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwright.functions import text as X

NAMES = {"Foo Inc.": "foo", "Foo Holdings, Inc.": "foo", "Inc": "inc", "  A.B. Co  ": "ab", "Bar Group LLC": "bar", "Élan L.L.C.": "élan", "Café & Söhne GmbH": "café söhne gmbh", "": "", "x,  y Corp": "x y"}


def test_normalize_name(spark):
    rows = spark.createDataFrame([(k,) for k in NAMES], "n string").select("n", X.normalize_name(F.col("n")).alias("m")).collect()
    assert {r["n"]: r["m"] for r in rows} == NAMES


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .,Icno-é", max_size=20), min_size=1, max_size=30))
def test_normalize_name_again_changes_only_new_suffixes(spark, names):
    """What comes out has no punctuation, no double spaces and nothing at its ends."""
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(X.normalize_name(F.col("n")).alias("m")).collect()
    for r in rows:
        assert r["m"] == re.sub(r"\s+", " ", r["m"]).strip().lower() and not re.search(r"[^\w\s]", r["m"])


def test_header_key(spark):
    rows = spark.createDataFrame([("PART  I",), ("Item 1A. Risk Factors",), ("item 7.",), ("Items",)], "p string").select(X.header_key(F.col("p")).alias("k")).collect()
    assert [r["k"] for r in rows] == ["PART__I", "ITEM_1A", "ITEM_7", ""]


def test_hash_and_key(spark):
    r = spark.range(1).select(X.content_hash(F.lit("a")).alias("h"), X.chunk_id(F.lit("d"), F.lit(7)).alias("c"), X.is_hash(F.lit("A" * 64)).alias("ok"), X.is_hash(F.lit("xyz")).alias("bad")).first()
    assert r["h"].startswith("ca978112") and r["c"] == "d_00007" and r["ok"] and not r["bad"]
