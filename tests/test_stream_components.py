import random

from sparkwright.operators.components import components
from sparkwright.streaming import components as kept

SHAPE = "a long, b long"


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_batches_in_any_order(spark, tmp_path):
    """The same as all links at once; a batch that comes again changes nothing, and a name changes only for a lesser node."""
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(48)] + [(100 - i, 99 - i) for i in range(12)] + [(200, 200)]
    rng.shuffle(links)
    want = {n: c for n, c in told(components(spark.createDataFrame(links, SHAPE)))}
    at = str(tmp_path / "c")
    before = {}
    for k in range(3):
        batch = spark.createDataFrame(links[k::3], SHAPE)
        kept.add_links(batch, k, at)
        now = dict(told(kept.current(spark, at)))
        assert all(now[n] <= c for n, c in before.items())
        before = now
    alone = {n: n for pair in links for n in pair}
    assert before == alone | want
    kept.add_links(spark.createDataFrame(links[1::3], SHAPE), 1, at)
    assert dict(told(kept.current(spark, at))) == before


def test_stream_that_grows(spark, tmp_path):
    landing, at, checkpoint = (str(tmp_path / k) for k in ("in", "out", "mark"))

    def land(rows):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(landing)
        kept.merge_links(spark.readStream.schema(SHAPE).parquet(landing), at, checkpoint).awaitTermination()
        return told(kept.current(spark, at))

    assert land([(5, 6), (8, 9)]) == [(5, 5), (6, 5), (8, 8), (9, 8)]
    assert land([(9, 6), (None, 6)]) == [(5, 5), (6, 5), (8, 5), (9, 5)]
    assert land([(1, 9)]) == [(1, 1), (5, 1), (6, 1), (8, 1), (9, 1)]
    kept.merge_links(spark.readStream.schema(SHAPE).parquet(landing), at, checkpoint).awaitTermination()
    assert told(kept.current(spark, at)) == [(1, 1), (5, 1), (6, 1), (8, 1), (9, 1)]


def test_no_links(spark, tmp_path):
    kept.add_links(spark.createDataFrame([], SHAPE), 0, str(tmp_path / "c"))
    assert told(kept.current(spark, str(tmp_path / "c"))) == []


def test_links_of_a_batch_are_made_once(spark, tmp_path):
    """What makes a batch's links may be costly: it runs once a batch."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    links = spark.range(0, 40, 1, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).mapInArrow(count, "a long, b long")
    kept.add_links(links, 0, str(tmp_path))
    assert made.value == 40 and kept.current(spark, str(tmp_path)).filter("component = 0").count() == 41
