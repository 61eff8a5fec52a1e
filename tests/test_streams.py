import pytest

from tests.test_queries import plain, rows
from tributary.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_rates", "stream_sessions", "stream_high_water", "stream_session_history", "stream_base_lists"])
def test_a_table_of_part_files_gives_the_same(spark, tmp_path, name):
    spark.read.parquet(f"{DIR}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/events.parquet.old")
    one, many = (registry.queries()[name](spark, at) for at in (DIR, str(tmp_path)))
    assert one.columns == many.columns and plain(one.count()) > 0
    assert rows(one.columns, one.collect()) == rows(many.columns, many.collect())


def test_requests_collapse_and_reorderings_expire(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from tributary.streaming import base_lists
    from tributary.streaming.incremental import finished

    def batch(n, rows):
        made = spark.createDataFrame([(i, dt.datetime(2024, 1, day, hour), uid, kind, f'{{"k": {k}}}') for i, (day, hour, uid, kind, k) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, props string")
        made.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    batch(1, [(1, 0, 1, "purchase", 7), (1, 1, 1, "purchase", 8), *[(1, 2, 1, "view", i) for i in range(10)], (1, 3, 2, "click", 1)])
    batch(2, [(5, 0, 1, "view", 1), (20, 0, 3, "view", 1)])
    batch(3, [(21, 0, 1, "view", 1), (21, 1, 3, "purchase", 4), (21, 1, 3, "purchase", 9), (21, 2, 3, "view", 1)])
    schema = "event_id long, ts timestamp, user_id long, event_type string, props string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")  # the files in the order of their times
    got = finished(base_lists.base_lists(events), "update").withColumn("day", F.dayofmonth(F.timestamp_micros("at"))).collect()
    rows = sorted((r.uid, r.day, r.asked, r.rn, r.aid) for r in got)
    assert rows == [(1, 1, 10, 1, 8), (1, 1, 10, 2, 7), (1, 5, 1, 1, 8), (1, 5, 1, 2, 7), (1, 21, 1, 0, None), (2, 1, 1, 0, None), (3, 20, 1, 0, None), (3, 21, 1, 1, 4), (3, 21, 1, 2, 9)]


def test_a_later_reordering_hides_none_before_the_request():
    from tributary.streaming import base_lists

    day = 86_400_000_000
    moves = {(7, 10 * day), (7, 12 * day), (8, 9 * day), (9, 13 * day)}
    assert base_lists.listed(moves, 11 * day) == [7, 8]
    assert base_lists.listed(moves, 12 * day) == [7, 8] and base_lists.listed(moves, 8 * day) == []
