import datetime as dt

from pyspark.sql import functions as F

from tributary.sources import harvest


def made(spark, n):
    rows = spark.range(n).select(F.col("id").alias("place"), F.col("id").cast("string").alias("aid"), F.lit("physics").alias("area"), F.lit("2024-01-02").alias("day"))
    return rows.withColumn("status", F.when(F.col("place") % 10 == 3, "deleted")).withColumn("abstract", F.concat(F.lit("a < b & "), "aid"))


def test_a_stop_in_the_middle_loses_and_repeats_nothing(spark, tmp_path):
    assert harvest.record(made(spark, 95), f"{tmp_path}/all", 10) == 10
    (tmp_path / "in").mkdir()
    give = lambda name: (tmp_path / "in" / name).write_bytes((tmp_path / "all" / name).read_bytes())
    for name in ("start.xml", "p1.xml", "p2.xml", "p5.xml"):  # p5 is recorded, but nothing leads to it yet
        give(name)
    ids = lambda df: sorted(int(r.aid) for r in df.collect())
    first = harvest.harvested(spark, f"{tmp_path}/in", f"{tmp_path}/table")
    assert ids(first) == [i for i in range(30) if i % 10 != 3]
    again = harvest.harvested(spark, f"{tmp_path}/in", f"{tmp_path}/table")
    assert ids(again) == ids(first)
    for i in range(3, 10):
        give(f"p{i}.xml")
    (tmp_path / "in" / "p4.xml").write_text("<error>no listing</error><resumptionToken>p5</resumptionToken>")
    whole = harvest.harvested(spark, f"{tmp_path}/in", f"{tmp_path}/table")
    assert ids(whole) == [i for i in range(95) if i % 10 != 3 and i // 10 != 4]
    one = whole.filter("aid = '94'").first()
    assert (one.page, one.area, one.day, one.abstract) == (9, "physics", dt.date(2024, 1, 2), "a < b & 94")
    reader = harvest._Reader({"path": f"{tmp_path}/in"})
    assert reader.latestOffset() == {"pages": 10} and [p.token for p in reader.partitions({"pages": 2}, {"pages": 4})] == ["p2", "p3"]
    assert [p.token for p in harvest._Reader({"path": f"{tmp_path}/in"}).partitions({"pages": 8}, {"pages": 10})] == ["p8", "p9"]  # a reader after a restart


def test_no_responses_yet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert harvest._Reader({"path": f"{tmp_path}/in"}).latestOffset() == {"pages": 0}
