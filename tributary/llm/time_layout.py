"""Operator 13, adaptive time partitions: rows laid out in files by years, months, days or hours, as finely as their number asks for.

Rows are counted by hour; ROLLUP adds up days, months and years. A node above the limit has all its children as
siblings, the empty ones from calendar sequences; aggregate() folds the sorted siblings of each parent into runs. Rows
find their run by a range join, whose bins are years and days. Leaves above the limit, which only hours and the rows
without a moment can be, are cut by ranks: rows sorted by range over all tasks and numbered by their place in a task plus the
rows of the tasks before. A layout has about a thousand files whatever the input: runs next to each other hold more than
the limit together, so that leaves and their bins may be broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import drop_stored, shared_dir, small, stored, table

#: A node with more than 1 + rows // SHARES rows is split.
SHARES = 500
#: Columns of a leaf: 1 years, 2 months, 3 days, 4 hours, 0 no moment; first and last hour, as yyyymmddhh.
LEAF = ("level", "first", "last")

LEAVES = """
WITH parts AS (
  SELECT year(day) AS y, month(day) AS m, day(day) AS d, CAST(pmod(hour, 24) AS int) AS h, n
  FROM (SELECT hour, n, date_add(DATE'1970-01-01', CAST(floor(hour / 24) AS int)) AS day FROM {hours} WHERE hour IS NOT NULL)),
nodes AS (
  SELECT CASE grouping_id() WHEN 15 THEN 0 WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS level, y,
         24L * datediff(make_date(y, coalesce(m, 1), coalesce(d, 1)), DATE'1970-01-01') + coalesce(h, 0) AS first, sum(n) AS n
  FROM parts GROUP BY ROLLUP (y, m, d, h)),
over AS (SELECT level, first, date_add(DATE'1970-01-01', CAST(floor(first / 24) AS int)) AS day FROM nodes WHERE level BETWEEN 1 AND 3 AND n > :most),
calendar AS (
  SELECT 1 AS level, 0L AS parent, make_date(y, 1, 1) AS day, 0 AS h, make_date(y + 1, 1, 1) AS next_day, 0 AS next_h
  FROM (SELECT explode(sequence(min(y), max(y))) AS y FROM nodes WHERE level = 1)
  UNION ALL
  SELECT 2, first, at, 0, add_months(at, 1), 0 FROM (SELECT first, explode(sequence(day, add_months(day, 11), INTERVAL '1' MONTH)) AS at FROM over WHERE level = 1)
  UNION ALL
  SELECT 3, first, at, 0, date_add(at, 1), 0 FROM (SELECT first, explode(sequence(day, last_day(day), INTERVAL '1' DAY)) AS at FROM over WHERE level = 2)
  UNION ALL
  SELECT 4, first, day, h, CASE h WHEN 23 THEN date_add(day, 1) ELSE day END, pmod(h + 1, 24) FROM (SELECT first, day, explode(sequence(0, 23)) AS h FROM over WHERE level = 3)),
siblings AS (
  SELECT level, parent, 24L * datediff(day, DATE'1970-01-01') + h AS first, 24L * datediff(next_day, DATE'1970-01-01') + next_h AS stop FROM calendar),
families AS (
  SELECT s.level, s.parent, array_sort(collect_list(struct(s.first, s.stop, coalesce(n.n, 0L) AS n))) AS kids
  FROM siblings s LEFT JOIN nodes n ON n.level = s.level AND n.first = s.first GROUP BY s.level, s.parent),
runs AS (
  SELECT level, explode(aggregate(kids, CAST(array() AS array<struct<first: bigint, stop: bigint, n: bigint>>), (runs, kid) ->
    CASE WHEN size(runs) > 0 AND element_at(runs, -1).n + kid.n <= :most
         THEN concat(slice(runs, 1, size(runs) - 1), array(struct(element_at(runs, -1).first AS first, kid.stop AS stop, element_at(runs, -1).n + kid.n AS n)))
         ELSE concat(runs, array(kid)) END)) AS run
  FROM families)
SELECT level, run.first AS hour, run.stop AS stop, run.n AS n FROM runs WHERE run.n > 0 AND (run.n <= :most OR level = 4)
UNION ALL
SELECT 0, NULL, NULL, n FROM {hours} WHERE hour IS NULL
"""


def hour_of(moment: Column) -> Column:
    """Whole hours from 1970 to the moment, a timestamp without zone."""
    return F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(moment)


def _digits(hour: Column) -> Column:
    """An hour as yyyymmddhh."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(hour / 24).cast("int"))
    return ((F.year(day) * 100 + F.month(day)) * 100 + F.day(day)).cast("long") * 100 + F.pmod(hour, F.lit(24))


def label(level: str = "level", first: str = "first", last: str = "last") -> Column:
    """`2005-2007`, `2024/03-05`, `2024/03/05-09`, `2024/03/05/07-07` or `null`, from the columns of a leaf."""
    two = lambda at, unit: F.lpad((F.floor(F.col(at) / unit) % 100).cast("string"), 2, "0")
    year = lambda at: F.lpad(F.floor(F.col(at) / 1_000_000).cast("string"), 4, "0")
    span = lambda unit: F.concat(two(first, unit), F.lit("-"), two(last, unit))
    by = F.col(level)
    return (
        F.when(by == 1, F.concat(year(first), F.lit("-"), year(last)))
        .when(by == 2, F.concat_ws("/", year(first), span(10_000)))
        .when(by == 3, F.concat_ws("/", year(first), two(first, 10_000), span(100)))
        .when(by == 4, F.concat_ws("/", year(first), two(first, 10_000), two(first, 100), span(1)))
        .otherwise("null")
    )


def leaves(hours: DataFrame, most: int) -> DataFrame:
    """level, first, last, hour, stop and n of each leaf, from hour and n, the numbers of rows by hour (hour null: those without a moment).

    A sibling joins the run of the one before it if both together stay within most, so one above most stands alone. Runs without rows
    are no leaves. No hours: no leaves.
    """
    spark = hours.sparkSession
    out = spark.sql(LEAVES, args={"most": most}, hours=hours)
    return out.select("level", F.coalesce(_digits(F.col("hour")), F.lit(0)).alias("first"), F.coalesce(_digits(F.col("stop") - 1), F.lit(0)).alias("last"), "hour", "stop", "n")


class Layout:
    """Rows of one table kept in a folder as files of at most `most` rows, a file a part of a leaf.

    rows: the table. moment: its time, a timestamp without zone, null allowed. order: columns by which rows stand in a
    leaf after their moment, nulls first; equal rows among them stand by a hash of all columns. new: true for rows that the folder does not
    have yet when update() is called. Columns of the table may have any names; repeated rows are kept. A table without rows gives an empty folder.
    """

    def __init__(self, folder: str, most: int, moment: Column, order: list[str], new: Column):
        self.folder, self.most, self.moment, self.order, self.new = folder, most, moment, order, new

    def _keyed(self, rows: DataFrame) -> DataFrame:
        keys = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(self.order)]
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
        return rows.select(whole, self.moment.alias("moment"), *keys, F.coalesce(self.new, F.lit(True)).alias("new")).withColumn("hour", hour_of(F.col("moment")))

    def _sorted_by(self) -> list[str]:
        return ["moment", *(f"o{i}" for i in range(len(self.order))), "tie"]

    def _in_leaves(self, keyed: DataFrame, found: DataFrame) -> DataFrame:
        """keyed with the columns LEAF and n, the rows of the leaf: a range join whose bins are the years of runs of years and the days of all others."""
        bins = found.select(F.struct(*LEAF, "n").alias("at"), F.col("hour").alias("start"), "stop")
        whole = lambda hour: F.floor(hour / 24)
        days = bins.filter("at.level > 1").select(F.explode(F.sequence(whole(F.col("start")), whole(F.col("stop") - 1))).alias("d_bin"), "start", "stop", F.col("at").alias("fine"))
        none = bins.filter("at.level = 0").select(F.lit(None).cast("long").alias("d_bin"), "start", "stop", F.col("at").alias("fine"))
        year = lambda c: F.floor(F.col(c) / 1_000_000)
        years = bins.filter("at.level = 1").select(F.explode(F.sequence(year("at.first"), year("at.last"))).alias("y_bin"), F.col("at").alias("coarse"))
        rows = keyed.withColumns({"day": whole(F.col("hour")), "year": F.year("moment").cast("long")})
        within = F.col("hour").isNull() | (F.col("hour") >= F.col("start")) & (F.col("hour") < F.col("stop"))
        rows = rows.join(F.broadcast(days.union(none)), F.col("day").eqNullSafe(F.col("d_bin")) & within, "left").join(F.broadcast(years), F.col("year") == F.col("y_bin"), "left")
        return rows.withColumn("leaf", F.coalesce("fine", "coarse")).select(*keyed.columns, "leaf.*")

    def _cut(self, placed: DataFrame) -> DataFrame:
        """The rows of leaves above the limit with their part: sorted by range over all tasks, ranked by their place and the rows before. A stored table."""
        order = [*LEAF, *self._sorted_by()]
        numbered = stored(placed.filter(F.col("n") > self.most).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
        task = F.shiftright("at", 33).alias("task")
        heads = numbered.groupBy(*LEAF, task).agg(F.min("at").alias("start"), F.count("*").alias("size"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*LEAF).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        heads = stored(heads.select(*LEAF, "task", (before - F.col("start")).alias("shift")), "heads")
        part = (F.floor((F.col("at") + F.col("shift")) / self.most) + 1).alias("part")
        out = stored(numbered.withColumn("task", task).join(small(heads), [*LEAF, "task"]).select(*placed.columns, part), "parts")
        drop_stored(numbered, heads)
        return out

    def _names(self, spark: SparkSession) -> set[str]:
        """Names of the folder's data files, of which there are about a thousand."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        return {n for f in (fs.listStatus(at) if fs.exists(at) else []) if (n := f.getPath().getName()).startswith("part-")}

    def _delete(self, spark: SparkSession, names: set[str]) -> None:
        for name in names:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)

    def _written(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        """The files of plan with their names. A task writes one file, sorted, and its number is the file's."""
        spark, before, n = rows.sparkSession, self._names(rows.sparkSession), plan.count()
        numbered = stored(plan.withColumn("no", F.row_number().over(Window.orderBy(*LEAF, "part")) - 1), "numbered")
        dealt = rows.join(F.broadcast(numbered.select(*LEAF, "part", "no")), [*LEAF, "part"]).repartitionById(max(n, 1), F.col("no")).sortWithinPartitions(*self._sorted_by())
        dealt.select("row.*").write.mode("append").option("maxRecordsPerFile", 0).parquet(self.folder)
        new = sorted(self._names(spark) - before)
        names = spark.createDataFrame([(int(x.split("-")[1]), x) for x in new], "no int, name string")
        out = stored(numbered.join(F.broadcast(names), "no").drop("no"), "written")
        drop_stored(numbered)
        return out

    def update(self, rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """Lay the table out anew: files whose leaf, part and rows recur stay, all others are written or go.

        files: what the last update() of the folder returned. Rows in the folder must be among rows, those that are not `new`; so a file recurs if no new
        row stands before its end in its leaf and it has as many rows. Returns LEAF, part, n_rows, name and rewritten of each file, a stored table. A
        job that fails midway leaves the old files in place; they go after the new ones are written.
        """
        spark = rows.sparkSession
        keyed = self._keyed(rows).withColumn("tie", F.xxhash64("row"))
        hours = stored(keyed.groupBy("hour").agg(F.count("*").alias("n")), "hours")
        found = stored(leaves(hours, self.most), "leaves")
        placed = self._in_leaves(keyed, found)
        cut = self._cut(placed)
        parts = placed.filter(F.col("n") <= self.most).withColumn("part", F.lit(1).cast("long")).unionByName(cut)
        plan = parts.groupBy(*LEAF, "part").agg(F.count("*").alias("n_rows"), F.count_if("new").alias("n_new"))
        upto = F.sum("n_new").over(Window.partitionBy(*LEAF).orderBy("part"))
        plan = plan.select(*LEAF, "part", "n_rows", (upto == 0).alias("old"))
        if files is None:
            plan = plan.withColumn("name", F.lit(None).cast("string"))
        else:
            plan = plan.join(files.select(*LEAF, "part", F.col("n_rows").alias("had"), "name"), [*LEAF, "part"], "left")
            plan = plan.withColumn("name", F.when(F.col("old") & (F.col("had") == F.col("n_rows")), F.col("name")))
        plan = stored(plan.select(*LEAF, "part", "n_rows", "name"), "plan")
        new = self._written(parts, plan.filter("name IS NULL").drop("name"))
        out = stored(plan.filter("name IS NOT NULL").withColumn("rewritten", F.lit(False)).unionByName(new.withColumn("rewritten", F.lit(True))), "files")
        self._delete(spark, self._names(spark) - {r.name for r in out.select("name").collect()})  # about a thousand names
        drop_stored(hours, found, cut, plan, new)
        return out

    def digests(self, rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
        """LEAF, part, n_rows, n_new, ids_sha256 (the key's values in the order of the file, comma-joined; null is left empty), name and rewritten of each of files, as read back from the folder.

        A file's rows meet in one task, sorted by their place, and stream through it.
        """
        got = rows.sparkSession.read.schema(rows.schema).parquet(self.folder)
        lines = got.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("place"), F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(self.new, F.lit(True)).alias("new"))
        lines = lines.join(F.broadcast(files.select("name", *LEAF, "part")), "name")
        dealt = lines.repartition(*LEAF, "part").sortWithinPartitions(*LEAF, "part", "place").select(*LEAF, "part", "key", "new")
        sums = dealt.mapInArrow(_digested, "level int, first long, last long, part long, n_rows long, n_new long, ids_sha256 string")
        return sums.join(F.broadcast(files.select(*LEAF, "part", "name", "rewritten")), [*LEAF, "part"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file from rows sorted by file; only the digest so far is held."""
    at, digest, n, new = None, None, 0, 0
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 7
        kinds = [pa.int32(), *[pa.int64()] * 5, pa.string()]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*LEAF, "part", "n_rows", "n_new", "ids_sha256"])

    for batch in batches:
        spots = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        ids, fresh = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        i = 0
        while i < len(spots):
            j = i
            while j < len(spots) and spots[j] == spots[i]:
                j += 1
            if spots[i] != at:
                if at is not None:
                    done.append((*at, n, new, digest.hexdigest()))
                at, digest, n, new = spots[i], hashlib.sha256(), 0, 0
            digest.update(("," * (n > 0) + ",".join(x or "" for x in ids[i:j])).encode())
            n, new, i = n + j - i, new + sum(fresh[i:j]), j
        yield flush()
    if at is not None:
        done.append((*at, n, new, digest.hexdigest()))
    yield flush()


def click_moment(ts: Column, click_id: Column) -> Column:
    """The contract's moment: k = crc32 of the decimal id mod 128; below 16 the time goes (k + 6) ** 3 days back, above 111 to its Monday. No id: the time as it is."""
    k = (F.crc32(click_id.cast("string")) % 128).cast("int")
    ts, back = ts.cast("timestamp_ntz"), k + 6
    monday = F.date_sub(ts.cast("date"), F.weekday(ts.cast("date"))).cast("timestamp_ntz")
    return F.when(k < 16, ts - F.make_dt_interval(back * back * back)).when(k > 111, monday).otherwise(ts)


def op13_time_partitions(spark: SparkSession, sf_dir: str, cutoff: str = "2024-05-01 00:00:00", folder: Callable[[SparkSession], str] | None = None) -> DataFrame:
    """`clicks` that arrived before the cutoff, then all of them, laid out in one new folder; a row for each final file, as the contract asks.

    Rows without arrived_at are new. An empty table gives no rows, its folder no data files.
    """
    rows = table(spark, sf_dir, "clicks")
    most = 1 + rows.count() // SHARES
    at = folder(spark) if folder else f"{shared_dir(spark)}/time-layout-{uuid.uuid4().hex}"
    early = F.coalesce(F.col("arrived_at") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    layout = Layout(at, most, click_moment(F.col("ts"), F.col("click_id")), ["arrived_at", "click_id"], ~early)
    start = layout.update(rows.filter(early))
    files = layout.update(rows, start)
    drop_stored(start)
    path = F.concat(F.lit(at + "/"), "name").alias("path")
    return layout.digests(rows, files, "click_id").select(label().alias("leaf"), F.lit(",".join(rows.columns)).alias("columns"), "ids_sha256", path, "part", "n_rows", "n_new", "rewritten")
