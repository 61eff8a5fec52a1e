"""Base lists that users' own reordering replaces until it expires, and requests for lists that collapse to one recomputation.

A user's state is what they moved and when; event time takes each piece out again, so a state lives no longer than EXPIRY after its last reordering. All
requests of a user in a batch give one list, that of the newest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tributary.plans import dialect
from tributary.streaming.incremental import finished, stream

#: How long a reordering holds, how late an action may come, and articles of a list.
EXPIRY_DAYS, LATE, LENGTH = 7, "1 day", 20
EXPIRY = EXPIRY_DAYS * 86_400_000_000

OUT = "uid long, asked long, at long, rn int, aid long"


def listed(moves: set[tuple[int, int]], at: int) -> list[int]:
    """Articles of moves (article, time) within EXPIRY before `at`, the last moved first; of a tie the lower id. A move after `at` hides none before it."""
    last: dict[int, int] = {}
    for a, t in moves:
        if at - EXPIRY < t <= at:
            last[a] = max(t, last.get(a, t))
    return [a for _, a in sorted((-t, a) for a, t in last.items())[:LENGTH]]


def recompute(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One list for the newest of a batch's requests: asked is their number. An empty list is a row with rn 0. Expiry alone gives no list.

    Rows: us (microseconds), moves (whether the action reorders, else it asks), aid. Actions come in any order.
    """
    moved: set[tuple[int, int]] = set(zip(*state.get)) if state.exists else set()
    asked = newest = 0
    if not state.hasTimedOut:
        for batch in batches:
            for us, moves, aid in zip(batch["us"], batch["moves"], batch["aid"]):
                if moves:
                    if pd.notna(aid):
                        moved.add((int(aid), int(us)))
                else:
                    asked, newest = asked + 1, max(newest, int(us))
    now = state.getCurrentWatermarkMs() * 1000
    if asked:
        out = listed(moved, newest)
        yield pd.DataFrame([(key[0], asked, newest, i, a) for i, a in enumerate(out, 1)] or [(key[0], asked, newest, 0, None)], columns=["uid", "asked", "at", "rn", "aid"]).astype({"aid": "Int64"})
    # requests may still come as late as the watermark; what no such request would see goes
    moved = {(a, t) for a, t in moved if t > now - EXPIRY}
    if moved:
        articles, times = zip(*sorted(moved))
        state.update((list(articles), list(times)))
        state.setTimeoutTimestamp(max(min(times) + EXPIRY, now + 1_000) // 1000 + 1)
    elif state.exists:
        state.remove()


def base_lists(events: DataFrame) -> DataFrame:
    """OUT from a stream with event_id, ts (timestamp), user_id, event_type and props."""
    aid = F.get_json_object("props", "$.k").cast("long").alias("aid")
    rows = events.withWatermark("ts", LATE).filter("event_type IN ('purchase', 'view', 'click') AND user_id IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select(F.col("user_id").cast("long").alias("uid"), "ts", F.unix_micros("ts").alias("us"), (F.col("event_type") == "purchase").alias("moves"), aid)
    return rows.groupBy("uid").applyInPandasWithState(recompute, OUT, "aids array<long>, times array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def stream_base_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last list: for their newest request, what they had taken in the days before, the last first; rn 0 where that is nothing."""
    made = finished(base_lists(stream(spark, sf_dir, "events")), "update")
    last = made.withColumn("last", F.max("at").over(Window.partitionBy("uid"))).filter("at = last")
    return last.select("uid", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "rn", "aid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"stream_base_lists": stream_base_lists}


def oracle_sql() -> dict[str, str]:
    sql = f"""SELECT r.uid, r.at, CAST(coalesce(m.rn, 0) AS INT) AS rn, m.aid FROM r LEFT JOIN (SELECT uid, aid, row_number() OVER (PARTITION BY uid ORDER BY t DESC, aid) AS rn
        FROM (SELECT a.uid, a.aid, max(a.t) AS t FROM act a JOIN r ON a.uid = r.uid WHERE a.kind = 'purchase' AND a.aid IS NOT NULL AND a.t <= r.at AND a.t > r.at - INTERVAL '{EXPIRY_DAYS}' DAY
        GROUP BY a.uid, a.aid) x) m ON r.uid = m.uid AND m.rn <= {LENGTH}"""
    ctes = "r AS (SELECT uid, max(t) AS at FROM act WHERE kind IN ('view', 'click') GROUP BY uid)"
    return {"stream_base_lists": dialect.text(dialect.Query(sql, ctes))}
