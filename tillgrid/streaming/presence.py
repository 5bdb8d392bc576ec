"""Chat presence from join / message / disconnect events (ST6-ST8), batch form.

Per connection the state is online (after a join) or offline (initially, and
after a disconnect). A join while online only renames; a disconnect while
offline does nothing; so only transitions move the online count.

Events of one connection are ordered by (ts, id). The "previous state" of an
event is the kind of the last earlier join/disconnect of its connection, found
with ``strategy.carry_forward`` over even slices, so one very busy connection
does not become a single window partition. The global online count is a
running sum over slices of the same kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.operators.strategy import carry_forward, running_sum

ORDER = ["ts", "id"]
TS_MICRO = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def with_previous_state(events: DataFrame) -> DataFrame:
    """Adds ``prev_kind`` / ``prev_name``: kind and user name of the last earlier
    join or disconnect of the same connection (NULL before the first one)."""
    e = events.withColumn("_state", F.when(F.col("kind") != "message",
                                           F.struct(F.col("kind").alias("k"), F.col("username").alias("u"))))
    e = carry_forward(e, ["conn"], ORDER, "_state", "_prev")
    return (e.withColumn("prev_kind", F.col("_prev.k")).withColumn("prev_name", F.col("_prev.u"))
             .drop("_state", "_prev"))


def transitions(events: DataFrame) -> DataFrame:
    """Join/disconnect events with ``delta`` = +1 (comes online), -1 (goes offline) or 0."""
    e = with_previous_state(events).filter(F.col("kind") != "message")
    online_before = F.coalesce(F.col("prev_kind"), F.lit("disconnect")) == "join"
    delta = (F.when((F.col("kind") == "join") & ~online_before, 1)
              .when((F.col("kind") == "disconnect") & online_before, -1).otherwise(0))
    return e.withColumn("delta", delta.cast("long"))


def presence_counts(events: DataFrame) -> DataFrame:
    """ST6: the number of users online after each join/disconnect."""
    t = transitions(events)
    r = running_sum(t, [], ORDER, "delta", "en_ligne")
    return r.select("id", "ts", "conn", "kind", "delta", "en_ligne")


def gated_messages(events: DataFrame) -> DataFrame:
    """ST7: messages that are relayed: the connection's latest earlier
    join/disconnect is a join made under the message's user name."""
    e = with_previous_state(events).filter(F.col("kind") == "message")
    ok = (F.col("prev_kind") == "join") & (F.col("prev_name") == F.col("username"))
    return e.filter(ok).select("id", "ts", "conn", "username")


def presence_sessions(events: DataFrame) -> DataFrame:
    """ST8: sessions per connection: the join that brings it online -> the next
    disconnect. Repeated joins inside a session keep it open; an open session
    has NULL end and duration.

    Closed sessions come from each closing disconnect plus the last opening
    join carried forward to it; open sessions are connections whose last
    transition is an opening join (a grouped ``max_by``, no window).
    """
    t = transitions(events).filter(F.col("delta") != 0)
    t = t.withColumn("_open", F.when(F.col("delta") == 1, F.struct(
        F.col("ts").alias("ts"), F.col("username").alias("u"))))
    t = carry_forward(t, ["conn"], ORDER, "_open", "_start")
    closed = t.filter(F.col("delta") == -1).select(
        "conn", F.col("_start.u").alias("username"), F.col("_start.ts").alias("debut"), F.col("ts").alias("fin"))
    last = t.groupBy("conn").agg(F.max_by(F.struct("delta", "ts", "username"), F.struct(*ORDER)).alias("_l"))
    still_open = last.filter(F.col("_l.delta") == 1).select(
        "conn", F.col("_l.username").alias("username"), F.col("_l.ts").alias("debut"),
        F.lit(None).cast("timestamp_ntz").alias("fin"))
    s = closed.unionByName(still_open)
    # Wall-clock difference of two TIMESTAMP_NTZ values: independent of the session time zone.
    gap = F.timestamp_diff("MICROSECOND", F.col("debut"), F.col("fin"))
    return s.withColumn("duree_s", gap / F.lit(1e6))
