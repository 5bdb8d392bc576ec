"""Chat presence as streams (ST6-ST8): state per connection, events put back in order.

Events may arrive late, up to the watermark's delay. One stateful operator, keyed by a hash bucket of connections,
keeps those that wait in list state; an event-time timer lets them go in (ts, id) order once the watermark has passed them,
through each connection's state: its last join or disconnect and the session that is open. A call to the state store costs as
much as many events, so a bucket's events and its connections' states cross it as Arrow tables, not one by one. What is let
go in one trigger lies wholly after what was let go in the triggers before, which the running online count
(ST6) uses: it adds up a trigger's transitions over even slices, on top of what committed triggers left.

State lives in RocksDB with changelog checkpoints (``session.durable_state``), so it may outgrow the heap and a
restart goes on from the last committed trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tillgrid.operators.strategy import running_sum
from tillgrid.session import durable_state, written
from tillgrid.sources.commits import read_committed, write_batch

DELAY = "1 day"

#: Connections are dealt to so many keys of the stateful operator.
BUCKETS = 1024
#: Rows of an Arrow table in state at most, and of the rows made at once.
CHUNK = 50_000
EVENT = ["conn", "us", "id", "kind", "username"]
STATE = ["kind", "username", "opened_id", "opened_us", "opened_by"]
_TYPES = {"kind": "string", "username": "string", "opened_by": "string"}  # all others are long
#: A released event: ``delta`` as in the batch form (null for messages), ``relayed`` for messages, and
#: the session it opens or closes.
RELEASED = T.StructType([
    T.StructField("conn", T.LongType()), T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("username", T.StringType()), T.StructField("delta", T.LongType()), T.StructField("relayed", T.BooleanType()),
    T.StructField("opened_id", T.LongType()), T.StructField("opened_us", T.LongType()), T.StructField("opened_by", T.StringType())])
COUNTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("us", T.LongType()), T.StructField("conn", T.LongType()),
                       T.StructField("kind", T.StringType()), T.StructField("delta", T.LongType()), T.StructField("en_ligne", T.LongType())])
MESSAGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("us", T.LongType()), T.StructField("conn", T.LongType()),
                         T.StructField("username", T.StringType())])
SESSIONS = T.StructType([T.StructField("conn", T.LongType()), T.StructField("opened_id", T.LongType()), T.StructField("username", T.StringType()),
                         T.StructField("debut_us", T.LongType()), T.StructField("fin_us", T.LongType())])


def advance(state: tuple | None, event: tuple) -> tuple[tuple | None, tuple]:
    """State of a connection after one event, and what the event releases (delta, relayed, opened_id, opened_us, opened_by)."""
    us, id_, kind, name = event
    before, last_name, *opened = state or (None, None, None, None, None)
    if kind == "message":
        return state, (None, before == "join" and last_name is not None and last_name == name, None, None, None)
    if kind == "join":
        if before == "join":
            return ("join", name, *opened), (0, None, None, None, None)
        return ("join", name, id_, us, name), (1, None, id_, us, name)
    if before == "join":
        return ("disconnect", name, None, None, None), (-1, None, *opened)
    return ("disconnect", name, None, None, None), (0, None, None, None, None)


def _schema(names: list[str]):
    import pyarrow as pa
    return pa.schema([(n, pa.string() if n in _TYPES else pa.int64()) for n in names])


def _packed(table) -> list[tuple[bytes]]:
    """State rows of an Arrow table."""
    import pyarrow as pa
    out = []
    for at in range(0, table.num_rows, CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table.slice(at, CHUNK))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(rows: Iterator[tuple], names: list[str]):
    import pyarrow as pa
    return pa.concat_tables([_schema(names).empty_table(), *(pa.ipc.open_stream(bytes(r[0])).read_all() for r in rows)])


class Presence(StatefulProcessor):
    """One bucket of connections: waiting events and the connections' states in list states, a timer for the first that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.status = handle.getListState("status", "connections binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        new = [pa.Table.from_pandas(pdf[EVENT], _schema(EVENT), preserve_index=False) for pdf in rows if len(pdf)]
        if new:
            events = pa.concat_tables(new)
            self.waiting.appendList(_packed(events))
            self._wake(events)
        yield from ()

    def _wake(self, events) -> None:
        import pyarrow.compute as pc
        self.handle.registerTimer(-(-pc.min(events["us"]).as_py() // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.compute as pc
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = _unpacked(self.waiting.get(), EVENT)
        due = pc.less_equal(events["us"], passed)
        ready, later = events.filter(due), events.filter(pc.invert(due))
        if not ready.num_rows:  # those that wait have timers of their own
            return
        if later.num_rows:
            self.waiting.put(_packed(later))
            self._wake(later)
        else:
            self.waiting.clear()
        known = _unpacked(self.status.get(), ["conn", *STATE])
        status = {conn: state for conn, *state in zip(*(c.to_pylist() for c in known.columns), strict=True)}
        ready = ready.sort_by([(c, "ascending") for c in EVENT])
        for at in range(0, ready.num_rows, CHUNK):
            out = []
            for conn, *event in zip(*(c.to_pylist() for c in ready.slice(at, CHUNK).columns), strict=True):
                state, released = advance(status.get(conn), event)
                if state is not None:
                    status[conn] = state
                out.append((conn, *event, *released))
            yield pd.DataFrame({f.name: pd.Series([r[i] for r in out], dtype="object") for i, f in enumerate(RELEASED)})
        if status:
            columns = zip(*((conn, *state) for conn, state in status.items()), strict=True)
            schema = _schema(["conn", *STATE])
            self.status.put(_packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)))


def released(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """``RELEASED`` rows of a stream of chat events (id, ts, conn, kind, username), in order per connection.

    Times are microseconds of the value's own clock, whatever the session's zone. Events without time or connection
    are left out, as are those that come after the watermark has passed them.
    """
    durable_state(events.sparkSession)
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    timed = (events.filter("ts is not null and conn is not null")
                   .select(F.col("conn").cast("long").alias("conn"), F.timestamp_diff("MICROSECOND", origin, F.col("ts")).alias("us"),
                           F.col("id").cast("long").alias("id"), "kind", "username")
                   .withColumn("event_ts", F.timestamp_micros("us")).withWatermark("event_ts", delay))
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("conn"), F.lit(BUCKETS)).cast("int"))
    return timed.groupBy("bucket").transformWithStateInPandas(Presence(), RELEASED, "Append", "EventTime")


def transitions(events: DataFrame) -> DataFrame:
    """Joins and disconnects with their ``delta``, for ``count_batches``."""
    return released(events).filter("kind <> 'message'").select("id", "us", "conn", "kind", "delta")


def count_batches(root: str) -> Callable[[DataFrame, int], None]:
    """ST6 sink: the number online after each join or disconnect of a trigger, on top of the triggers committed before."""
    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = written(batch, "released")  # the stateful plan behind a trigger runs once
        if rows.isEmpty():
            return
        before = read_committed(spark, root, "counts", COUNTS, before=batch_id).agg(F.coalesce(F.sum("delta"), F.lit(0))).first()[0]
        counted = running_sum(rows, [], ["us", "id"], "delta", "en_ligne", cheap=True).withColumn("en_ligne", F.col("en_ligne") + F.lit(before).cast("long"))
        write_batch(spark, {"counts": counted.select(*COUNTS.fieldNames())}, root, batch_id)
    return body


def gated_messages(events: DataFrame) -> DataFrame:
    """ST7: messages whose connection's latest earlier join or disconnect is a join under the same name."""
    return released(events).filter("relayed").select(*MESSAGES.fieldNames())


def presence_sessions(events: DataFrame) -> DataFrame:
    """ST8: a row when a session opens (no end yet) and one when it closes; the later one of an (conn, opened_id) stands."""
    return released(events).filter("delta <> 0").select(
        "conn", "opened_id", F.col("opened_by").alias("username"), F.col("opened_us").alias("debut_us"), F.when(F.col("delta") == -1, F.col("us")).alias("fin_us"))


def latest_sessions(rows: DataFrame) -> DataFrame:
    """The batch form's sessions (conn, username, debut, fin, duree_s) from all rows of the stream: the closing row where there is one."""
    one = rows.groupBy("conn", "opened_id").agg(F.first("username").alias("username"), F.min("debut_us").alias("debut_us"), F.max("fin_us").alias("fin_us"))
    return one.select("conn", "username", clock("debut_us").alias("debut"), clock("fin_us").alias("fin"),
                      ((F.col("fin_us") - F.col("debut_us")) / F.lit(1e6)).alias("duree_s"))


def clock(us: str):
    """Microseconds -> TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
