"""Streams of envelopes and events: decode and dispatch by kind, drop repeats within a watermark, match interests, limit rates.

Each function takes a stream or a table and returns one; `finished` runs a stream over what there is, with a checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.operators import storage
from corvane.operators.retrieval import matched_interests

ENVELOPE = "kind string, user_id long, reference_id string, created timestamp, payload string"
#: From this score on an artifact is news to a user: a fixed value.
MATCH = 0.4


def decoded(lines: DataFrame, kinds: tuple[str, ...] = ("event", "match")) -> DataFrame:
    """lines (value: JSON text) -> the envelopes' columns. Invalid JSON and unknown kinds are dropped. Works on streams and tables."""
    return lines.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*").where(F.col("kind").isin(*kinds))


def dispatched(envelopes: DataFrame, kind: str) -> DataFrame:
    return envelopes.where(F.col("kind") == kind)


def notified_once(envelopes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One envelope of each user, kind and reference within the watermark, whose state Spark drops after `delay`."""
    return once(envelopes, "created", ["user_id", "kind", "reference_id"], delay)


def once(rows: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def news(artifacts: DataFrame, interests: DataFrame, threshold: float = MATCH) -> DataFrame:
    """A stream of artifacts joined with the table of interests: user_id, label, id, score from the threshold on."""
    return matched_interests(interests, artifacts, threshold)


def limited(events: DataFrame, keys: list[str], at: str, ident: str, limit: int, seconds: int) -> DataFrame:
    """events -> keys, ident, allowed, left. A key's window starts at its first hit and ends `seconds` later, whatever the clock; then the
    next hit starts another. State is a start and a count for each key, and goes when its window is over."""
    kinds = dict(events.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in [*keys, ident]) + ", allowed boolean, remaining int"
    span = seconds * 1_000_000

    def judged(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["_at", ident])
        allowed, left = [], []
        for hit in rows["_at"].tolist():
            if start is None or hit >= start + span:
                start, count = hit, 0
            count += 1
            allowed.append(count <= limit)
            left.append(max(0, limit - count))
        state.update((start, count))
        over = (start + span) // 1000
        if over > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(over)
        yield pd.DataFrame({**{k: [v] * len(rows) for k, v in zip(keys, key, strict=True)}, ident: rows[ident].tolist(), "allowed": allowed, "remaining": left})

    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 hour").withColumn("_at", F.unix_micros(at))
    return timed.groupBy(*keys).applyInPandasWithState(judged, out, "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


#: The state store that timers need; a session's setting, set where a stream with timers is made.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "micros long, outcome string"


class Entries(StatefulProcessor):
    """A cache entry for each key: when it was written, and a timer that ends it."""

    def __init__(self, keys: list[str], ident: str, ttl: int):
        self.keys, self.ident, self.ttl = keys, ident, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", "start long")

    def rows(self, key: tuple, idents: list, at: list, outcomes: list) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * len(at) for k, v in zip(self.keys, key, strict=True)}, self.ident: pd.array(idents, dtype="Int64"), "micros": at, "outcome": outcomes})

    def end(self, start: int) -> int:
        return -(-(start + self.ttl) // 1000)  # timers are in milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat([part[["micros", self.ident]] for part in rows]).sort_values(["micros", self.ident])
        held = start = self.entry.get()[0] if self.entry.exists() else None
        idents, at, outcomes = [], [], []
        for hit, ident in zip(asked["micros"].tolist(), asked[self.ident].tolist(), strict=True):
            if start is not None and hit < start:
                outcome = "late"
            elif start is not None and hit < start + self.ttl:
                outcome = "hit"
            else:
                if start is not None:
                    idents, at, outcomes = [*idents, None], [*at, start + self.ttl], [*outcomes, "expired"]
                start, outcome = hit, "miss"
            idents.append(ident)
            at.append(hit)
            outcomes.append(outcome)
        if start != held:
            if held is not None:
                self.handle.deleteTimer(self.end(held))
            self.entry.update((start,))
            self.handle.registerTimer(self.end(start))
        yield self.rows(key, idents, at, outcomes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            start = self.entry.get()[0]
            self.entry.clear()
            yield self.rows(key, [None], [start + self.ttl], ["expired"])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, keys: list[str], at: str, ident: str, seconds: int, lateness: str) -> DataFrame:
    """A stream of requests (keys, at, ident: long) -> keys, ident, at, outcome: what a cache whose entries live so many seconds answers.

    miss: there was no entry, and one is written; hit: there was; late: the request is older than the entry there is, which stays; expired (no
    ident): an entry's end, told by the next request or, without one, by a timer once the watermark has passed it. Requests within `lateness`
    of the newest are all answered; Spark drops older ones and counts them (`dropped`). State goes with its entry."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).withColumn("micros", F.unix_micros(at))
    kinds = dict(requests.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", {ident} long, {OUTCOME}"
    found = timed.groupBy(*keys).transformWithStateInPandas(Entries(keys, ident, seconds * 1_000_000), out, "append", "EventTime")
    return found.select(*keys, ident, F.timestamp_micros("micros").alias(at), "outcome")


def dropped(run) -> int:
    """The rows that a stream's operators dropped as older than their watermark, over the progress that is kept of it."""
    return sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])


def stored(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts the stream into a table of files: each input counts once, and after a failure it goes on where it was."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def published(stream: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None]):
    """Starts the stream with a function that gets each batch and its number, which is the same when a batch is repeated."""
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, name: str, seconds: int = 600) -> DataFrame:
    """The rows of a stream over all input that there is now."""
    spark = stream.sparkSession
    path = f"{storage.folder(spark)}/{name}-{uuid.uuid4().hex}"
    run = stored(stream, f"{path}/rows", f"{path}/checkpoint")
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"the stream {name} has not ended in {seconds} seconds")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, be it a folder or a single file."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table.schema)
    if any(f.rsplit("/", 1)[-1] == f"{name}.parquet" for f in table.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def phases(rows: DataFrame, chunk: int = 48) -> Iterator[dict]:
    """An answer's messages in order: a phase each, then the pieces of its text, then how it ended. rows (phase, text): one answer's few rows."""
    from corvane.functions.extract import messages

    for row in rows.select("phase", messages(F.col("text"), chunk).alias("pieces")).toLocalIterator():
        yield {"type": "phase", "phase": row.phase}
        for message in row.pieces:
            yield {"type": "text", "phase": row.phase, "at": message["at"], "text": message["piece"]}
    yield {"type": "end"}


def live(rows: DataFrame, at: str, now, seconds: int) -> DataFrame:
    """Rows that are not older than their time to live at `now`, a parameter so that reruns agree."""
    return rows.where(F.col(at) >= F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))
