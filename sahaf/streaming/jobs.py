"""Streams: versions, windows, breakers and ordered sequences, each with the rows that a batch would give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sahaf.sources.io import work_folder

VERSION = "record_id string, source_version long, content_hash string, valid_from timestamp, occurrence_count long, last_seen_at timestamp"


def run_to_parquet(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    spark = stream.sparkSession
    path = work_folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def source(spark: SparkSession, folder: str, like: DataFrame, files: int = 4) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def versions(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The current version of a record after a batch of observations, kept in the state."""
    number, held, since, count, last = state.get if state.exists else (0, None, None, 0, None)
    rows = pd.concat(list(frames)).sort_values(["observed_at", "event_id"])
    for h, at in zip(rows["content_hash"], rows["observed_at"], strict=True):
        if number == 0 or h != held:
            number, held, since, count = number + 1, h, at, 0
        count, last = count + 1, at
    state.update((number, held, since, count, last))
    yield pd.DataFrame({"record_id": [key[0]], "source_version": [number], "content_hash": [held], "valid_from": [since], "occurrence_count": [count], "last_seen_at": [last]})


def current_versions(stream: DataFrame) -> DataFrame:
    """Of observations (record_id, content_hash, observed_at, event_id), in order by batch, each record's last version."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    made = stream.groupBy("record_id").applyInPandasWithState(versions, VERSION, "n long, h string, since timestamp, count long, last timestamp", "append", GroupStateTimeout.NoTimeout)
    rows = run_to_parquet(made, "append", "versions")
    last = rows.groupBy("record_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "record_id"]), F.struct("source_version", "occurrence_count")).alias("v"))
    return last.select("record_id", "v.*")


#: Seconds for which a source's last good quote stands in for one that fails.
LAST_GOOD_SECONDS = 15 * 60
QUOTE = "provider long, event_id long, ts timestamp, status string, value double"


def last_good(stream: DataFrame, seconds: int = LAST_GOOD_SECONDS, late: str = "1 hour") -> DataFrame:
    """Snapshots (provider, event_id, ts, ok, value) of sources as a stream of quotes: live, or the last good one, or none.

    A failed snapshot gives the last good value of its provider if that is at most so many seconds older, told as
    last-good; else nothing is available.  State is one value a provider, and goes when the watermark has passed its time.
    Snapshots of a batch are taken in order of time; one that comes more than `late` behind the newest of earlier batches may be left out, and
    one that is older than the value in state can't use it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, at = state.get if state.exists else (None, None)
        at = None if at is None else pd.Timestamp(at)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, ts, ok, value in zip(rows["event_id"], rows["ts"], rows["ok"], rows["value"], strict=True):
            if ok:
                held, at = (value, ts) if at is None or ts >= at else (held, at)
                out.append((key[0], event, ts, "live", value))
            elif at is not None and 0 <= (ts - at).total_seconds() <= seconds:
                out.append((key[0], event, ts, "last-good", held))
            else:
                out.append((key[0], event, ts, "unavailable", None))
        if at is not None:
            state.update((float(held), at.to_pydatetime()))
            expiry = int(at.tz_localize(zone).timestamp() * 1000) + 1000 * seconds
            if expiry > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(expiry)
            else:
                state.remove()
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in QUOTE.split(", ")])
        yield frame.astype({"value": "float64"})

    dated = stream.withWatermark("ts", late)
    return dated.groupBy("provider").applyInPandasWithState(run, QUOTE, "held double, at timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def hourly(stream: DataFrame) -> DataFrame:
    """Counts and sums by hour and type; what is over an hour late is left out."""
    return stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def breaker(events: DataFrame, failures: int = 3, pause: int = 600) -> DataFrame:
    """(provider, event_id, state, allowed) of calls (provider, event_id, at, ok) under a circuit breaker.

    After some failures in a row the breaker opens for a pause in seconds; then one probe decides.  Providers are
    walked in order of time with constant memory, however many calls one has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, bad, opened = None, 0, None
        for f in frames:
            out = []
            for name, event, at, ok in zip(f["provider"], f["event_id"], f["at"], f["ok"], strict=True):
                if name != provider:
                    provider, bad, opened = name, 0, None
                state = "closed" if opened is None else "half-open" if at - opened >= pause else "open"
                if state != "open":
                    bad = 0 if ok else bad + 1
                    opened = None if ok else at if state == "half-open" or bad >= failures else None
                out.append((name, event, state, state != "open"))
            yield pd.DataFrame(out, columns=["provider", "event_id", "state", "allowed"])

    ordered = events.select("provider", "event_id", "at", "ok").repartition("provider").sortWithinPartitions("provider", "at", "event_id")
    return ordered.mapInPandas(run, "provider long, event_id long, state string, allowed boolean")


def rising(events: DataFrame) -> DataFrame:
    """The events (stream, event_id, sequence, pos) that a consumer takes: ids once, sequences only upwards."""
    once = events.withColumn("r", F.row_number().over(Window.partitionBy("stream", "event_id").orderBy("pos"))).where("r = 1").drop("r")
    before = F.max("sequence").over(Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return once.withColumn("before", before).where("before is null or sequence > before").drop("before")


def ring(events: DataFrame, size: int = 2000) -> DataFrame:
    """The last events that a bounded buffer holds."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(size)
