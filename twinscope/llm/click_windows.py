"""Click deduplication with expiring windows, as a stateful stream.

Each click id has at most one open window, named by the hour of the event that opened it. Later events of
the id up to LIFE hours after that are its repeats (those that contradict the opener by hash are counted as
conflicts); a later event closes the window and opens another. A window also closes once the stream has
moved DELAY hours beyond its end, and events older than that are dropped: Spark's watermark, to the hour.

`dedup` is one row-based transformWithState over buckets of click ids. Its state is
* `windows`, a MapState from a page of the bucket's click ids to their open windows, and
* `wheel`, a MapState from a slot of SLOT deadline hours to the ids whose window ends then: a timing wheel.
One event-time timer of the bucket stands at its earliest deadline; it drains the slots that have expired.
A window that was closed before leaves its id on the wheel, where it is passed over.

Each micro-batch opens the store of every partition, and Spark never frees the 0.5 MB of statistics that RocksDB
then makes. So a run of the stream is one micro-batch: what the events of one run have made old is closed at the
start of the next, as closed after the run before. Only the last run has a second one, without data.

A call of the state from Python takes 0.2 ms, so a map with an entry for each id would spend a millisecond an
event; entries are therefore packed, a page or slot at a time, and so are the events that reach a bucket
(`packed`, in the same query, before the shuffle). Equal events of one id and hour are one with a count. The
number of buckets follows the number of events, so a bucket holds about BUCKET_EVENTS of them.

Defined results: rows without click id or arrival, and those of negative remainder, have no copies; other
nulls are empty in the hash; a value that isn't a number counts as 0; repeated rows are repeats; other columns
are ignored; an empty table gives an empty result. Times without a zone are UTC.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import TimestampNTZType

from twinscope.llm.common import discard, materialise, splitmix, table, text_bytes, work_dir

LIFE, DELAY, BATCHES = 24, 96, 8
HOUR_MS = 3_600_000
SLOT, PAGES, ROW_WINDOWS = 12, 4, 512
#: A page of a bucket stays below half a region of a small heap, so that G1 doesn't give it regions of its own.
BUCKET_EVENTS, LEAST_BUCKETS = 28_000, 64
#: Events that a task holds before it packs them.
PACK_EVENTS = 60_000
EVENT = np.dtype([("click", "<i8"), ("hour", "<i4"), ("n", "<i4"), ("hash", "u1", 32)])
WINDOW = np.dtype([("click", "<i8"), ("start", "<i4"), ("closed", "<i4"), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8"), ("hash", "u1", 32)])
ENTRY = np.dtype([("deadline", "<i4"), ("click", "<i8")])
#: The state is kept by RocksDB, in bounded memory; a task gives its store back when it commits, so that runs don't leave theirs open.
STATE = "spark.sql.streaming.stateStore."
SETTINGS = {
    f"{STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{STATE}unloadOnCommit": "true",
    f"{STATE}rocksdb.boundedMemoryUsage": "true", f"{STATE}rocksdb.maxMemoryUsageMB": "64", f"{STATE}rocksdb.writeBufferSizeMB": "4", f"{STATE}rocksdb.blockCacheSizeMB": "4",
}
EMPTY_RUNS = "spark.sql.streaming.noDataMicroBatches.enabled"
#: A task that cuts copies into batches writes all batches at once, else it would sort its copies first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
EVENTS = "click_id long, hour int, bucket int, hash binary"
RESULT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"


def in_order(events: np.ndarray) -> np.ndarray:
    """By click, hour and hash; equal events become one."""
    h = np.ascontiguousarray(events["hash"]).view(">u8")
    events = events[np.lexsort((h[:, 3], h[:, 2], h[:, 1], h[:, 0], events["hour"], events["click"]))]
    new = np.ones(len(events), bool)
    new[1:] = (events["click"][1:] != events["click"][:-1]) | (events["hour"][1:] != events["hour"][:-1]) | (events["hash"][1:] != events["hash"][:-1]).any(1)
    first = np.flatnonzero(new)
    out = events[first]
    if len(events):
        out["n"] = np.add.reduceat(events["n"], first)
    return out


def packed(events: DataFrame) -> DataFrame:
    """bucket, hour (the latest) and the events themselves of each bucket that a task has met, from EVENTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def packs() -> Iterator[pa.RecordBatch]:
            bucket, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows[order]
            edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            whole = [in_order(rows[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch({"bucket": pa.array(bucket[edges[:-1]], pa.int32()), "hour": pa.array([int(w["hour"].max()) for w in whole], pa.int32()), "events": pa.array([w.tobytes() for w in whole], pa.binary())})

        for batch in batches:
            rows = np.zeros(batch.num_rows, EVENT)
            raw, offs = text_bytes(batch.column("hash"))
            rows["click"], rows["hour"], rows["n"] = batch.column("click_id").to_numpy(), batch.column("hour").to_numpy(), 1
            rows["hash"] = raw[offs[0] : offs[-1]].reshape(-1, 32)
            bucket = batch.column("bucket").to_numpy()
            last = bucket < 0  # the end of the stream: a time without events
            for at in np.flatnonzero(last).tolist():
                yield pa.record_batch({"bucket": pa.array([0], pa.int32()), "hour": pa.array([int(rows["hour"][at])], pa.int32()), "events": pa.array([b""], pa.binary())})
            held.append((bucket[~last], rows[~last]))
            n += batch.num_rows
            if n >= PACK_EVENTS:
                yield from packs()
                held, n = [], 0
        if any(len(b) for b, _ in held):
            yield from packs()

    return events.mapInArrow(run, "bucket int, hour int, events binary")


class Windows(StatefulProcessor):
    """The windows of a bucket in one run of the stream; hours are counted from the stream's first and end at `latest`."""

    def __init__(self, batch: int, latest: int):
        self.batch, self.latest = batch, latest
        self.swept: dict[tuple[int, int], int] = {}  # the hour up to which a bucket's page was closed in this task

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "page int", "windows binary")
        self.wheel = handle.getMapState("wheel", "slot int", "entries binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def close(self) -> None:
        pass

    @staticmethod
    def read(state, key: int, kind: np.dtype) -> np.ndarray:
        found = state.getValue((key,))
        return np.frombuffer(bytes(found[0]) if found else b"", kind)

    @staticmethod
    def write(state, key: int, rows: np.ndarray, there: bool = True) -> None:
        if len(rows):
            state.updateValue((key,), (bytearray(rows.tobytes()),))
        elif there:
            state.removeKey((key,))

    def set_alarm(self, deadline: int | None) -> None:
        """The bucket's one timer stands half an hour after its earliest deadline."""
        at = None if deadline is None else deadline * HOUR_MS + HOUR_MS // 2
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = np.concatenate([np.frombuffer(r.events, EVENT) for r in rows])
        floor = floor_hour(timerValues)
        if self.batch:
            events = events[events["hour"] >= floor]
        if not len(events):
            return
        events = in_order(events)
        page = page_of(events["click"])
        pages = np.unique(page).tolist()
        stored = [self.read(self.windows, p, WINDOW) for p in pages]
        known: dict[int, list] = {}
        ended = []
        for p, rows_of_page in zip(pages, stored, strict=True):
            self.swept[key[0], p] = floor
            over = rows_of_page["start"] + LIFE < floor
            ended.append(rows_of_page[over])
            rows_of_page = rows_of_page[~over]
            raw = rows_of_page["hash"].tobytes()
            columns = (rows_of_page[c].tolist() for c in ("click", "start", "repeats", "conflicts", "crc"))
            known.update((click, [*rest, raw[32 * k : 32 * k + 32]]) for k, (click, *rest) in enumerate(zip(*columns, strict=True)))
        closed, opened = [], []
        hashes = events["hash"].tobytes()
        for k, (click, hour, n) in enumerate(zip(events["click"].tolist(), events["hour"].tolist(), events["n"].tolist(), strict=True)):
            own = hashes[32 * k : 32 * k + 32]
            window = known.get(click)
            if window is None or hour > window[0] + LIFE:
                if window is not None:
                    closed.append((click, *window))
                window = known[click] = [hour, 0, 0, 0, own]
                opened.append((hour + LIFE, click))
                n -= 1
            if n:
                window[1] += n
                if own != window[4]:
                    window[2] += n
                    window[3] += n * zlib.crc32(own.hex().encode())
        now = table_of([(c, *w) for c, w in known.items()], 0)
        place = page_of(now["click"])
        for p, before in zip(pages, stored, strict=True):
            self.write(self.windows, p, now[place == p], len(before) > 0)
        if opened:
            entries = np.array(opened, ENTRY)
            slot = entries["deadline"] // SLOT
            for s in np.unique(slot).tolist():
                self.write(self.wheel, s, np.concatenate([self.read(self.wheel, s, ENTRY), entries[slot == s]]))
            first = int(entries["deadline"].min())
            alarm = self.alarm.get()
            if alarm is None or first * HOUR_MS + HOUR_MS // 2 < alarm[0]:
                if alarm is not None:
                    self.handle.deleteTimer(alarm[0])
                self.set_alarm(first)
        if closed:
            yield from rows_of(table_of(closed, self.batch))
        yield from self.after(np.concatenate(ended), floor)

    def after(self, windows: np.ndarray, floor: int) -> Iterator[Row]:
        """Windows that had ended before this run, or at the end of the stream."""
        windows["closed"] = self.batch if floor > self.latest else self.batch - 1
        yield from rows_of(windows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        floor = floor_hour(timerValues)
        due, next_deadline = [], None
        for slot in sorted(k[0] for k in self.wheel.keys()):
            if slot * SLOT >= floor and next_deadline is not None:
                break
            entries = self.read(self.wheel, slot, ENTRY)
            over = entries["deadline"] < floor
            if over.any():
                due.append(entries["click"][over])
                self.write(self.wheel, slot, entries[~over])
            if not over.all() and next_deadline is None:
                next_deadline = int(entries["deadline"][~over].min())
        self.set_alarm(next_deadline)
        if not due:
            return
        clicks = np.unique(np.concatenate(due))
        place = page_of(clicks)
        closed = []
        for p in np.unique(place).tolist():
            if self.swept.get((key[0], p)) == floor:
                continue
            rows = self.read(self.windows, p, WINDOW)
            over = (rows["start"] + LIFE < floor) & np.isin(rows["click"], clicks[place == p])
            if over.any():
                closed.append(rows[over])
                self.write(self.windows, p, rows[~over])
        if closed:
            yield from self.after(np.concatenate(closed), floor)


def rows_of(windows: np.ndarray) -> Iterator[Row]:
    """Closed windows, ROW_WINDOWS to a row, so that what reads the rows holds few at once."""
    for lo in range(0, len(windows), ROW_WINDOWS):
        yield Row(closed=windows[lo : lo + ROW_WINDOWS].tobytes())


def page_of(clicks: np.ndarray) -> np.ndarray:
    return (splitmix(clicks.astype(np.int64).view(np.uint64)) % np.uint64(PAGES)).astype(np.int64)


def table_of(windows: list[tuple], batch: int) -> np.ndarray:
    """(click, start, repeats, conflicts, crc, hash) as WINDOW."""
    out = np.zeros(len(windows), WINDOW)
    if windows:
        click, start, repeats, conflicts, crc, hashes = zip(*windows, strict=True)
        out["click"], out["start"], out["closed"], out["repeats"], out["conflicts"], out["crc"] = click, start, batch, repeats, conflicts, crc
        out["hash"] = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 32)
    return out


def floor_hour(timer_values) -> int:
    """The hour that events and ends of windows must reach: the watermark is a millisecond before it."""
    return (timer_values.getCurrentWatermarkInMs() + 1) // HOUR_MS


def dedup(events: DataFrame, batch: int, latest: int) -> DataFrame:
    """closed: packed windows that this run of the stream closes, from a stream of EVENTS; a time beyond `latest` ends it."""
    timed = packed(events).withColumn("at", F.timestamp_millis(F.col("hour").cast("long") * HOUR_MS)).drop("hour")
    timed = timed.withWatermark("at", f"{DELAY} hours 1 millisecond")
    return timed.groupBy("bucket").transformWithState(Windows(batch, latest), "closed binary", "Append", "EventTime")


def unpacked(closed: DataFrame) -> DataFrame:
    """RESULT of packed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("closed").to_pylist():
                w = np.frombuffer(raw, WINDOW)
                named = zip(("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc"), ("click", "start", "closed", "repeats", "conflicts", "crc"), strict=True)
                hashes = pa.Array.from_buffers(pa.binary(32), len(w), [None, pa.py_buffer(np.ascontiguousarray(w["hash"]))]).cast(pa.binary())
                yield pa.record_batch({name: pa.array(w[c].astype(np.int64)) for name, c in named} | {"hash": hashes})

    return closed.mapInArrow(run, RESULT)


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone is UTC, whatever the session's zone."""
    at = F.col(name)
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(at.cast("timestamp"))
    seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def copies(clicks: DataFrame) -> DataFrame:
    """click_id, hour, late (the hour in whose order copies arrive) and digest (of a hash's column, 32 bytes) of each copy of a click."""
    remainder = F.col("click_id") % 3
    rows = clicks.select(
        F.col("click_id").cast("long").alias("click_id"), F.floor(utc_micros(clicks, "arrived_at") / (HOUR_MS * 1000)).cast("long").alias("arrived"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in (("client_id", F.col("client_id")), ("kind", F.col("kind")), ("cents", F.floor(100 * F.col("value").cast("double") + 0.5)), ("micros", utc_micros(clicks, "ts")), ("props", F.col("props")))],
    )
    js = F.when(remainder >= 0, F.sequence(F.lit(0).cast("long"), remainder))
    rows = rows.where("arrived IS NOT NULL").withColumn("j", F.explode(js)).withColumn("c", F.crc32(F.concat_ws(":", "click_id", "j").cast("binary")))
    rows = rows.withColumn("hour", F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10))
    said = F.concat_ws("|", "client_id", "kind", "cents", "micros", "props", (F.col("c") % 3).cast("string"))
    return rows.select("click_id", "hour", (F.col("hour") + F.floor(F.col("c") / 10) % 200).alias("late"), F.unhex(F.sha2(said, 256)).alias("hash"))


def op12_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = copies(table(spark, sf_dir, "clicks"))
    low, high, first, latest, n = made.agg(F.min("late"), F.max("late"), F.min("hour"), F.max("hour"), F.count("*")).first()
    if not n:
        return unpacked(spark.createDataFrame([], "closed binary")).withColumn("hash", F.lower(F.hex("hash")))
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_EVENTS))
    batch = F.expr(f"(late - {low}) * {BATCHES} div {high - low + 1}").cast("int")
    events = made.select("click_id", (F.col("hour") - first + 1).cast("int").alias("hour"), F.pmod(F.xxhash64("click_id"), F.lit(buckets)).cast("int").alias("bucket"), "hash", batch.alias("batch"))
    folder = work_dir(spark, "clicks")
    end = spark.createDataFrame([(0, latest - first + 2 + LIFE + DELAY, -1, bytes(32))], EVENTS)  # moves time beyond all windows
    before = {k: spark.conf.get(k, None) for k in (*SETTINGS, EMPTY_RUNS, WRITERS)}
    for k, v in {**SETTINGS, WRITERS: str(BATCHES)}.items():
        spark.conf.set(k, v)
    try:
        events.write.partitionBy("batch").parquet(f"{folder}/cut")
        cut = spark.read.schema(EVENTS + ", batch int").parquet(f"{folder}/cut")
        for b in range(BATCHES):
            spark.conf.set(EMPTY_RUNS, str(b == BATCHES - 1).lower())
            fed = cut.where(F.col("batch") == b).drop("batch")
            (fed.unionByName(end) if b == BATCHES - 1 else fed).write.mode("append").parquet(f"{folder}/fed")
            stream = dedup(spark.readStream.schema(EVENTS).parquet(f"{folder}/fed"), b, latest - first + 1)
            run = stream.writeStream.format("parquet").option("path", f"{folder}/closed").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = unpacked(spark.read.schema("closed binary").parquet(f"{folder}/closed"))
    return out.withColumn("start_hour", F.col("start_hour") + (first - 1)).withColumn("hash", F.lower(F.hex("hash")))
