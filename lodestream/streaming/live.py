"""Streams: windows under a watermark, duplicates, newest values and keyed bar state."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

BARS = "symbol string, bar_s long, open double, high double, low double, close double, volume long, macd double, signal double"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; ``ts`` with a zone, as watermarks need it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("ts"), "user_id",
                      F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"))


def tumbling(stream: DataFrame, size: str, delay: str = "10 minutes", start: str = "0 seconds") -> DataFrame:
    """Bars of closed windows; ``start`` anchors them at a session's open."""
    return stream.withWatermark("ts", delay).groupBy("symbol", F.window("ts", size, size, start)).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"))


def sliding(stream: DataFrame, size: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy("symbol", F.window("ts", size, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))


def activity(stream: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a silence of ``gap``."""
    return stream.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def once(stream: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def newest(batch: DataFrame, key: str = "symbol", order: str = "seq") -> DataFrame:
    """Of a micro-batch, each key's newest row."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("row")).select(key, "row.*")


class BarState(StatefulProcessor):
    """Keeps a symbol's open bar and MACD state; gives each bar once it is closed, and counts late ticks.

    A bar closes when a tick of a later one comes, or when event time passes its end.
    A tick of a closed bar is counted and changes nothing.
    """

    def __init__(self, seconds: int = 3600, fast: int = 12, slow: int = 26, signal: int = 9):
        self.seconds, self.alphas = seconds, (2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1))

    def init(self, handle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "bar_s long, open double, high double, low double, close double, volume long")
        self.means = handle.getValueState("means", "fast double, slow double, signal double, late long")

    def _closed(self, symbol: str, bar: tuple) -> dict:
        f, s, g, late = self.means.get() if self.means.exists() else (None, None, None, 0)
        a, b, c = self.alphas
        close = bar[4]
        f = close if f is None else f + a * (close - f)
        s = close if s is None else s + b * (close - s)
        g = f - s if g is None else g + c * (f - s - g)
        self.means.update((f, s, g, late))
        return dict(zip(("symbol", "bar_s", "open", "high", "low", "close", "volume"), (symbol, *bar), strict=True)) | {"macd": f - s, "signal": g}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(rows).sort_values(["ts", "seq"])
        bar = tuple(self.bar.get()) if self.bar.exists() else None
        out = []
        for ts, price, size in zip(ticks["ts"], ticks["price"], ticks["size"], strict=True):
            at = int(ts.timestamp()) // self.seconds * self.seconds
            if bar and at < bar[0]:
                f, s, g, late = self.means.get() if self.means.exists() else (None, None, None, 0)
                self.means.update((f, s, g, late + 1))
                continue
            if bar and at > bar[0]:
                out.append(self._closed(key[0], bar))
                bar = None
            bar = (at, *((price,) * 4), int(size)) if bar is None else (at, bar[1], max(bar[2], price), min(bar[3], price), price, bar[5] + int(size))
        if bar:
            self.bar.update(bar)
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer((bar[0] + self.seconds) * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BARS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bar.exists():
            out = [self._closed(key[0], tuple(self.bar.get()))]
            self.bar.clear()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BARS.split(", ")])

    def close(self) -> None:
        pass


def live_bars(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Bars with MACD from keyed state; needs the RocksDB state store."""
    return stream.withWatermark("ts", delay).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=BarState(), outputStructType=BARS, outputMode="append", timeMode="EventTime")


SESSION_BARS = "symbol string, kind string, seq long, bar_s long, open double, high double, low double, close double, volume long, macd double, signal double"
#: Seconds of a day within which a session's ticks count, and of receipt after which a print is stale.
SESSION_S, STALE_S = (33_300, 55_800), 3 * 86_400


class SessionBars(StatefulProcessor):
    """A symbol's open bar, its indicator and what it refused, along ticks in the order in which they arrive.

    Event time is the time of arrival, so a timer stands for a clock: a bar closes when a
    tick of a later one comes, or ``grace`` seconds of arrival after its end or the
    session's, whichever is first. So the session's last bar closes, and an idle one. A
    tick outside the session, one that took longer than ``stale`` to arrive and one of a
    bar that has closed changes nothing and is put out with its reason as ``kind``.
    The state begins from stored indicator values where the initial state has some.
    """

    def __init__(self, seconds: int = 3600, grace: int = 600, session: tuple[int, int] = SESSION_S, stale: int = STALE_S, fast: int = 12, slow: int = 26, signal: int = 9):
        self.seconds, self.grace, self.session, self.stale = seconds, grace, session, stale
        self.alphas = (2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1))

    def init(self, handle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "bar_s long, open double, high double, low double, close double, volume long")
        self.means = handle.getValueState("means", "last_s long, fast double, slow double, signal double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.means.update((int(r["last_s"]), float(r["fast"]), float(r["slow"]), float(r["signal"])))

    def _closed(self, symbol: str, bar: tuple) -> tuple:
        close = bar[4]
        if self.means.exists():
            _, f, s, g = self.means.get()
            a, b, c = self.alphas
            f, s = f + a * (close - f), s + b * (close - s)
            g += c * (f - s - g)
        else:
            f, s, g = close, close, 0.0
        self.means.update((bar[0], f, s, g))
        return (symbol, "bar", None, *bar, f - s, g)

    def _due(self, bar_s: int) -> int:
        return min(bar_s + self.seconds, bar_s // 86_400 * 86_400 + self.session[1]) + self.grace

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            table = pd.DataFrame(out, columns=[c.split()[0] for c in SESSION_BARS.split(", ")])
            yield table.astype({"seq": "Int64", "bar_s": "Int64", "volume": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(rows).sort_values(["arrived_s", "seq"])
        bar = tuple(self.bar.get()) if self.bar.exists() else None
        last = self.means.get()[0] if self.means.exists() else None
        out = []
        refuse = lambda seq, why: out.append((key[0], why, seq, *[None] * 8))
        for seq, at, came, price, size in zip(*(ticks[c].tolist() for c in ("seq", "ts_s", "arrived_s", "price", "size")), strict=True):
            bar_s = at // self.seconds * self.seconds
            if not self.session[0] <= at % 86_400 < self.session[1]:
                refuse(seq, "off session")
            elif came - at > self.stale:
                refuse(seq, "stale")
            elif bar and bar_s < bar[0] or last is not None and bar_s <= last:
                refuse(seq, "late")
            elif bar and bar_s == bar[0]:
                bar = (bar_s, bar[1], max(bar[2], price), min(bar[3], price), price, bar[5] + int(size))
            else:
                if bar:
                    out.append(self._closed(key[0], bar))
                    last = bar[0]
                bar = (bar_s, price, price, price, price, int(size))
        if bar:
            self.bar.update(bar)
            due = self._due(bar[0]) * 1000
            held = list(self.handle.listTimers())
            for t in held:
                if t != due:
                    self.handle.deleteTimer(t)
            if due not in held:
                self.handle.registerTimer(due)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bar.exists():
            bar = tuple(self.bar.get())
            self.bar.clear()
            yield from self._rows([self._closed(key[0], bar)])

    def close(self) -> None:
        pass


def session_bars(stream: DataFrame, seed: DataFrame | None = None, **rules) -> DataFrame:
    """Closed bars and refused ticks of ``stream`` (symbol, seq, ts_s, arrived_s, price, size, arrived); ``seed`` has symbol, last_s, fast, slow, signal."""
    keyed = stream.withWatermark("arrived", "0 seconds").groupBy("symbol")
    return keyed.transformWithStateInPandas(statefulProcessor=SessionBars(**rules), outputStructType=SESSION_BARS, outputMode="append", timeMode="EventTime", initialState=seed and seed.groupBy("symbol"))


class Cooldown(StatefulProcessor):
    """Lets an event through that comes ``wait`` seconds or more after the one before that was let through; a key's state goes when it is that old."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.fired = handle.getValueState("fired", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fired = self.fired.get()[0] if self.fired.exists() else None
        out = []
        for at in sorted(set(pd.concat(rows)["ts_s"].tolist())):
            if fired is None or at - fired >= self.wait:
                fired = at
                out.append((key[0], at))
        if fired is not None:
            self.fired.update((fired,))
        yield pd.DataFrame(out, columns=["symbol", "ts_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from ()

    def close(self) -> None:
        pass


def cooled(stream: DataFrame, wait: int) -> DataFrame:
    return stream.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Cooldown(wait), outputStructType="symbol string, ts_s long", outputMode="append", timeMode="None")


def delivered(rows: DataFrame, part: str, parts: int, folder: str) -> DataFrame:
    """``rows`` as a file stream that takes one delivery at a time: those of ``part`` 0 first, each written after the one before."""
    path = f"{folder}/deliveries-{uuid.uuid4().hex}"
    for i in range(parts):
        rows.where(F.col(part) == i).drop(part).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.drop(part).schema).option("maxFilesPerTrigger", 1).parquet(path)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Keyed state needs this state store; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, into a table in ``folder``."""
    spark = stream.sparkSession
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
