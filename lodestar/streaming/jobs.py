"""Structured Streaming: the same results as the batch operators, kept up as events come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import maintain
from ..sources import tables


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, app, n) by event time; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "app").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "app", "n")


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, started_at, ended_at, n) of sessions that a gap ends."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).select("user", "started_at", "ended_at", "n")


class TypingTracker(StatefulProcessor):
    """Typing speed of a session from keystrokes (session, ts_ms, is_backspace): the last 20 intervals of 10 to 5000 ms, their moving
    average (0.3), the share of backspaces, and the waits that follow from them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("typing", "last long, ema double, keys long, backs long, recent array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, ema, keys, backs, recent = self.state.get() if self.state.exists() else (None, 0.0, 0, 0, [])
        recent = list(recent or [])
        for pdf in rows:
            for t, back in zip(*(pdf.sort_values("ts_ms")[c] for c in ("ts_ms", "is_backspace"))):
                last, ema, recent = typed(last, ema, recent, int(t))
                keys, backs = keys + 1, backs + bool(back)
        self.state.update((last, ema, keys, backs, recent))
        yield pd.DataFrame([(key[0], keys, ema, backs / keys if keys else 0.0, *waits(recent, backs / keys if keys else 0.0))], columns=[c.split()[0] for c in TYPING.split(", ")])

    def close(self) -> None:
        pass


TYPING = "session string, keys long, ema_ms double, error_rate double, debounce_ms double, throttle_ms double"


def typed(last: int | None, ema: float, recent: list[int], now: int) -> tuple[int, float, list[int]]:
    gap = now - last if last is not None else -1
    if 10 <= gap <= 5000:
        recent = (recent + [gap])[-20:]
        ema = ema * 0.7 + gap * 0.3
    return now, ema, recent


def waits(recent: list[int], errors: float) -> tuple[float, float]:
    """(debounce, throttle) in ms: twice the average interval, within min times one and the errors, and 400 (the lower bound wins); the
    average and a deviation, within 30 and one and a half averages. 200 and 100 for under two intervals."""
    if len(recent) < 2:
        return 200.0, 100.0
    mean = sum(recent) / len(recent)
    dev = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5

    def clamp(x, lo, hi):
        return lo if x < lo else hi if x > hi else x

    return clamp(min(recent) * (1 + errors), 2 * mean, 400.0), clamp(mean + dev, 30.0, 1.5 * mean)


def typing(keystrokes: DataFrame) -> DataFrame:
    """A row per session and batch with its state so far."""
    return keystrokes.groupBy("session").transformWithStateInPandas(TypingTracker(), outputStructType=TYPING, outputMode="Update", timeMode="None")


def typing_batch(keystrokes: DataFrame) -> DataFrame:
    """The same of all keystrokes at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, ema, recent = None, 0.0, []
        pdf = pdf.sort_values("ts_ms")
        for t in pdf["ts_ms"]:
            last, ema, recent = typed(last, ema, recent, int(t))
        errors = float(pdf["is_backspace"].mean())
        return pd.DataFrame([(pdf["session"].iloc[0], len(pdf), ema, errors, *waits(recent, errors))], columns=[c.split()[0] for c in TYPING.split(", ")])

    return keystrokes.groupBy("session").applyInPandas(run, TYPING)


class SignalSessions(StatefulProcessor):
    """Sessions of a package from foreground and background signals, each given out when the next signal ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "started long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        started = self.open.get()[0] if self.open.exists() else None
        out = []
        for pdf in rows:
            for t, kind in zip(*(pdf.sort_values(["ts_ms", "event_type"])[c] for c in ("ts_ms", "event_type"))):
                if started is not None:
                    out.append((key[0], int(started), int(t), int(t - started), kind == "background"))
                    started = None
                if kind == "foreground":
                    started = int(t)
        if started is None:
            self.open.clear()
        else:
            self.open.update((started,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION.split(", ")])

    def close(self) -> None:
        pass


SESSION = "pkg string, started_ms long, ended_ms long, duration_ms long, closed boolean"


def signal_sessions(signals: DataFrame) -> DataFrame:
    return signals.groupBy("pkg").transformWithStateInPandas(SignalSessions(), outputStructType=SESSION, outputMode="Append", timeMode="None")


def orchestrate(keys: list[tuple[int, str]], debounce: float, throttle: float) -> list[tuple[int, str]]:
    """The searches (ms, text) that a run of inputs fires: an empty text or the first one at once, another after ``debounce`` of quiet
    and ``throttle`` since the last search."""
    fired: list[tuple[int, str]] = []
    for i, (t, text) in enumerate(keys):
        quiet = keys[i + 1][0] - t if i + 1 < len(keys) else float("inf")
        if not text or not fired:
            fired.append((t, text))
        elif quiet >= debounce and t + debounce - fired[-1][0] >= throttle:
            fired.append((t + int(debounce), text))
    return fired


def merge_changes(store: tables.Store, name: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that upserts the last change of each key and drops the removed ones.

    Running a batch again changes nothing, as it depends on the batch and the table alone.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ts").alias("x")).select(*keys, "x.*")
        live = last.where("action <> 'REMOVED'").drop("action")
        old = store.read(name, live.schema)
        store.write(name, old.join(last.select(*keys), keys, "left_anti").unionByName(live))

    return run


def ring(store: tables.Store, name: str, cap: int = 200) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the last ``cap`` feedback events, users hashed."""

    def run(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("user", F.sha2(F.col("user").cast("string"), 256)).withColumn("epoch", F.lit(epoch).cast("long"))
        old = store.read(name, new.schema).where(F.col("epoch") != epoch)
        store.write(name, maintain.last_n(old.unionByName(new), cap, "ts", tie="event_id"))

    return run
