"""Batch and streaming operators over keyed events."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import folds


def fold_batch(df: DataFrame, key: str, order: str, make: Callable, step: Callable, schema: str) -> DataFrame:
    """Run a state machine over each key's rows in order; ``step(machine, row)`` gives output rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine, out = make(), []
        for row in rows.sort_values(order).itertuples(index=False):
            out += step(machine, row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return df.groupBy(key).applyInPandas(run, schema)


def fold_stream(df: DataFrame, key: str, order: str, make: Callable, step: Callable, schema: str, idle: str | None = None, last: Callable | None = None) -> DataFrame:
    """The same over a stream: the machine is the key's state, stored as JSON.  Rows are in order within a
    trigger; what arrives a trigger later comes after, so the source has to keep a key's order across
    triggers (one partition per key, as a log does).  With ``idle`` (milliseconds of processing
    time) the key's state ends and ``last(key, machine)`` gives its final rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key_, batches, state: GroupState):
        machine = folds.thaw(make(), state.get[0]) if state.exists else make()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(last(key_[0], machine) if last else [], columns=names)
            return
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for row in rows.itertuples(index=False):
            out += step(machine, row)
        state.update((folds.freeze(machine),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, "machine string", "append", timeout)


ENDPOINT = ("session long, frame_no long, event string", lambda m, r: [(r.session, r.frame_no, e) for e in m.feed(r.prob)])
SENTENCE = ("turn_id long, seq long, sentence string", lambda m, r: [(r.turn_id, r.seq, s) for s in m.feed(r.delta)])
QUOTA = ("day string, event_id long, verdict string", lambda m, r: [(r.day, r.event_id, m.feed(r.key, r.engine))])


def endpoint_events(frames: DataFrame, streaming: bool = False, **settings) -> DataFrame:
    """(session, frame_no, event) from (session, frame_no, prob)."""
    f = fold_stream if streaming else fold_batch
    return f(frames, "session", "frame_no", lambda: folds.Endpoints(**settings), ENDPOINT[1], ENDPOINT[0])


def spoken_sentences(deltas: DataFrame, streaming: bool = False) -> DataFrame:
    """(turn_id, seq, sentence) from (turn_id, seq, delta)."""
    f = fold_stream if streaming else fold_batch
    return f(deltas, "turn_id", "seq", folds.Turn, SENTENCE[1], SENTENCE[0])


def reserve(calls: DataFrame, quota: int, key_cap: int, server_cap: int, streaming: bool = False) -> DataFrame:
    """(day, event_id, verdict) from (day, seq, event_id, key, engine); one state per day."""
    f = fold_stream if streaming else fold_batch
    return f(calls, "day", "seq", lambda: folds.Reservation(quota, key_cap, server_cap), QUOTA[1], QUOTA[0])


FINAL = ("session long, end double, text string", lambda m, r: [(r.session, e, t) for e, t in m.feed(r.kind, r.end, r.text)])


def reconcile(segments: DataFrame) -> DataFrame:
    """(session, text): finals in order of arrival and the newest interim, late segments dropped."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine = folds.Reconciler()
        for r in rows.sort_values("seq").itertuples():
            machine.feed(r.kind, r.end, r.text)
        return pd.DataFrame({"session": [rows["session"].iloc[0]], "text": [machine.finish()]})

    return segments.groupBy("session").applyInPandas(run, "session long, text string")


def reconciled(segments: DataFrame, streaming: bool = False, idle: str | None = None) -> DataFrame:
    """(session, end, text): each final segment as it is accepted; on a stream with ``idle`` (milliseconds), a
    session that ends with an interim gives it last, with the committed time."""
    if not streaming:
        return fold_batch(segments, "session", "seq", folds.Reconciler, FINAL[1], FINAL[0])
    last = lambda key, m: [(key, m.committed, m.interim)] if m.interim else []
    return fold_stream(segments, "session", "seq", folds.Reconciler, FINAL[1], FINAL[0], idle, last)


def tumbling(events: DataFrame, size: str, late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per window and key; late rows beyond the watermark are dropped on streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, size: str, slide: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Replayed rows once: by key within the watermark on streams, by key overall in batches."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def ticks(sessions_: DataFrame, tick_s: int, cap_s: int, longest_s: int) -> DataFrame:
    """(session, tick, charged): whole ticks of a session until the cap or the longest session is reached."""
    n = F.least(F.ceil(F.col("seconds") / tick_s), F.ceil(F.lit(cap_s / tick_s)), F.ceil(F.lit(longest_s / tick_s))).cast("int")
    return sessions_.where("seconds > 0").select("session", F.explode(F.sequence(F.lit(1), n)).alias("tick")).withColumn("charged", F.col("tick") * tick_s)


def barge_in(turns: DataFrame) -> DataFrame:
    """(turn_id, spoken, cut): what was played of a turn (turn_id, sentences, played_seq) before it was cut."""
    played = F.slice("sentences", 1, F.greatest(F.coalesce("played_seq", F.size("sentences")), F.lit(0)))
    return turns.select("turn_id", F.array_join(played, " ").alias("spoken"), (F.size(played) < F.size("sentences")).alias("cut"))
