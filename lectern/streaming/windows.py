"""Streams: sessions of timed events, and the sliding alignment window with an untrusted tail.

A stream that fails is started again from its checkpoint by whoever runs it; ``progressed`` tells a supervisor whether a start
got anywhere, so that it can give up after a number of starts or of starts in vain.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, n, value) of sessions that a gap ends. The same code for streams (with ``late``) and tables."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        own = own.withWatermark("ts", late)
    out = own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "value")


@dataclass
class Cursor:
    """What a chapter's alignment carries from window to window."""

    pos: int = 0
    clock: float = 0.0
    forced: int = 0


def commit(cursor: Cursor, words: list[tuple[int, float, float]], start: float, length: float, safety: float, final: bool) -> tuple[Cursor, list[tuple[int, float, float]]]:
    """Accept a window's words (pos, s, e; relative to its start) from the cursor on.

    Words that end within ``safety`` of the window's end are not trusted and stay queued, and so do all after
    them; in the final window all count. If none is trusted, exactly one is accepted, so that a window always
    makes progress; the final window may end without any.
    """
    limit = start + length - (0.0 if final else safety)
    taken: list[tuple[int, float, float]] = []
    queued = [(p, start + s, start + e) for p, s, e in words if p >= cursor.pos]
    for p, s, e in queued:
        if e > limit and not final:
            break
        taken.append((p, s, e))
    forced = cursor.forced
    if not taken and queued and not final:
        taken, forced = queued[:1], forced + 1
    if not taken:
        return cursor, []
    return Cursor(taken[-1][0] + 1, max(cursor.clock, taken[-1][2]), forced), taken


WINDOWS = "key string, step long, start double, length double, final boolean, words array<struct<pos:long,s:double,e:double>>"
COMMITS = "key string, step long, pos long, s double, e double"


def _run(cursor: Cursor, rows: pd.DataFrame, safety: float) -> tuple[Cursor, pd.DataFrame]:
    out = []
    for r in rows.sort_values("step").itertuples():
        words = [(int(w["pos"]), float(w["s"]), float(w["e"])) for w in (r.words if r.words is not None else [])]
        cursor, taken = commit(cursor, words, r.start, r.length, safety, bool(r.final))
        out += [(r.key, r.step, p, s, e) for p, s, e in taken]
    return cursor, pd.DataFrame(out, columns=["key", "step", "pos", "s", "e"])


def commit_table(windows: DataFrame, safety: float = 12.0) -> DataFrame:
    """All windows of each chapter at once, from a table."""
    return windows.groupBy("key").applyInPandas(lambda rows: _run(Cursor(), rows, safety)[1], COMMITS)


def commit_stream(windows: DataFrame, safety: float = 12.0) -> DataFrame:
    """Windows as they come, with the cursor in the state store; its checkpoint takes the place of a saved cursor file.

    Windows that come before their turn are held in the state until the steps before them are there, so the result
    doesn't depend on how a chapter's windows are cut into batches; steps that are already done are left out. A chapter
    holds few windows at a time, and its steps count from 0 without gaps.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, clock, forced, done, held = state.get if state.exists else (0, 0.0, 0, 0, b"")
        rows, done, held = in_turn(pd.concat(list(batches)), done, held)
        cursor, out = _run(Cursor(pos, clock, forced), rows, safety)
        state.update((cursor.pos, cursor.clock, cursor.forced, done, held))
        yield out

    return windows.groupBy("key").applyInPandasWithState(step, COMMITS, "pos long, clock double, forced long, done long, held binary", "append", GroupStateTimeout.NoTimeout)


def in_turn(rows: pd.DataFrame, done: int, held: bytes) -> tuple[pd.DataFrame, int, bytes]:
    """The windows whose turn it is, of new ones and held ones; the next step; and the ones to hold on."""
    every = [r._asdict() for r in rows.itertuples(index=False)] + (pickle.loads(held) if held else [])
    by = {int(r["step"]): r for r in sorted(every, key=lambda r: int(r["step"]), reverse=True)}
    now = []
    while done in by:
        now.append(by.pop(done))
        done += 1
    later = [r for k, r in sorted(by.items()) if k > done]
    return pd.DataFrame(now, columns=list(rows.columns)), done, pickle.dumps(later) if later else b""


def progressed(before: int, after: int, attempts: int, vain: int, most: int = 20, most_vain: int = 2) -> tuple[str, int]:
    """What a supervisor does after a failed start, and the starts in vain so far: ``again``, or ``give up`` after too many.

    before, after: what was committed when the start began and ended.
    """
    vain = 0 if after > before else vain + 1
    return ("give up" if vain >= most_vain or attempts >= most else "again"), vain


class Buffer:
    """Samples of an ordered list of blocks, read forward only: what is committed is dropped and never read again.

    ``blocks`` gives arrays of samples of one rate; ``start`` is the clock at the first sample held, in seconds.
    """

    def __init__(self, blocks, rate: int):
        self.blocks, self.rate = iter(blocks), rate
        self.held, self.start, self.exhausted = np.zeros(0, np.float32), 0.0, False

    def ensure(self, seconds: float) -> bool:
        """Hold at least so many seconds, or all there is left."""
        need = int(seconds * self.rate)
        while len(self.held) < need and not self.exhausted:
            block = next(self.blocks, None)
            if block is None:
                self.exhausted = True
            else:
                self.held = np.concatenate([self.held, np.asarray(block, np.float32)])
        return len(self.held) >= need

    def window(self, seconds: float) -> tuple[np.ndarray, bool]:
        """The next samples, which stay held, and whether they are the last ones."""
        self.ensure(seconds)
        n = int(seconds * self.rate)
        return self.held[:n].copy(), self.exhausted and len(self.held) <= n

    def commit(self, seconds: float) -> None:
        n = min(int(seconds * self.rate), len(self.held))
        self.held = self.held[n:]
        self.start += n / self.rate

    @classmethod
    def fast_forward(cls, durations: list[float], read, rate: int, target: float) -> Buffer:
        """A buffer from ``target`` seconds on, without reading what lies before: ``read(k, seconds)`` gives the blocks of
        file k from there on and of all files after it. Beyond the end it is exhausted."""
        before = 0.0
        for k, seconds in enumerate(durations):
            if before + seconds > target:
                own = cls(read(k, target - before), rate)
                own.start = target
                return own
            before += seconds
        own = cls((), rate)
        own.start, own.exhausted = target, True
        return own


class EditAware:
    """The edit-aware loop over one chapter: windows commit words, checks on a cadence (or after a starved step) may skip
    text that the audio leaves out, and the check after a skip confirms it or takes it back."""

    def __init__(self, safety: float = 12.0, cadence: float = 90.0, wps: float = 2.5, share: float = 0.5, most_dead: int = 6):
        self.safety, self.cadence, self.wps, self.share, self.most_dead = safety, cadence, wps, share, most_dead
        self.cursor, self.since, self.dead, self.pending = Cursor(), 0.0, 0, None
        self.cuts: list[tuple[int, int]] = []
        self.status: list[tuple[int, str]] = []
        self.stopped = False

    def saved(self) -> tuple:
        """What a state store keeps between windows."""
        a0, a1 = self.pending or (-1, -1)
        return self.cursor.pos, self.cursor.clock, self.cursor.forced, self.since, self.dead, a0, a1, self.stopped

    def load(self, pos, clock, forced, since, dead, a0, a1, stopped) -> None:
        self.cursor, self.since, self.dead, self.stopped = Cursor(pos, clock, forced), since, dead, stopped
        self.pending = (a0, a1) if a0 >= 0 else None
        self.cuts = [self.pending] if self.pending else []

    def window(self, words, start, length, final, check) -> list[tuple[int, float, float]]:
        """One window. ``check`` is (decision, offset) of the check that would be made after it."""
        if self.stopped:
            return []
        before = self.cursor
        self.cursor, taken = commit(before, words, start, length, self.safety, final)
        seconds = self.cursor.clock - before.clock
        self.since += max(0.0, seconds)
        starved = seconds > 0 and len(taken) < self.share * self.wps * seconds
        if not (self.since >= self.cadence or starved or self.pending is not None):
            return taken
        self.since = 0.0
        decision, offset = check
        if self.pending is not None and decision != "ok":  # the skip was wrong: all since is an honest gap
            a0, a1 = self.pending
            end = max(a1, self.cursor.pos)
            self.status += [(p, "CUT") for p in range(a0, end)]
            if self.cuts and self.cuts[-1] == self.pending:
                self.cuts.pop()
            self.cursor = Cursor(end, self.cursor.clock, self.cursor.forced)
            self.pending = None
        elif decision == "cut":
            a0, a1 = self.cursor.pos, self.cursor.pos + offset
            self.cuts.append((a0, a1))
            self.status += [(p, "CUT") for p in range(a0, a1)]
            self.cursor = Cursor(a1, self.cursor.clock, self.cursor.forced)
            self.pending, self.dead = (a0, a1), 0
        else:
            self.pending = None
            self.dead = self.dead + 1 if decision == "deadzone" else 0
            self.stopped = self.dead >= self.most_dead
        return taken


def edit_aware_table(windows: DataFrame, **settings) -> DataFrame:
    """(key, step, pos, s, e, status) over windows with columns decision and offset; CUT rows have no times."""

    return windows.groupBy("key").applyInPandas(lambda rows: _edit_aware(EditAware(**settings), rows), COMMITS + ", status string")


def _edit_aware(own: EditAware, rows: pd.DataFrame) -> pd.DataFrame:
    out, seen = [], len(own.status)
    for r in rows.sort_values("step").itertuples():
        words = [(int(w["pos"]), float(w["s"]), float(w["e"])) for w in (r.words if r.words is not None else [])]
        out += [(r.key, r.step, p, s, e, "ALIGNED") for p, s, e in own.window(words, r.start, r.length, bool(r.final), (r.decision, int(r.offset)))]
        out += [(r.key, r.step, p, None, None, status) for p, status in own.status[seen:]]
        seen = len(own.status)
    return pd.DataFrame(out, columns=["key", "step", "pos", "s", "e", "status"])


def edit_aware_stream(windows: DataFrame, **settings) -> DataFrame:
    """The same loop over windows as they come, with its state in the state store; windows wait for their turn."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, done, held = EditAware(**settings), 0, b""
        if state.exists:
            *saved, done, held = state.get
            own.load(*saved)
        rows, done, held = in_turn(pd.concat(list(batches)), done, held)
        out = _edit_aware(own, rows)
        state.update((*own.saved(), done, held))
        yield out

    kept = "pos long, clock double, forced long, since double, dead long, a0 long, a1 long, stopped boolean, done long, held binary"
    return windows.groupBy("key").applyInPandasWithState(step, COMMITS + ", status string", kept, "append", GroupStateTimeout.NoTimeout)
