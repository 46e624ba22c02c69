"""Turns assembled as messages arrive, in any order within the watermark's delay.

A conversation's state is what has come too early, and the turn that is open. A message waits
until the watermark has passed its time, as an earlier one may still come; then messages
are taken in order: a user's closes the open turn and begins the next. A timer wakes the
conversation when a waiting message is due, or when the open turn has been idle for the gap,
which closes it. Repeats of a message are known by its number for as long as they may come.

A call of the Python function and its state cost some milliseconds, however few messages there
are. So conversations may share them, by tens: each has its entry in the state, and is told as if
it were alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemolake.session import ship

OUT = "turn_no long, n long, first_no long, last_no long, complete boolean, closed_by string"
#: An entry a conversation. waiting: messages that are not due; seen: those that were taken (number, time); the open turn.
STATE = "conversations array<struct<conversation: string, waiting: array<struct<no: bigint, at: bigint, role: string, filled: boolean>>, seen: array<struct<no: bigint, at: bigint>>, turn_no: bigint, n: bigint, first_no: bigint, last_no: bigint, last_at: bigint, opened_right: boolean, ended_right: boolean, begun: boolean>>"
_NEW = ([], [], 0, 0, 0, 0, 0, False, False, False)


def _told(entry: tuple, came: list[tuple], now: int, gap_ms: int, remember_ms: int) -> tuple[tuple | None, list[tuple], int | None]:
    """A conversation's entry (None: nothing to keep), closed turns and next waking time, after messages (no, at, role, filled) that came."""
    waiting, seen, turn_no, n, first_no, last_no, last_at, opened, ended, begun = entry
    queue = {m[0]: (m[1], m[0], m[2], m[3]) for m in waiting}
    known = dict(seen)
    for no, at, role, filled in came:
        if no not in known and no not in queue:
            queue[no] = (at, no, role, filled)
    out = []

    def close(how: str) -> None:
        out.append((turn_no, n, first_no, last_no, opened and ended, how))

    due = sorted(m for m in queue.values() if m[0] <= now)
    for at, no, role, filled in due:
        del queue[no]
        known[no] = at
        user = role == "user"
        if n and (user or at - last_at > gap_ms):
            close("user" if at - last_at <= gap_ms else "idle")
            n = 0
        if not n:
            turn_no, first_no, opened = turn_no + begun, no, user and filled
            begun = True
        n, last_no, last_at, ended = n + 1, no, at, role == "assistant" and filled
    if n and now - last_at > gap_ms:
        close("idle")
        n = 0
    known = {no: at for no, at in known.items() if at > now - remember_ms}
    wakes = [at for at, *_ in queue.values()] + ([last_at + gap_ms + 1] if n else [at + remember_ms for at in known.values()])
    if not (queue or n or known or begun):
        return None, out, None
    kept = [(no, at, role, filled) for at, no, role, filled in sorted(queue.values())]
    return (kept, sorted(known.items()), turn_no, n, first_no, last_no, last_at, opened, ended, begun), out, min(wakes, default=None)


def _turns(gap_ms: int, remember_ms: int) -> Callable[[tuple, Iterable[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = {r[0]: r[1:] for r in state.get[0]} if state.exists else {}
        now = state.getCurrentWatermarkMs()
        came: dict[str | None, list[tuple]] = {}
        for b in batches:
            for name, *message in zip(b["conversation"].tolist(), b["no"].tolist(), b["at_ms"].tolist(), b["role"].tolist(), b["filled"].tolist(), strict=True):
                came.setdefault(name, []).append(message)
        kept, out, wakes = [], [], []
        for name in entries | came:
            entry, closed, wake = _told(entries.get(name, _NEW), came.get(name, []), now, gap_ms, remember_ms)
            out += [(name, *turn) for turn in closed]
            if entry:
                kept.append((name, *entry))
            if wake is not None:
                wakes.append(wake)
        if kept:
            state.update((kept,))
            if wakes:
                state.setTimeoutTimestamp(max(min(wakes), now + 1))
        if out:
            yield pd.DataFrame(out, columns=["conversation", "turn_no", "n", "first_no", "last_no", "complete", "closed_by"])

    return run


def assembled_turns(stream: DataFrame, conversation: str, no: str, role: str, text: str, at: str, gap: str = "2 hours", delay: str = "10 minutes", remember: str = "1 day", together: Column | None = None) -> DataFrame:
    """(conversation, turn_no, n, first_no, last_no, complete, closed_by) of each turn as it is
    closed, by the next user's message or by ``gap`` without any.

    stream has a row a message: its number ``no`` and its time rise together within a
    conversation, whose id is a number or a text. A turn is complete if a user's message begins it and
    an assistant's ends it, neither blank. Messages that come later than ``delay`` after newer ones are
    dropped; repeats are told by their number for ``remember``. What follows an idle turn
    without a user's message is a turn of its own.

    together: conversations of equal values share calls and a state; a function of the
    conversation's id alone that gives some tens of them a value (default: each by itself). A call goes
    through all of them, so a value should not gather more as the stream goes on.
    """
    millis = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    kind = stream.schema[conversation].dataType
    ship(stream.sparkSession)
    rows = stream.withWatermark(at, delay).select(
        (F.col(conversation) if together is None else together).alias("together"),
        F.col(conversation).cast("string").alias("conversation"),
        F.col(no).cast("long").alias("no"),
        F.col(role).alias("role"),
        (F.trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("filled"),
        F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"),
        F.col(at).alias("at"),
    )
    told = rows.groupBy("together").applyInPandasWithState(_turns(millis(gap), millis(remember)), f"conversation string, {OUT}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("conversation", F.col("conversation").cast(kind))
