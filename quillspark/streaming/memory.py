"""Session memory of a stream: the newest notes of each chat, forgotten after a pause."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LONGEST = 4000  # bytes of a note; longer ones are not taken
_OUT = "chat long, notes string, n int, updated timestamp, batch_order long, expired boolean"


def remembered(notes: DataFrame, newest: int = 20, ttl_hours: float = 24.0, late: str = "1 hour") -> DataFrame:
    """(chat, notes, n, updated, batch_order, expired) in update mode: what a chat holds after each batch
    that changed it, its notes joined by "|" in order; expired, with no notes, when its time is up.

    notes: (chat, text, at, seq), seq ordering notes of one moment. A chat keeps its `newest` notes;
    state and output of a chat are bounded by that. A note that comes more than ttl_hours after
    the one before it finds an empty memory. Time is event time: rows more than `late`
    behind the newest are dropped, and a chat expires when the watermark passes its
    last note by ttl_hours. Notes of over 4000 bytes, null texts, times and chats are left out.
    """
    ttl = int(ttl_hours * 3_600_000)

    def keep(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield _row(key[0], [], held[-1][0] if held else 0, True)
            return
        new = pd.concat(list(batches)).sort_values(["ms", "seq"])
        for ms, text in zip(new.ms.tolist(), new.text.tolist(), strict=True):
            if held and ms - held[-1][0] > ttl:
                held = []
            held = sorted([*held, [ms, text]], key=lambda x: x[0])[-newest:]
        state.update((json.dumps(held),))
        # a timeout has to lie ahead of the watermark
        state.setTimeoutTimestamp(max(held[-1][0] + ttl, state.getCurrentWatermarkMs() + 1))
        yield _row(key[0], held, held[-1][0], False)

    good = notes.where(F.col("chat").isNotNull() & F.col("at").isNotNull() & (F.octet_length("text") <= LONGEST))
    timed = good.withWatermark("at", late).select("chat", "text", "at", "seq", F.unix_millis("at").alias("ms"))
    return timed.groupBy("chat").applyInPandasWithState(keep, _OUT, "held string", "update", GroupStateTimeout.EventTimeTimeout)


def _row(chat: int, held: list, ms: int, expired: bool) -> pd.DataFrame:
    at = pd.Timestamp(ms, unit="ms")
    return pd.DataFrame({"chat": [chat], "notes": ["|".join(t for _, t in held)], "n": pd.Series([len(held)], dtype="int32"), "updated": [at], "batch_order": [ms], "expired": [expired]})
