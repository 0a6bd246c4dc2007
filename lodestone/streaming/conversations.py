"""Conversations as state: each question meets the last messages before it, over any number of micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import chat

MESSAGES = "array<struct<turn:long,role:string,text:string>>"
DAY_MS = 24 * 3600 * 1000


def _tails(last: int, idle_ms: int | None):
    """State of a conversation: its last messages as JSON, forgotten some time after the last of them came."""

    def turn(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # A conversation's messages of one micro-batch, whose size is the source's to bound, come in any order.
        new = pd.concat(list(frames)).sort_values("turn", kind="stable")
        tail = json.loads(state.get[0]) if state.exists else []
        asked = []
        for at, role, text in zip(new["turn"].tolist(), new["role"].tolist(), new["text"].tolist(), strict=True):
            role, text = (x if isinstance(x, str) else None for x in (role, text))
            if (role or "").lower() == "user":
                asked.append((at, text, [{"turn": t, "role": r, "text": x} for t, r, x in tail if t < at][-last:]))
            tail = sorted([*tail, [at, role, text]], key=lambda m: m[0])[-last - 1 :]
        state.update((json.dumps(tail),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if asked:
            yield pd.DataFrame({"conv_id": [key[0]] * len(asked), "turn": [a[0] for a in asked], "question": [a[1] for a in asked], "messages": [json.dumps(a[2]) for a in asked]})

    return turn


def questions(messages: DataFrame, last: int = chat.HISTORY, idle_ms: int | None = DAY_MS) -> DataFrame:
    """A stream of messages(conv_id, turn, role, text) -> conv_id, turn, question and history of each message of a user: the rendered last ``last`` messages before it.

    Answers come back as messages of the stream. What is kept of a conversation is its last messages, until ``idle_ms`` after the last of
    them; a message that comes after later ones sees those of them that are kept and were before it. Messages without a turn are left out.
    A stream that forgets runs on without new messages; one that ends with its input (``availableNow``) takes ``idle_ms=None``.
    """
    rows = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    schema = "conv_id long, turn long, question string, messages string"
    found = rows.groupBy("conv_id").applyInPandasWithState(_tails(last, idle_ms), schema, "messages string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return found.select("conv_id", "turn", "question", chat.rendered_messages(F.from_json("messages", MESSAGES)).alias("history"))
