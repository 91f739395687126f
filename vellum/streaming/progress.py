"""Streaming progress: the latest event of each task, and the task state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.shipping import ship

TERMINAL = ("completed", "failed")
STATE = "task_id string, seq long, status string, closed boolean"


def latest_progress(events: DataFrame, key: str = "task_id", order: str = "seq") -> DataFrame:
    """(key, latest struct): only the newest event of each key; for update mode, or batch."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("latest"))


def delivered(events: DataFrame, status: str = "status", key: str = "task_id", order: str = "seq") -> DataFrame:
    """Events that a subscription delivers: up to the first that ends its task, which closes it."""
    ends = events.where(F.col(status).isin(*TERMINAL)).groupBy(key).agg(F.min(order).alias("__end"))
    return events.join(ends, key, "left").where(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).drop("__end")


def delivered_stream(events: DataFrame) -> DataFrame:
    """``delivered`` as events (task_id, seq, status) stream in: what comes after a task's end is not told; of a task only its end is held."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        if state.exists:
            return
        over = rows["status"].isin(TERMINAL).to_numpy()
        if over.any():
            rows = rows[: int(over.argmax()) + 1]
            state.update((int(rows["seq"].iloc[-1]),))
        yield rows[["task_id", "seq", "status"]]

    ship(events.sparkSession)
    return events.select("task_id", "seq", "status").groupBy("task_id").applyInPandasWithState(update, "task_id string, seq long, status string", "seq long", "append", "NoTimeout")


def task_states(events: DataFrame):
    """State of each task as events (task_id, seq, event) arrive: one row for every batch that changes it.

    A terminal state closes the subscription and clears what is held, except for a failed
    task's right to be retried.
    """
    moves = {("pending", "start"): "processing", ("processing", "complete"): "completed", ("processing", "fail"): "failed", ("failed", "retry"): "pending"}

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("pending", -1)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for seq, event in zip(rows["seq"], rows["event"], strict=True):
            if seq <= last:
                continue  # older than what was seen: dropped, as only the latest counts
            last = int(seq)
            if event in ("cancel", "restart"):
                status = "failed" if status in ("pending", "processing") else status
            else:
                status = moves.get((status, event), status)
        state.update((status, last))
        yield pd.DataFrame({"task_id": [key[0]], "seq": [last], "status": [status], "closed": [status in TERMINAL]})

    ship(events.sparkSession)
    return events.groupBy("task_id").applyInPandasWithState(update, STATE, "status string, seq long", "update", "NoTimeout")
