"""Online surprise: the transition model applied event by event, with a rolling mean per account.

An event older than the last one of its account is late: it is emitted with ``late`` set and without a surprise,
and leaves the account's state alone. A repeated delivery of the last event adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyward.functions.expr import DELTA_BUCKETS
from tallyward.operators.sequence import CONTENT_BUCKETS, SMOOTH

def output(user_type: T.DataType) -> T.StructType:
    """Result columns; ids of accounts keep their type."""
    kinds = {"user_id": user_type, "event_id": T.LongType(), "ts": T.LongType(), "surprise": T.DoubleType(), "rolling": T.DoubleType()}
    return T.StructType([T.StructField(n, t) for n, t in [*kinds.items(), ("late", T.BooleanType())]])


LAST = T.StructType([T.StructField(n, T.LongType()) for n in ("ts", "gap", "content", "event_id")])
RING = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))])


def loss_tables(model_rows: list) -> tuple[np.ndarray, np.ndarray]:
    """-log p of the next gap and next content for every state, from the (bounded) model table."""
    gap = np.full((DELTA_BUCKETS, CONTENT_BUCKETS, DELTA_BUCKETS), math.log(DELTA_BUCKETS))
    content = np.full((DELTA_BUCKETS, CONTENT_BUCKETS, CONTENT_BUCKETS), math.log(CONTENT_BUCKETS))
    for r in model_rows:  # a known state first gets the floor of unseen transitions
        gap[r["gap"], r["content"], :] = math.log(r["total"] + DELTA_BUCKETS)
        content[r["gap"], r["content"], :] = math.log(r["total"] + CONTENT_BUCKETS)
    for r in model_rows:
        table = gap if r["head"] == "gap" else content
        table[r["gap"], r["content"], r["next"]] = -math.log(r["p"])
    return gap, content


class Surprise(StatefulProcessor):
    """Keeps the last event and the last 16 surprises of an account."""

    def __init__(self, gap_loss: np.ndarray, content_loss: np.ndarray, width: int = SMOOTH):
        self.gap_loss, self.content_loss, self.width = gap_loss, content_loss, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST)
        self.ring = handle.getValueState("ring", RING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # arrays: an account has few rows in a batch, and every call on a frame costs as much as hundreds of them
        pieces = list(rows)
        ts, content = (np.concatenate([p[c].to_numpy(np.int64) for p in pieces]) for c in ("ts", "content"))
        ids = np.concatenate([p["event_id"].to_numpy() for p in pieces])
        at = np.unique(ids, return_index=True)[1]
        at = at[np.lexsort((ids[at], ts[at]))]
        ts, ids, content = ts[at], ids[at], content[at]
        last = self.last.get()
        if last:
            old = (ts < last[0]) | ((ts == last[0]) & (ids < last[3]))
            if old.any():
                yield self._rows(key[0], ids[old], ts[old], np.nan, np.nan, True)
            new = ~old & ~((ts == last[0]) & (ids == last[3]))
            ts, ids, content = ts[new], ids[new], content[new]
            if not len(ts):
                return
        before = np.concatenate(([last[0] if last else ts[0]], ts[:-1]))
        gap = np.clip(np.floor(np.log10(np.maximum(ts - before, 1))), 0, DELTA_BUCKETS - 1).astype(np.int64)
        from_gap = np.concatenate(([last[1] if last else 0], gap[:-1]))
        from_content = np.concatenate(([last[2] if last else 0], content[:-1]))
        loss = self.gap_loss[from_gap, from_content, gap] + self.content_loss[from_gap, from_content, content]
        start = 0 if last else 1  # the first event of an account has nothing to be predicted from
        ring = self.ring.get()
        kept = list(ring[0]) if ring else []
        series = np.array(kept + loss[start:].tolist())
        sums = np.concatenate(([0.0], np.cumsum(series)))
        n, w = len(series), self.width
        rolling = [(sums[i + 1] - sums[i + 1 - w]) / w if i + 1 >= w else np.nan for i in range(len(kept), n)]
        self.last.update((int(ts[-1]), int(gap[-1]), int(content[-1]), int(ids[-1])))
        self.ring.update((series[-w:].tolist(),))
        yield self._rows(key[0], ids[start:], ts[start:], loss[start:], rolling, False)

    @staticmethod
    def _rows(user, ids, ts, surprise, rolling, late: bool) -> pd.DataFrame:
        return pd.DataFrame(
            {"user_id": user, "event_id": ids, "ts": ts, "surprise": surprise, "rolling": np.asarray(rolling, np.float64), "late": late}, index=range(len(ids))
        )

    def close(self) -> None:
        pass


def online_surprise(events: DataFrame, model_table: DataFrame) -> DataFrame:
    """``events`` is a stream of user_id, event_id, ts, content in [0, 32).

    The model has at most 8 * 32 * 40 rows and travels with the processor. An account's rows of one
    micro-batch are handled together, so the trigger size of the source bounds that group.
    """
    gap, content = loss_tables(model_table.collect())
    return events.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Surprise(gap, content), outputStructType=output(events.schema["user_id"].dataType), outputMode="Append", timeMode="None"
    )
