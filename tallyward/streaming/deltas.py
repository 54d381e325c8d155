"""Gap and change flags of a stream of events, kept on the engine's state store.

An account's recent events are in its state, cut into slots of time, so an event that comes out of order finds the
event before it and the event after it. Both are then written: the new row, and a revision of the row after it, whose
gap has changed. Rows carry a revision; the highest one of an event is its result (:func:`latest_revision`), and
that result does not depend on the order of arrival, as long as an event is not older than ``horizon`` seconds before the
newest one of its account at the start of a batch. Older ones are written with ``late`` set and a gap of 0, and change nothing.

Accounts are dealt to groups by a hash, and a group is a key of the state store, since each key costs a call of the processor,
several calls of the store and frames of its own in every batch, however few its rows are. The state of a group holds the
events of its small accounts in one value of bounded size, read and written once a batch. A busy account, or one for which the
value has no room, is kept by itself: the first and last event of each slot in one entry, and the events of each slot in
entries of their own, so a batch reads and writes only the slots it touches, and a busy account is never one state value. Rows
of a batch come in pieces of bounded size and are taken piece by piece. Slots behind the horizon are removed, but for the last
event before it. With ``idle``, an account without events for so many seconds of processing time loses its state and begins
anew; the engine forgets keys as a whole, so each account of such a stream is a key. It checks the clock in every trigger, so it
runs on and has no end (a run to the end of a source needs ``idle=None``).

A repeated delivery within the horizon adds nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyward.operators.sequence import CHANGES
from tallyward.streaming.sources import parquet_step, run_available, state_store

ORDER = ["ts", "event_id"]
CARRIED = [*ORDER, *CHANGES.values()]
HOUR = 3600
SLOT, HORIZON = HOUR, 24 * HOUR
HELD_ROWS = 50_000  # events that a batch adds in memory before they go to the map
GROUPS = 4_096  # keys that accounts are dealt to
FEW_ROWS = 500  # events of an account in the value of its group
GROUP_ROWS = 50_000  # events in the value of a group

EVENT = T.StructType([*[T.StructField(n, T.LongType()) for n in ORDER], *[T.StructField(n, T.StringType()) for n in CHANGES.values()]])
EDGES = T.StructType(
    [T.StructField("revision", T.LongType()), T.StructField("slot", T.ArrayType(T.LongType())), *[T.StructField(n, T.ArrayType(EVENT)) for n in ("first", "last")]]
)
EVENTS = T.StructType([T.StructField("events", T.ArrayType(EVENT))])
FEW = T.StructType(
    [
        T.StructField("busy", T.LongType()),  # accounts that are kept by themselves
        *[T.StructField(n, T.ArrayType(t)) for n, t in [("user_id", T.StringType()), ("revision", T.LongType()), ("events", T.LongType())]],
        *[T.StructField(f"all_{f.name}", T.ArrayType(f.dataType)) for f in EVENT],  # of one account after the other, in order
    ]
)


def output(user_type: T.DataType) -> T.StructType:
    kinds = {"user_id": user_type, "event_id": T.LongType(), "ts": T.LongType(), "delta": T.LongType(), **dict.fromkeys(CHANGES, T.DoubleType())}
    return T.StructType([T.StructField(n, t) for n, t in [*kinds.items(), ("late", T.BooleanType()), ("revision", T.LongType())]])


def column(values: pd.Series) -> list:
    """Python values; missing ones are None."""
    return [None if v is None or v != v else v for v in values.tolist()] if values.hasnans else values.tolist()


def frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["user_id", "event_id", "ts", "delta", *CHANGES, "late", "revision"])


class Account:
    """Orders the events of an account as they come; ``known`` returns the stored events of a slot."""

    def __init__(self, user, slot: int, horizon: int, known: Callable[[int], list[tuple]], saved: tuple = (0, [], [], [])):
        self.user, self.slot, self.horizon, self.known = user, slot, horizon, known
        self.revision = saved[0]
        # first and last event by slot, and the slots in order
        self.ends = {s: (tuple(a), tuple(b)) for s, a, b in zip(*saved[1:])}
        self.order = sorted(self.ends)
        self.held: dict[int, list[tuple]] = {}
        self.n_held = 0
        self.floor = self.horizon_slot()

    def horizon_slot(self) -> int | None:
        """The first slot within the horizon."""
        return (self.ends[self.order[-1]][1][0] - self.horizon) // self.slot if self.order else None

    def take(self, new: Iterable[tuple], out: list[tuple]) -> None:
        """Put new events into their slots; rows of these and of the events after them."""
        for slot, group in groupby(sorted(new, key=lambda e: e[:2]), lambda e: e[0] // self.slot):
            if self.floor is not None and slot < self.floor:
                out += [(self.user, e[1], e[0], 0, 0.0, 0.0, 0.0, True, 0) for e in group]
            else:
                self._take(slot, list(group), out)

    def _take(self, slot: int, new: list[tuple], out: list[tuple]) -> None:
        if slot not in self.held:
            self.held[slot] = self.known(slot) if slot in self.ends else []
        there = {e[:2] for e in self.held[slot]}
        new = [e for e in new if e[:2] not in there]
        if not new:
            return
        events = sorted([*self.held[slot], *new], key=lambda e: e[:2])
        self.held[slot] = events
        self.n_held += len(new)
        self.revision += 1
        if slot not in self.ends:
            insort(self.order, slot)
        at = bisect_left(self.order, slot)
        before = self.ends[self.order[at - 1]][1] if at else None
        fresh = {e[:2] for e in new}
        changed = False
        for e in events:
            if e[:2] in fresh or changed:
                out.append(self._row(e, before))
            changed, before = e[:2] in fresh, e
        if changed and at + 1 < len(self.order):
            out.append(self._row(self.ends[self.order[at + 1]][0], before))
        self.ends[slot] = (events[0], events[-1])

    def _row(self, e: tuple, before: tuple | None) -> tuple:
        delta = e[0] - before[0] if before else 0
        flags = [float(before is not None and None not in (a, b) and a != b) for a, b in zip(e[2:], before[2:] if before else e[2:])]
        return (self.user, e[1], e[0], delta, *flags, False, self.revision)

    def store(self, events, prefix: tuple = (), floor: int | None = None) -> None:
        """Write the held slots to a map of state; with a floor, forget what lies before it, but for the last event."""
        for slot, rows in self.held.items():
            if floor is None or slot >= floor:
                events.updateValue((*prefix, slot), (rows,))
        if floor is not None:
            n = bisect_left(self.order, floor)
            for slot in self.order[:n]:
                events.removeKey((*prefix, slot))
            for slot in self.order[: max(0, n - 1)]:
                del self.ends[slot]
            self.order = self.order[max(0, n - 1) :]
        self.held, self.n_held = {}, 0

    def state(self) -> tuple:
        """Revision, slots, and the first and last event of each."""
        return (self.revision, self.order, [self.ends[s][0] for s in self.order], [self.ends[s][1] for s in self.order])


class Gaps(StatefulProcessor):
    """Keeps each account under a key of its own."""

    def __init__(self, slot: int = SLOT, horizon: int = HORIZON, idle: int | None = None):
        self.slot, self.horizon, self.idle = slot, horizon, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.idle is None else self.idle * 1000
        self.edges = handle.getValueState("edges", EDGES, ttl)
        self.events = handle.getMapState("events", T.StructType([T.StructField("slot", T.LongType())]), EVENTS, ttl)

    def _known(self, slot: int) -> list[tuple]:
        found = self.events.getValue((slot,))
        return [tuple(e) for e in found[0]] if found else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        account = Account(key[0], self.slot, self.horizon, self._known, self.edges.get() if self.edges.exists() else (0, [], [], []))
        for piece in rows:
            out: list[tuple] = []
            account.take(set(zip(*[column(piece[c]) for c in CARRIED])), out)
            if out:
                yield frame(out)
            if account.n_held > HELD_ROWS:
                account.store(self.events)
        account.store(self.events, floor=account.horizon_slot())
        self.edges.update(account.state())

    def close(self) -> None:
        pass


class GroupGaps(StatefulProcessor):
    """Keeps the accounts of a group: small ones in one value, others by account and slot."""

    def __init__(self, slot: int = SLOT, horizon: int = HORIZON):
        self.slot, self.horizon = slot, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        user = T.StructField("user_id", T.StringType())
        self.few = handle.getValueState("few", FEW, None)
        self.edges = handle.getMapState("edges", T.StructType([user]), EDGES, None)
        self.events = handle.getMapState("events", T.StructType([user, T.StructField("slot", T.LongType())]), EVENTS, None)

    def _small(self, user, revision: int, events: list[tuple]) -> Account:
        """An account of the value: all its events are held."""
        slots = {s: list(g) for s, g in groupby(events, lambda e: e[0] // self.slot)}
        account = Account(user, self.slot, self.horizon, lambda slot: [], (revision, list(slots), [g[0] for g in slots.values()], [g[-1] for g in slots.values()]))
        account.held = slots
        return account

    def _own(self, user) -> Account | None:
        """An account that is kept by itself."""
        saved = self.edges.getValue((user,))
        return Account(user, self.slot, self.horizon, self._slots(user), saved) if saved else None

    def _slots(self, user) -> Callable[[int], list[tuple]]:
        def known(slot: int) -> list[tuple]:
            found = self.events.getValue((user, slot))
            return [tuple(e) for e in found[0]] if found else []

        return known

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        busy, users, revisions, sizes, *columns = self.few.get() if self.few.exists() else (0, *[[] for _ in FEW.fields[1:]])
        stored = zip(*columns)
        small = {u: self._small(u, r, list(islice(stored, n))) for u, r, n in zip(users, revisions, sizes)}
        own: dict[str, Account] = {}
        n_small = len(columns[0])
        known_busy = busy
        for piece in rows:
            new: dict[str, list[tuple]] = {}
            for user, *event in set(zip(*[column(piece[c]) for c in ("user_id", *CARRIED)])):
                new.setdefault(user, []).append(tuple(event))
            out: list[tuple] = []
            for user, events in new.items():
                account = own.get(user) or small.get(user)
                if account is None and known_busy:
                    account = self._own(user)
                    if account:
                        own[user] = account
                if account is None:
                    account = small[user] = self._small(user, 0, [])
                before = account.n_held
                account.take(events, out)
                if user in small:
                    n_small += account.n_held - before
            if out:
                yield frame(out)
            if n_small > GROUP_ROWS:
                busy, n_small = self._part(small, own, busy)
            if sum(a.n_held for a in own.values()) > HELD_ROWS:
                for user, account in own.items():
                    account.store(self.events, (user,))
        busy, _ = self._part(small, own, busy, last=True)
        for user, account in own.items():
            account.store(self.events, (user,), account.horizon_slot())
            self.edges.updateValue((user,), account.state())
        kept = [[e for slot in a.order for e in a.held[slot]] for a in small.values()]
        flat = [list(c) for c in zip(*chain.from_iterable(kept))] or [[] for _ in EVENT.fields]
        self.few.update((busy, list(small), [a.revision for a in small.values()], [len(k) for k in kept], *flat))

    def _part(self, small: dict, own: dict, busy: int, last: bool = False) -> tuple[int, int]:
        """Move accounts with many events out of the value, and the largest while it has too many; (accounts kept by themselves, events left)."""
        sizes = {}
        for user, account in small.items():
            if last:
                self._forget(account)
            sizes[user] = sum(map(len, account.held.values()))
        left = sum(sizes.values())
        for user in sorted(sizes, key=sizes.get, reverse=True):
            if sizes[user] <= FEW_ROWS and left <= GROUP_ROWS:
                break
            account = own[user] = small.pop(user)  # all its events are held, so they go to the map
            account.n_held = sizes[user]
            account.known = self._slots(user)
            busy, left = busy + 1, left - sizes[user]
        return busy, left

    def _forget(self, account: Account) -> None:
        """Leave of what lies before the horizon only the last event."""
        n = bisect_left(account.order, account.horizon_slot())
        for slot in account.order[: max(0, n - 1)]:
            del account.held[slot], account.ends[slot]
        account.order = account.order[max(0, n - 1) :]
        if n:
            account.held[account.order[0]] = account.held[account.order[0]][-1:]

    def close(self) -> None:
        pass


def stream_gaps(events: DataFrame, slot: int = SLOT, horizon: int = HORIZON, idle: int | None = None, groups: int = GROUPS) -> DataFrame:
    """A stream of (user_id, event_id, ts, delta, change flags, late, revision) from user_id, event_id, ts, ip, device_fp and country."""
    kind = events.schema["user_id"].dataType
    carried = [F.col(c).cast(EVENT[c].dataType) for c in CARRIED]
    if idle is not None:
        return events.select("user_id", *carried).groupBy("user_id").transformWithStateInPandas(
            statefulProcessor=Gaps(slot, horizon, idle), outputStructType=output(kind), outputMode="Append", timeMode="ProcessingTime"
        )
    # an id as text is the same in frames with missing ids
    rows = events.select(F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("group"), F.col("user_id").cast("string"), *carried)
    found = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=GroupGaps(slot, horizon), outputStructType=output(T.StringType()), outputMode="Append", timeMode="None"
    )
    return found.withColumn("user_id", F.col("user_id").cast(kind))


def latest_revision(rows: DataFrame) -> DataFrame:
    """One row per event: its highest revision; a late delivery counts only for an event that has no other row."""
    names = [c for c in rows.columns if c not in ("event_id", "revision")]
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*names), "revision").alias("_r")).select("event_id", "_r.*")


def late_events(rows: DataFrame) -> DataFrame:
    """The side output: events behind the horizon of their account."""
    return latest_revision(rows).filter("late")


def run_deltas(events: DataFrame, sink: str, slot: int = SLOT, horizon: int = HORIZON) -> DataFrame:
    """Run over everything that is there; rows and revisions go to ``sink``, the result is the latest of each event."""
    spark: SparkSession = events.sparkSession
    result = stream_gaps(events, slot, horizon)
    with state_store(spark):
        run_available(result, parquet_step(sink), "deltas")
    return latest_revision(spark.read.schema(result.schema).parquet(sink).select(*result.columns))
