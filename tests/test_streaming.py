import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.operators import sequence as seq
from tallyward.session import new_folder
from tallyward.streaming import campaigns, deltas, hourly, surprise
from tallyward.streaming.sources import file_stream, latest_per_key, parquet_step, replay, run_available
from tests.fixtures import event, events


def feed(spark, *batches):
    """One file per batch, arriving in order."""
    import time

    folder = new_folder(spark, "feed")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # file order follows modification time
    return file_stream(spark, folder, batches[0].schema, "*.parquet", 1)


def timed(df):
    return df.withColumn("time", F.timestamp_seconds("ts"))


@pytest.fixture(scope="module")
def halves(spark):
    rows = [event(i, i % 4, i * 400, ip=f"ip{i % 3}", device_fp=f"d{i % 5}", country=f"c{i % 2}") for i in range(120)]
    log = events(spark, *rows)
    return log, [log.filter("event_id < 50"), log.filter("event_id >= 50 and event_id < 90"), log.filter("event_id >= 90")]


def test_hourly_equals_batch(spark, halves):
    log, parts = halves
    stream = hourly.hourly_activity(timed(feed(spark, *parts)))
    sink = new_folder(spark, "hourly")
    run_available(stream, parquet_step(sink), "hourly", "update")
    got = latest_per_key(spark, sink, stream.schema, ["user_id", "hour"])
    want = log.groupBy("user_id", (F.floor(F.col("ts") / 3600) * 3600).alias("hour")).agg(F.count("*").alias("events"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def result(spark, stream, **settings):
    return deltas.run_deltas(stream, new_folder(spark, "sink"), **settings)


def test_deltas_cross_batches(spark, halves):
    log, parts = halves
    got = result(spark, timed(feed(spark, *parts))).select("event_id", "delta", *seq.CHANGES, "late")
    want = seq.event_deltas(log).select("event_id", "delta", *seq.CHANGES, F.lit(False))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("slot", [500, 86400])
def test_out_of_order_files_equal_batch(spark, slot):
    """Every batch holds rows of all times, some of them twice; one account has most of the rows, some values are null."""
    rows = [event(i, 0 if i % 3 else i % 5, i * 211 % 4000, ip=f"ip{i % 3}", device_fp=None if i % 7 == 0 else f"d{i % 5}", country=f"c{i % 2}") for i in range(240)]
    log = events(spark, *rows)
    parts = [log.filter(F.col("event_id") * 7 % 4 == k) for k in (2, 0, 3, 1)]
    parts[1] = parts[1].union(parts[0].limit(5))
    got = result(spark, feed(spark, *parts), slot=slot).select("event_id", "delta", *seq.CHANGES, "late")
    want = seq.event_deltas(log).select("event_id", "delta", *seq.CHANGES, F.lit(False))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_events_behind_the_horizon_are_the_side_output(spark):
    day = 86400
    parts = [[event(1, 1, 9 * day)], [event(2, 1, 20 * day)], [event(3, 1, 5), event(4, 2, 7), event(2, 1, 20 * day)], [event(5, 1, 21 * day), event(1, 1, 9 * day)]]
    sink = new_folder(spark, "sink")
    got = deltas.run_deltas(feed(spark, *[events(spark, *p) for p in parts]), sink)
    assert {r.event_id: (r.delta, r.late) for r in got.collect()} == {1: (0, False), 2: (11 * day, False), 3: (0, True), 4: (0, False), 5: (day, False)}
    assert [r.event_id for r in deltas.late_events(spark.read.parquet(sink)).collect()] == [3]


def test_an_event_within_the_horizon_revises_the_one_after_it(spark):
    got = result(spark, feed(spark, events(spark, event(1, 1, 100), event(2, 1, 160)), events(spark, event(3, 1, 130))))
    assert {r.event_id: (r.delta, r.late) for r in got.collect()} == {1: (0, False), 3: (30, False), 2: (30, False)}


def test_idle_accounts_lose_their_state_after_a_time():
    asked = []

    class Handle:
        getValueState = lambda self, *a: asked.append(a[-1])
        getMapState = lambda self, *a: asked.append(a[-1])

    deltas.Gaps(idle=60).init(Handle())
    deltas.Gaps().init(Handle())
    assert asked == [60_000, 60_000, None, None]


class Kept(dict):
    """State of one account in memory, with the calls that the processor makes."""

    exists = lambda self: "v" in self
    get = lambda self: dict.get(self, "v")
    update = lambda self, v: self.__setitem__("v", v)
    getValue = lambda self, k: dict.get(self, k)
    updateValue = dict.__setitem__
    removeKey = lambda self, k: self.pop(k, None)


def test_a_busy_account_is_taken_piece_by_piece(monkeypatch):
    monkeypatch.setattr(deltas, "HELD_ROWS", 20)
    times = [k * 37 % 1009 for k in range(400)]
    frame = pd.DataFrame({"ts": times, "event_id": range(400), "ip": "a", "device_fp": "b", "country": None})
    p = deltas.Gaps(slot=50, horizon=300)
    p.edges, p.events = Kept(), Kept()
    found = pd.concat(p.handleInputRows((1,), iter([frame[k : k + 32] for k in range(0, 400, 32)]), None))
    last = found.sort_values("revision").groupby("event_id").last()
    order = sorted(zip(times, range(400)))
    assert all(last.delta[b[1]] == b[0] - a[0] for a, b in zip(order, order[1:])) and not found.late.any()
    assert len(p.events) <= 8 and len(p.edges.get()[1]) <= 9  # behind the horizon only the last event stays


class CountedState(Kept):
    """A map of state that counts its calls."""

    calls = 0

    def getValue(self, k):
        self.calls += 1
        return dict.get(self, k)

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v


def group_of(n_batches, users, times, **settings):
    """The rows of a group's processor after batches of pieces, its own state, and a frame of the last row of each event."""
    p = deltas.GroupGaps(**settings)
    p.few, p.edges, p.events = Kept(), CountedState(), CountedState()
    frame = pd.DataFrame({"user_id": users, "ts": times, "event_id": range(len(times)), "ip": "a", "device_fp": "b", "country": None})
    found = []
    for b in range(n_batches):
        rows = frame[b::n_batches]
        found += p.handleInputRows((0,), iter([rows[k : k + 32] for k in range(0, len(rows), 32)]), None)
    return p, pd.concat(found).sort_values("revision").groupby("event_id").last()


def gaps(users, times):
    before, out = {}, {}
    for t, k in sorted((t, k) for k, t in enumerate(times)):
        out[k] = t - before.get(users[k], t)
        before[users[k]] = t
    return out


def test_small_accounts_of_a_group_share_one_value():
    """Calls of the state store follow the groups, not the accounts and their slots."""
    times = [k * 37 % 1009 for k in range(600)]
    users = [str(k % 40) for k in range(600)]
    p, last = group_of(3, users, times, slot=50, horizon=3000)
    assert p.edges.calls == p.events.calls == 0 and list(p.few) == ["v"]
    assert last.delta.to_dict() == gaps(users, times) and not last.late.any()


@pytest.mark.parametrize("few, room", [(60, 10_000), (10_000, 150), (0, 0)])
def test_busy_accounts_leave_the_value_of_their_group(monkeypatch, few, room):
    monkeypatch.setattr(deltas, "FEW_ROWS", few)
    monkeypatch.setattr(deltas, "GROUP_ROWS", room)
    monkeypatch.setattr(deltas, "HELD_ROWS", 20)
    times = [k * 37 % 1009 for k in range(600)]
    users = ["hot" if k % 2 else str(k % 19) if k % 19 else None for k in range(600)]
    p, last = group_of(3, users, times, slot=50, horizon=3000)
    assert last.delta.to_dict() == gaps(users, times) and not last.late.any()
    busy, names, _, sizes, *columns = p.few.get()
    assert ("hot",) in p.edges and "hot" not in names and len(p.edges) == busy
    assert sum(sizes) == len(columns[0]) <= room and all(n <= few for n in sizes)


def test_small_accounts_forget_what_lies_behind_the_horizon():
    times = [0, 60, 5000, 5010, 4, 4990]
    p, last = group_of(2, ["u"] * 6, times, slot=50, horizon=300)  # batches: 0, 5000, 4 and 60, 5010, 4990
    assert last.late.tolist() == [False, True, False, False, False, False] and last.delta.tolist() == [0, 0, 10, 10, 4, 4986]
    assert p.few.get()[4] == [4, 4990, 5000, 5010]


def test_replay_out_of_order_is_written_by_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    files = set()
    step = lambda batch, number: files.update((number, r[0]) for r in batch.select(F.input_file_name()).distinct().collect())
    run_available(replay(spark.range(10_000), 3), step, "copy")
    assert len(files) == 3 * cores and {n for n, _ in files} == {0, 1, 2}


def test_accounts_with_text_ids_and_an_empty_batch(spark):
    log = events(spark, event(1, 1, 0), event(2, 1, 50)).withColumn("user_id", F.lit("u"))
    got = result(spark, feed(spark, log, log.limit(0)))
    assert sorted((r.user_id, r.event_id, r.delta) for r in got.collect()) == [("u", 1, 0), ("u", 2, 50)]


def test_replay_in_order_and_out_of_order(spark):
    rows = spark.range(100).withColumn("ts", F.col("id") * 7 % 50)
    for order in (None, "ts"):
        sink = new_folder(spark, "copy")
        run_available(replay(rows, 3, order), parquet_step(sink), "copy")
        got = spark.read.parquet(sink)
        assert got.count() == 100 and got.select("id").distinct().count() == 100
        spans = [(r.lo, r.hi) for r in got.groupBy("batch").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("batch").collect()]
        assert order is None or (len(spans) == 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])))


def test_late_event_does_not_move_the_surprise_state_back(spark):
    model = spark.createDataFrame([("gap", 0, 0, 0, 1, 1, 0.5)], "head string, gap int, content int, next int, n long, total long, p double")
    columns = "user_id long, event_id long, ts long, content int"
    parts = [[(1, 1, 100_000, 0), (1, 2, 100_200, 0)], [(1, 3, 50, 0), (1, 2, 100_200, 0)], [(1, 4, 100_300, 0)]]
    def run(batches):
        sink = new_folder(spark, "surprise")
        stream = feed(spark, *[spark.createDataFrame(b, columns) for b in batches])
        run_available(surprise.online_surprise(stream, model), parquet_step(sink), "surprise")
        return {r.event_id: (r.surprise, r.late) for r in spark.read.parquet(sink).collect()}
    got, clean = run(parts), run([parts[0], parts[2]])
    assert got[4] == clean[4] and got[3] == (None, True) and got[2] == clean[2] and set(got) == {2, 3, 4}


def test_campaign_counts(spark, halves):
    log, parts = halves
    text = (F.col("event_id") % 6).alias("text_id")
    prompts = spark.createDataFrame([(0,), (3,)], "text_id long")
    stream = campaigns.campaign_hits(feed(spark, *parts).select("user_id", text), prompts)
    sink = new_folder(spark, "hits")
    run_available(stream, parquet_step(sink), "hits", "update")
    got = latest_per_key(spark, sink, stream.schema, ["user_id"])
    want = log.filter("event_id % 6 in (0, 3)").groupBy("user_id").agg(F.count("*").alias("n"))
    want = want.select("user_id", "n", F.col("n") >= 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_online_surprise_equals_batch(spark, halves):
    log, parts = halves
    content = (F.col("event_id") * 7 % 5).cast("int").alias("content")
    encoded = seq.event_encoding(seq.event_history(log.select("*", content)))
    steps = seq.transitions(encoded)
    model = seq.transition_model(steps, log.filter("user_id < 2").select("user_id").distinct())
    want = seq.event_surprise(steps, model).orderBy("user_id", "pos").collect()
    stream = feed(spark, *parts).select("user_id", "event_id", "ts", content)
    sink = new_folder(spark, "surprise")
    run_available(surprise.online_surprise(stream, seq.transition_table(model)), parquet_step(sink), "surprise")
    got = spark.read.schema(surprise.output(T.LongType())).parquet(sink).orderBy("user_id", "ts", "event_id").collect()
    assert len(got) == len(want)
    assert all(abs(g.surprise - w.surprise) < 1e-9 for g, w in zip(got, want))
    mine = [g for g in got if g.user_id == 1]
    losses = [w.surprise for w in want if w.user_id == 1]
    assert all(g.rolling is None for g in mine[:15])
    assert all(abs(g.rolling - sum(losses[i - 15 : i + 1]) / 16) < 1e-9 for i, g in enumerate(mine) if i >= 15)


def test_a_replayed_log_is_made_once(spark):
    """Bounds and parts are read from a written copy, so costly columns are not made again for every part."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(400).withColumnRenamed("id", "ts").mapInArrow(counted, "ts long")
    stream = replay(rows, 3, "ts")
    assert stream.isStreaming and made.value == 400
