import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import commits, state
from sparkloom.streaming.commits import Committed
from sparkloom.violations import ContractError


def in_steps(spark, rows, schema, folder):
    """A stream that gets rows, in lists, one list a micro-batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/src/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{folder}/src")


def finished(spark, df, folder, mode="append"):
    """All that a stream gives, batch after batch, and its last progress."""
    out = []
    with state.with_state_store(spark):
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return out, q.lastProgress


SCRAPES = "host string, counter string, at timestamp, n double"


def scrapes(spark, rows):
    return [[(h, c, spark.sql(f"select timestamp_seconds({t})").first()[0] if t is not None else None, n) for h, c, t, n in part] for part in rows]


def test_counter_deltas(spark, tmp_path):
    """Steps, resets, late and replayed scrapes, in one batch or over several."""
    parts = [
        [("a", "x", 10, 5.0), ("a", "x", 30, 9.0), ("a", "x", 20, 7.0), ("b", "x", 10, 1.0), (None, "x", 10, 1.0)],
        [("a", "x", 25, 8.0), ("a", "x", 40, 2.0), ("b", "x", 10, 1.0), ("a", "y", 5, 3.0), ("a", "x", None, 3.0), ("a", "x", 99, None)],
        [("a", "x", 50, 6.0), ("b", "x", 60, 1.5), (None, "x", 20, 4.0)],
    ]
    stream = in_steps(spark, scrapes(spark, parts), SCRAPES, tmp_path)
    out, _ = finished(spark, state.counter_deltas(stream, "host", "counter", "at", "n"), tmp_path)
    t0 = spark.sql("select timestamp_seconds(0)").first()[0]
    got = sorted((str(r.host), r.counter, int((r["at"] - t0).total_seconds()), r.delta, r.kind) for r in out)
    assert got == sorted([
        ("a", "x", 10, None, "first"), ("a", "x", 20, 2.0, "step"), ("a", "x", 30, 2.0, "step"), ("a", "x", 25, None, "late"), ("a", "x", 40, 2.0, "reset"), ("a", "x", 50, 4.0, "step"),
        ("b", "x", 10, None, "first"), ("b", "x", 10, None, "late"), ("b", "x", 60, 0.5, "step"), ("a", "y", 5, None, "first"), ("None", "x", 10, None, "first"), ("None", "x", 20, 3.0, "step"),
    ], key=lambda r: r)


def test_a_hot_counter_is_not_held_whole(monkeypatch, spark, tmp_path):
    """Runs in a file, merged; what comes out comes in bounded batches, and no number stays no number."""
    rng = random.Random(3)
    rows = [(rng.randint(0, 300), float(rng.randint(0, 9))) for _ in range(900)] + [(7, float("nan"))]
    frames = [pd.DataFrame(rows[i : i + 40], columns=["at", "value"]) for i in range(0, len(rows), 40)]
    monkeypatch.setattr(state, "RUN", 100)
    monkeypatch.setattr(state, "ROWS", 16)
    parts = list(state._in_order(iter(frames)))
    assert max(map(len, parts)) == 16 and [repr(x) for p in parts for x in p.tolist()] == [repr(x) for x in sorted(rows, key=lambda r: (r[0], r[1] != r[1], r[1]))]

    class One:
        """The state and timers of one key."""

        def __init__(self):
            self.held = None

        getValueState = lambda self, *_: self
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, x: setattr(self, "held", x)
        listTimers = lambda self: ()
        registerTimer = lambda self, at: None

    one, got, last = state._Deltas(1000), [], None
    one.init(One())
    for half in (frames[:15], frames[15:]):
        for out in one.handleInputRows(("s", "c"), iter(half), None):
            assert len(out) <= 16
            got += [(a, k, None if pd.isna(d) and k != "step" else d) for a, k, d in zip(out["at"], out["kind"], out["delta"], strict=True)]
    want = []
    for half in (rows[:600], rows[600:]):
        for at, v in sorted(half, key=lambda r: (r[0], r[1] != r[1], r[1])):
            if last is not None and at <= last[0]:
                want.append((at, "late", None))
                continue
            want.append((at, "first", None) if last is None else (at, "reset", v) if v < last[1] else (at, "step", v - last[1]))
            last = (at, v)
    assert got == want


LEDGER = "id string, seq long, status string, at timestamp"


def test_error_ledger_forgets(spark, tmp_path):
    """State is held for the ids of the last hour only; an old error does not open what was resolved."""
    parts = [[(f"i{k}-{j}", 1, "error", 3600 * k + j + 1) for j in range(20)] for k in range(8)]
    parts[1] += [("i0-1", 3, "resolved", 3605)]
    parts[2] += [("i0-1", 2, "error", 7200), (None, 1, "error", 1), ("i0-2", None, "error", 1)]
    rows = [[(i, s, st, spark.sql(f"select timestamp_seconds({t})").first()[0]) for i, s, st, t in part] for part in parts]
    stream = in_steps(spark, rows, LEDGER, tmp_path)
    out, progress = finished(spark, state.error_ledger(stream, "id", "seq", "status", "at", keep=5400), tmp_path, "update")
    one = [(r.seq, r.status) for r in out if r.id == "i0-1"]
    assert one[:2] == [(1, "error"), (3, "resolved")] and (2, "error") not in one and one[-1] == (3, "resolved (expired)")
    assert sum(r.status == "error" for r in out) == 160 and sum(r.status == "error (expired)" for r in out) >= 80
    held = progress.stateOperators[0].numRowsTotal if hasattr(progress, "stateOperators") else progress["stateOperators"][0]["numRowsTotal"]
    assert held < 3 * 60  # of 160 ids, those that are not forgotten, and their timers


def test_commits(spark, tmp_path):
    t = Committed(spark, f"file://{tmp_path}/t")
    with pytest.raises(ContractError):
        t.read()
    assert t.claim("one") == 1
    df = spark.range(10).withColumn("x", F.lit("a"))
    assert t.append(df, 0) and not t.append(df, 0) and t.append(df.limit(3), 1)
    assert t.batches() == [0, 1] and t.read().count() == 13 and sorted(r.rows for r in t.manifests().collect()) == [3, 10]
    t.verify()
    assert t.append(df.limit(0), 2) and t.read().count() == 13
    # a batch that breaks is not seen, and neither is what it wrote
    broken = df.withColumn("y", F.raise_error(F.lit("no")).cast("string")).drop("x")
    with pytest.raises(Exception, match="no"):
        t.append(broken, 3)
    assert t.batches() == [0, 1, 2] and t.read().count() == 13 and t.sweep() >= 1 and t.read().count() == 13


def test_racing_writers(spark, tmp_path):
    """Of two writers of one batch one wins; an older epoch can commit no more."""
    a, b = Committed(spark, f"file://{tmp_path}/t"), Committed(spark, f"file://{tmp_path}/t")
    a.claim("a")
    put = a._shown
    a._shown = lambda staged, target: (b.append(spark.range(5), 0) if target == "batch=0" and not b.batches() else None, put(staged, target))[1]
    assert a.append(spark.range(9), 0) is False and a.read().count() == 5
    assert b.claim("b") == 2 and b.append(spark.range(2), 1)
    with pytest.raises(ContractError, match="epoch 2"):
        a.append(spark.range(1), 2)
    assert b.batches() == [0, 1] and b.read().count() == 7


def test_committed_stream(spark, tmp_path):
    stream = in_steps(spark, [[(i,)] * (i + 1) for i in range(4)], "i long", tmp_path)
    for _ in range(2):  # the second run has nothing to do
        commits.committed_stream(stream, f"file://{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    t = Committed(spark, f"file://{tmp_path}/t")
    assert t.read().count() == 10 and len(t.batches()) == 4
    # the checkpoint is lost: all batches are replayed, none is there twice
    commits.committed_stream(stream, f"file://{tmp_path}/t", f"{tmp_path}/cp2").awaitTermination()
    assert t.read().count() == 10


def test_deltas_equal_lag(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"h{rng.randint(0, 5)}", "x", 10 * i + 10, float(rng.randint(0, 50))) for i in range(200)]
    stream = in_steps(spark, scrapes(spark, [rows[i : i + 50] for i in range(0, 200, 50)]), SCRAPES, tmp_path)
    out, _ = finished(spark, state.counter_deltas(stream, "host", "counter", "at", "n"), tmp_path)
    last, want = {}, []
    for h, _, _, n in rows:
        want.append((h, n, None if h not in last else n if n < last[h] else n - last[h]))
        last[h] = n
    assert sorted(map(repr, want)) == sorted(repr((r.host, r.n, r.delta)) for r in out)
