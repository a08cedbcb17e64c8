"""Stream steps hold what can still count, not a key's whole micro-batch; each against a plain replay."""

import numpy as np
import pandas as pd
import pytest

from quillstone.operators.overtime import digest_step
from quillstone.streaming import events as st
from quillstone.streaming import workers


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_pieces_equal_gaps_of_all(seed):
    r = np.random.default_rng(seed)
    times = r.integers(0, 3000, 400)
    starts, ends = st.runs((pd.Series(p) for p in np.array_split(times, 7)), 5)
    whole = np.sort(times)
    cut = np.flatnonzero(np.diff(whole) > 5)
    assert starts.tolist() == [whole[0], *whole[cut + 1]] and ends.tolist() == [*whole[cut], whole[-1]]
    assert len(st.runs(iter([]), 5)[0]) == 0


def steps(monkeypatch, module, call):
    """The step function that an operator hands to applyInPandasWithState."""
    found = []

    class Frame:
        def __getattr__(self, name):
            if name == "applyInPandasWithState":
                return lambda f, *a: found.append(f)
            return lambda *a, **k: self

    call(Frame())
    return found[0]


class State:
    exists, hasTimedOut = False, False

    def update(self, x):
        self.exists, self.get = True, x


def replayed_guard(rows):
    out, minute, passed, pending = {}, -1, 0, 0
    for m, n, free in rows:
        if free:
            out[n] = (True, 0)
            continue
        if m != minute:
            minute, passed = m, 0
        ok = passed < 5
        out[n] = (ok, pending if ok else 0)
        passed, pending = (passed + 1, 0) if ok else (passed, pending + 1)
    return out, (minute, passed, pending)


@pytest.mark.parametrize("seed", range(6))
def test_guard_tells_rows_before_the_batch_ends(monkeypatch, seed):
    r, step, state = np.random.default_rng(seed), steps(monkeypatch, st, st.guard), State()
    carry, want, got = [], {}, {}
    for batch in range(3):  # minutes go on from batch to batch
        rows = [(int(m) + batch * 4, batch * 1000 + i, bool(i % 13 == 0)) for i, m in enumerate(r.integers(0, 6, 300))]
        carry += sorted(rows)
        frames = [pd.DataFrame(rows[k : k + 50], columns=["minute", "seq", "immune"]) for k in range(0, 300, 50)]
        parts = list(step(("s",), iter(frames), state))
        assert len(parts) > 1 and len(parts[-1]) <= 5 * 6  # what is held: five a minute
        for p in parts:
            got |= {a: (b, c) for a, b, c in zip(p["seq"].tolist(), p["allowed"].tolist(), p["carried"].tolist(), strict=True)}
    want, end = replayed_guard(carry)
    assert got == want and state.get == end


@pytest.mark.parametrize("seed", range(6))
def test_digests_hold_two_ticks_a_second(monkeypatch, seed):
    monkeypatch.setattr(workers, "digest_ticks", lambda t, zone: t)
    monkeypatch.setattr(workers.F, "col", lambda c: 0)
    r, step, state = np.random.default_rng(seed), steps(monkeypatch, workers, lambda f: workers.digests(f, "UTC")), State()
    rows = [(n, f"2024-01-{1 + t // 86400:02d}", t // 3600 % 24, t, ["sent", "spooled", "crash"][n % 3], bool(r.integers(0, 4) == 0)) for n, t in enumerate((r.integers(0, 5 * 24, 3000) * 3600 + r.integers(0, 50, 3000)).tolist()) if t // 3600 % 24 >= 10]
    held, want = {}, []
    for n, day, hour, now, outcome, flushed in sorted(rows, key=lambda x: (x[3], x[0])):
        if action := digest_step(held, day, hour, now, outcome, flushed):
            want.append((n, day, action))
    f = pd.DataFrame([("h", *x) for x in rows], columns=["host", "seq", "day", "hour", "now", "outcome", "flushed"])
    got = [p for k in range(0, len(f), 500) for p in [f.iloc[k : k + 500]]]
    out = pd.concat(step(("h",), iter(got), state))
    assert list(out[["seq", "day", "action"]].itertuples(index=False, name=None)) == want
    twice = pd.concat([f] * 3)
    assert len(workers.first_ticks(twice.drop(columns="host"))) <= 2 * f["now"].nunique()


class Timed(State):
    watermark, timeout = -1, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, ms):
        assert ms > self.watermark
        self.timeout = ms


def test_index_worker_takes_many_keys_in_a_call(monkeypatch):
    """A call costs milliseconds, so keys share groups; each fails, waits and dies as if alone."""
    grouped = []
    for name in ("col", "lit", "xxhash64", "pmod", "unix_timestamp"):
        monkeypatch.setattr(workers.F, name, lambda *a: type("C", (), {"alias": lambda self, n: n})())

    class Frame:
        def __getattr__(self, name):
            if name == "groupBy":
                return lambda *c: grouped.append(c) or self
            if name == "applyInPandasWithState":
                return lambda f, *a: f
            return lambda *a, **k: self

    step, state = workers.index_worker(Frame()), Timed()
    assert grouped == [("shard",)]
    columns = ["shard", "key", "seq", "at", "ok", "error", "ts"]
    rows = [(0, k, n, 100 + n, ok, f"e{n}", None) for k, n, ok in [("a", 5, False), ("b", 1, False), ("a", 2, False), (None, 3, False), ("b", 4, True), ("a", 7, False), ("c", 8, True)]]
    told = lambda parts: [tuple(r) for p in parts for r in p[["key", "seq", "retries", "action"]].itertuples(index=False)]
    got = told(step((0,), iter([pd.DataFrame(rows[:3], columns=columns), pd.DataFrame(rows[3:], columns=columns)]), state))
    assert got == [("b", 1, 1, "retry"), ("a", 2, 1, "retry"), ("a", 5, 2, "retry"), ("a", 7, 3, "dead")]
    assert state.get == ('[[null, 1, 3, 104]]',) and state.timeout == 104_000  # keys without failures hold nothing
    state.watermark, state.hasTimedOut = 105_000, True
    assert told(step((0,), iter([]), state)) == [(None, 3, 1, "retry")] and state.get == ('[[null, 1, 3, -1]]',)
