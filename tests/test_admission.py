"""Sliding-window admission: summaries against replays, the job against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest

from quillmark.operators import admission as ad

START = dt.datetime(2024, 3, 1)
SHAPES = {
    "dense": lambda rng, n: np.sort(rng.integers(0, 40, n)),
    "even": lambda rng, n: np.arange(n) * int(rng.integers(1, 12)),
    "sparse": lambda rng, n: np.cumsum(rng.choice([0, 1, 3, 9, 10, 11, 25], n)),
    "bursts": lambda rng, n: np.sort(rng.integers(0, max(2, n // 9), n) * 7),
}


def plain(times, limit, window):
    seen, out = [], []
    for t in times:
        seen = [x for x in seen if x >= t - window]
        out.append(len(seen) < limit)
        seen += [t] * out[-1]
    return out


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_summaries_lead_where_replays_do(shape, limit):
    rng, window = np.random.default_rng(limit), 10
    for _ in range(150):
        times = SHAPES[shape](rng, int(rng.integers(2, 120))).astype(np.int64)
        admitted, _ = ad.replay(times, limit, window, np.zeros(0, np.int64))
        assert admitted.tolist() == plain(times.tolist(), limit, window)
        cuts = np.sort(rng.choice(len(times) + 1, int(rng.integers(1, 7))))
        parts = [p for p in np.split(times, cuts) if len(p)]
        per = int(rng.integers(1, 4))
        groups = [parts[i : i + per] for i in range(0, len(parts), per)]
        entering = np.full((limit, 1), ad.NEVER)
        state, before = np.zeros(0, np.int64), 0
        for group in groups:
            own = [ad.Summary.read(*ad.Summary.of(p, limit, window).row()) for p in group]
            whole = own[0]
            for one in own[1:]:
                whole = whole.then(one, limit, window)
            count, leaving = whole.passed(entering, limit, window, limit)
            within = entering
            for one in own:
                within = one.passed(within, limit, window, limit)[1]
            got, state = ad.replay(np.concatenate(group), limit, window, state)
            assert int(count[0]) == got.sum()
            alive = lambda s: [t for t in np.sort(s).tolist() if t >= group[-1][-1] - window]
            assert alive(leaving[:, 0]) == alive(within[:, 0]) == alive(state), (times, cuts)
            entering, before = leaving, before + len(got)


@pytest.mark.parametrize("chunk,limit", [(1, 2), (4, 1), (16, 3), (1 << 16, 2)])
def test_the_job_whatever_the_chunks(spark, chunk, limit):
    rng = random.Random(chunk)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None, ""]), START + dt.timedelta(seconds=rng.randint(0, 400))) for i in range(400)]
    rows += [(400 + i, f"k{i}", START) for i in range(30)] + [(900, "hot", None)]
    d = spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(7)
    want = {900: False}
    for key in {r[1] for r in rows}:
        some = sorted((r[2], r[0]) for r in rows if r[1] == key and r[2])
        want |= zip((i for _, i in some), plain([(t - START).total_seconds() for t, _ in some], limit, 60))
    got = ad.sliding_window(d, limit, chunk=chunk).collect()
    assert len(got) == len(rows) and {r["id"]: r["admitted"] for r in got} == want
    assert ad.sliding_window(d.limit(0), limit).count() == 0
    assert all(r["admitted"] for r in ad.sliding_window(d, 0).collect())


def test_a_hot_key_runs_in_many_tasks(spark):
    """The chunks of one key are grouped by (key, chunk) at every step that reads events."""
    d = spark.range(6000).selectExpr("id", "'hot' AS key", "timestamp_seconds(id * 7) AS ts")
    got = {r["id"]: r["admitted"] for r in ad.sliding_window(d, 2, chunk=128).collect()}
    assert [got[i] for i in range(6000)] == plain([7 * i for i in range(6000)], 2, 60)
