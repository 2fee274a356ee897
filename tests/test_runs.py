"""Stores of runs: what is committed counts, what isn't is written again, and the records are the same."""

import numpy as np
import pytest

from terrafield.operators import diagnostics, sampler
from terrafield.sources.runs import Progress, RunStore, durable_run


def _data(n=30):
    rng = np.random.default_rng(1)
    xy = rng.random((n, 2))
    parents = np.full((n, 5), -1, np.int64)
    parents[:, 0] = np.arange(n)
    for i in range(1, n):
        near = np.argsort(((xy[:i] - xy[i]) ** 2).sum(1))[:4]
        parents[i, 1 : len(near) + 1] = near
    one = np.ones((n, 1))
    return sampler.Data(xy, parents, np.arange(n), rng.normal(size=n), one, one, [0], one, one, one)


def _rows(store):
    return sorted(map(tuple, store.records().collect()))


class _Stopped(RuntimeError):
    pass


@pytest.mark.parametrize("at", ["before the write", "after the write", "before the rename"])
def test_a_stopped_run_gives_the_same_records(spark, tmp_path, at):
    d, whole = _data(), RunStore(spark, str(tmp_path / "whole"))
    done = durable_run(spark, d, whole, 2, 6, every=2)
    assert done.done == 6 and [c[0] for c in done.checkpoints] == [2, 4, 6] and sorted(done.states) == [1, 2]
    want = sorted(row for c in (1, 2) for row in _blocks(d, c))
    assert [r[:5] for r in _rows(whole)] == [r[:5] for r in want] and np.allclose([r[5] for r in _rows(whole)], [r[5] for r in want])

    class Failing(RunStore):
        def write_block(self, block, rows):
            if block == 1 and at == "before the write":
                raise _Stopped
            super().write_block(block, rows)
            if block == 1 and at == "after the write":
                raise _Stopped

        def commit(self, block, done, minutes):
            if block == 1:
                fs, new = self._fs(f"{self.path}/commits/{block}.new")
                fs.create(new, True).close()  # half a file
                raise _Stopped
            super().commit(block, done, minutes)

    path = str(tmp_path / "part")
    with pytest.raises(_Stopped):
        durable_run(spark, d, Failing(spark, path), 2, 6, every=2)
    part = RunStore(spark, path)
    assert part.progress().done == 2 and {r[1] for r in _rows(part)} == {1, 2}  # what isn't committed doesn't count
    assert durable_run(spark, d, part, 2, 6, every=2).done == 6
    assert _rows(part) == _rows(whole)


def _blocks(d, chain):
    state, out = None, []
    for start in (0, 2, 4):
        state, rows = sampler.run_chain(d, chain, 2, seed=1, start=start, state=state)
        out += rows
    return out


def test_reading_a_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    assert store.progress() == Progress() and store.records().count() == 0
    durable_run(spark, _data(), store, 2, 5, every=3, with_field=False)
    assert {r.param for r in store.records().select("param").distinct().collect()} == {"beta", "range_beta", "scale_beta", "noise_beta"}
    beta = store.records("beta")
    assert beta.count() == 10 and "PartitionFilters: [isnotnull(param" in beta._jdf.queryExecution().executedPlan().toString()
    assert {r.iteration for r in store.records(thinning=0.5).collect()} == {2, 4}
    assert diagnostics.ess(store.records()).count() == 4
    with pytest.raises(RuntimeError, match="already"):
        store.commit(0, 3, 0.0)
