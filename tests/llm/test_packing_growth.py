"""Packing stays tight when a task has many more pieces than open bins."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from meterflow.llm import packing  # noqa: E402


@pytest.mark.parametrize("kind", ["uniform", "two sizes"])
def test_many_pieces_over_half_the_capacity_stay_tight(spark, kind):
    n, rng = 200_000, np.random.default_rng(4)
    sizes = rng.integers(1, 2049, n) if kind == "uniform" else np.where(rng.random(n) < 0.5, 1300, 740)
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(sizes.tolist())], "doc_id long, piece int, length long")
    out = packing.pack(df).toPandas()
    assert len(out) == n and out["doc_id"].nunique() == n
    out = out.sort_values(["sequence_id", "offset"])
    ends = out.groupby("sequence_id")["length"].cumsum()
    assert (out["offset"] == ends - out["length"]).all() and ends.max() <= packing.CAPACITY
    least = max(sizes.sum() / packing.CAPACITY, (sizes > packing.CAPACITY // 2).sum())
    assert out["sequence_id"].nunique() <= 1.02 * least


def test_lots_do_not_depend_on_batches():
    import pyarrow as pa

    rows = pa.record_batch({"x": list(range(25))})
    for cuts in ([25], [3] * 9, [0, 10, 0, 15]):
        batches, at = [], 0
        for c in cuts:
            batches.append(rows.slice(at, c))
            at += c
        assert [b.column("x").to_pylist() for b in packing.lots(batches, 10)] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert list(packing.lots([], 10)) == []
