"""Samples of frames: the same values as ranking every cell, from rows that were thinned out first."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest

from workload import inputs

SAMPLES = {
    "frame_samples": [(f"{kind}_{scenario}", c) for kind, scenario, c in inputs.LABELLED],
    "framed_samples": [(header, c) for _, _, header, c in inputs.FRAMES],
}


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Frames of many keys and of few, with missing values, keys that repeat with other values, and rows without a key."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("frames")
    keys = [*range(0, 60), *range(100, 103), *[110] * 7, *range(150, 175), *range(150, 160), *[None] * 40]
    maybe = lambda value: None if rng.random() < 0.4 else value
    day = datetime.datetime(1998, 2, 6)
    rows = [(k, maybe(rng.randrange(99)), maybe(rng.choice("OFP")), 10.0, day, maybe(rng.choice(["1-URGENT", "2-HIGH", "5-LOW"]))) for k in keys]
    # A frame of which only the last rows by hash hold a status.
    late = sorted(range(200, 225), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    rows += [(k, 1, "F" if i >= 22 else None, 10.0, day, None) for i, k in enumerate(late)]
    schema = "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SAMPLES)
def test_samples_are_the_lowest_cells(spark, orders, name):
    cells = {}
    for r in inputs.unlabelled(spark, orders).collect():
        frame = None if r.row_key is None else int(r.row_key) // inputs.FRAME_ROWS
        digest = "" if r.row_key is None else hashlib.md5(r.row_key.encode()).hexdigest()
        for label, c in SAMPLES[name]:
            if r[c] is not None:
                cells.setdefault((frame, label), []).append((digest, r[c]))
    wanted = [(*of, value, n) for of, found in cells.items() for n, (_, value) in enumerate(sorted(found)[: inputs.FRAME_SAMPLE], 1)]
    sample = getattr(inputs, name)(spark, orders)
    assert sample.columns == ["position", "column", "value", "rn"]
    assert sorted(map(tuple, sample.collect()), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("name", SAMPLES)
def test_rows_are_thinned_out_before_they_become_cells(spark, orders, name):
    """The rows of a table are sorted once as rows; only a few of a frame are multiplied into cells."""
    plan = getattr(inputs, name)(spark, orders)._jdf.queryExecution().sparkPlan().toString()
    above, below = plan.split("Generate inline", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below and "Generate" not in below
