"""Batches of texts are taken in slices, in order and whole."""

import pyarrow as pa
from heatgrid.llm.common import ROWS_AT_ONCE, portions


def test_batches_are_sliced_in_order():
    batches = [pa.RecordBatch.from_pydict({"text": pa.array([f"{b}-{i}" for i in range(n)], pa.string())}) for b, n in enumerate((0, 1, ROWS_AT_ONCE, 10_000))]
    got = list(portions(iter(batches)))
    assert max(len(x) for x in got) <= ROWS_AT_ONCE
    assert [t for x in got for t in x.column(0).to_pylist()] == [t for x in batches for t in x.column(0).to_pylist()]
