"""What a task holds does not grow with the table."""

import numpy as np
import pyarrow as pa

from ramify.operators import blocks
from ramify.plans import tree


def test_a_part_is_eight_megabytes():
    for leaf, width in ((32, 10), (64, 18), (125, 130), (400, 102)):
        assert tree.default_part_rows(leaf, width) * width * 8 <= max(8 << 20, leaf * width * 8)


def test_wide_blocks_leave_in_pieces(monkeypatch):
    n, width = 10, 50
    data = [np.full(4, float(k)) for k in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([4 * k for k in range(n)]), pa.array([4] * n, pa.int32()), blocks._ragged(data)],
        ["part", "row0", "nrow", "data"],
    )
    widened = blocks._per_block(lambda nrow, part, x: np.repeat(x[:, None], width, 1), "data")
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3 * 4 * width * 8)
    out = list(widened(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in out] == [3, 3, 3, 1]
    found = pa.Table.from_batches(out)
    assert found.column("part").to_pylist() == list(range(n)) and found.column("row0").to_pylist() == [4 * k for k in range(n)]
    assert [set(x) for x in found.column("data").to_pylist()] == [{float(k)} for k in range(n)]
