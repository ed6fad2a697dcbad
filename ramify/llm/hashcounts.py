"""Counts of 64-bit hashes over all rows, sent packed by bucket.

A hash goes to the bucket of its first ``bits`` bits and is told by 32 more there; hashes that share
all of those are counted together, so a count is never too small.  A task sends each hash of a run
once, with its count, so a very common one is a row's worth a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Hashes of a bucket.
BUCKET_HASHES = 1 << 21
PACKED = "bucket long, codes binary, counts binary"
_MOST = 65535


def bucket_bits(total: int) -> int:
    """Bits of the bucket, for about ``total`` hashes."""
    return min(32, max(0, (total // BUCKET_HASHES).bit_length()))


def packed(hashes: np.ndarray, bits: int) -> list[pa.Array]:
    """``bucket``, ``codes`` and ``counts`` of some hashes."""
    code, count = np.unique(hashes >> np.uint64(32 - bits), return_counts=True)
    # a count too large for its field is sent in several
    over = count // _MOST
    if over.any():
        code, count = np.concatenate([code, np.repeat(code, over)]), np.concatenate([count - over * _MOST, np.full(over.sum(), _MOST)])
        by = np.argsort(code, kind="stable")
        code, count = code[by], count[by]
    bucket = (code >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(edges, len(bucket))[1:]
    low, count = code.astype(np.uint32), count.astype(np.uint16)
    parts = [[x[a:b].tobytes() for a, b in zip(edges, ends, strict=True)] for x in (low, count)]
    return [pa.array(bucket[edges]), *(pa.array(p, pa.binary()) for p in parts)]


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a bucket, sorted, and their counts."""
    codes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("codes")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("counts")])
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by].astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[begin], np.add.reduceat(counts, begin)
