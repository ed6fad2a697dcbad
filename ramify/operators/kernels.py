"""Small numpy kernels that run inside Spark tasks on one bounded block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Leaves are factored in slabs whose dense blocks take about this many bytes.
SLAB_BYTES = 16 << 20


def dense_rows(column: pa.Array, n: int) -> np.ndarray:
    """A list column of equally long rows (or a scalar column) as an n-by-k array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(n, -1)


def list_column(rows: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as an Arrow list column."""
    n, k = rows.shape
    offsets = np.arange(0, (n + 1) * k, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed: the first bytes of all, then their second ones, and so on."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T)
    body = pa.compress(planes, "zstd", asbytes=True)
    return np.int64([len(numbers), len(body)]).tobytes() + body


def unsqueezed(packed: pa.Buffer, count: int) -> list[np.ndarray]:
    """The bits of ``count`` arrays of numbers that were ``squeezed`` one after another."""
    out, at = [], 0
    for _ in range(count):
        n, size = (int(x) for x in np.frombuffer(packed, np.int64, 2, at))
        planes = np.frombuffer(pa.decompress(packed.slice(at + 16, size), 8 * n, "zstd"), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel())
        at += 16 + size
    return out


def solve(a: np.ndarray, b: np.ndarray, where: object) -> np.ndarray:
    """LU solve of one system or a stack; a singular system names its place in the tree."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError as err:
        raise ValueError(f"singular system at {where}") from err


def low_rank_block(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``u v' + diag(d)`` for one block or a stack of blocks."""
    k = u @ np.swapaxes(v, -1, -2)
    n = k.shape[-1]
    k[..., np.arange(n), np.arange(n)] += d
    return k


def coupling(vtu0: np.ndarray, vtu1: np.ndarray) -> np.ndarray:
    """``[[I, V1'u1], [V0'u0, I]]`` for one node or a stack; the two ranks may differ.

    ``vtu1`` is r0-by-r1 and ``vtu0`` is r1-by-r0, so the system is (r0 + r1) square.
    """
    r0, r1 = vtu1.shape[-2:]
    s = np.zeros((*vtu1.shape[:-2], r0 + r1, r0 + r1))
    s[..., np.arange(r0 + r1), np.arange(r0 + r1)] = 1.0
    s[..., :r0, r0:] = vtu1
    s[..., r0:, :r0] = vtu0
    return s


def sweep(grams: np.ndarray, nrhs: int, where: object) -> tuple[np.ndarray, np.ndarray]:
    """Merge neighbouring subtrees until one is left.

    ``grams`` stacks ``V' [d | u]`` of the subtrees in row order; the first r rows
    belong to the tree's own V, further rows ride along.  Returns the merged gram
    and, per subtree, X with ``[d | u]_merged = [d | u] - u X`` on its rows.
    """
    r = grams.shape[2] - nrhs
    steps = []
    while len(grams) > 1:
        half = len(grams) // 2
        g0, g1, rest = grams[0 : 2 * half : 2], grams[1 : 2 * half : 2], grams[2 * half :]
        rhs = np.concatenate([g1[:, :r], g0[:, :r]], axis=1)
        eta = solve(coupling(g0[:, :r, nrhs:], g1[:, :r, nrhs:]), rhs, where)
        steps.append((eta[:, :r], eta[:, r:], len(rest)))
        merged = g0 - g0[:, :, nrhs:] @ eta[:, :r] + g1 - g1[:, :, nrhs:] @ eta[:, r:]
        grams = np.concatenate([merged, rest])
    x = np.zeros((1, r, grams.shape[2]))
    for eta0, eta1, odd in reversed(steps):
        parent = x[: len(eta0)]
        both = [e + parent - e[:, :, nrhs:] @ parent for e in (eta0, eta1)]
        x = np.concatenate([np.stack(both, axis=1).reshape(-1, *parent.shape[1:]), x[len(eta0) :]])
        assert len(x) == 2 * len(eta0) + odd
    return grams[0], x


def solve_part(u, v, d, b, leaf: int, where: object) -> tuple[np.ndarray, np.ndarray]:
    """``A^-1 [b | u]`` and its gram with ``v`` for the rows of one part.

    The rows are cut into leaves of at most ``leaf`` rows.  A short last leaf is
    filled with unit rows, which stay uncoupled from everything else.
    """
    n, r, nrhs = len(u), u.shape[1], b.shape[1]
    count = -(-n // leaf)
    size = -(-n // count)
    fill = count * size - n
    if fill:
        u, v, b = (np.concatenate([m, np.zeros((fill, m.shape[1]))]) for m in (u, v, b))
        d = np.concatenate([d, np.ones(fill)])
    u, v, d = u.reshape(count, size, r), v.reshape(count, size, -1), d.reshape(count, size)
    w = np.concatenate([b.reshape(count, size, nrhs), u], axis=2)
    slab = max(1, SLAB_BYTES // (8 * size * size))
    for at in range(0, count, slab):
        s = slice(at, at + slab)
        w[s] = solve(low_rank_block(u[s], v[s, :, :r], d[s]), w[s], where)
    gram, x = sweep(np.swapaxes(v, 1, 2) @ w, nrhs, where)
    if count > 1:
        w = w - w[:, :, nrhs:] @ x
    return w.reshape(count * size, -1)[:n], gram


#: Columns of a panel of the factorization.
PANEL = 32


def lu_factor(a: np.ndarray, where: object) -> tuple[np.ndarray, np.ndarray]:
    """LU factors with row pivoting of a stack of square matrices: L below the diagonal, U on and above it.

    The second value is the order of the rows.  Panels are factored column by column, the rest follows by products.
    """
    a = np.array(a, np.float64)
    m, n, _ = a.shape
    order, each = np.tile(np.arange(n), (m, 1)), np.arange(m)
    for lo in range(0, n, PANEL):
        hi = min(lo + PANEL, n)
        for j in range(lo, hi):
            top = j + np.abs(a[:, j:, j]).argmax(1)
            a[each, j], a[each, top] = a[each, top], a[each, j]
            order[each, j], order[each, top] = order[each, top], order[each, j]
            pivot = a[:, j, j]
            if not (np.abs(pivot) > 0).all():
                raise ValueError(f"singular system at {where}")
            a[:, j + 1 :, j] /= pivot[:, None]
            a[:, j + 1 :, j + 1 : hi] -= a[:, j + 1 :, j, None] * a[:, j, None, j + 1 : hi]
        if hi < n:
            lower = np.tril(a[:, lo:hi, lo:hi], -1) + np.eye(hi - lo)
            a[:, lo:hi, hi:] = np.linalg.solve(lower, a[:, lo:hi, hi:])
            a[:, hi:, hi:] -= a[:, hi:, lo:hi] @ a[:, lo:hi, hi:]
    return a, order


def lu_solve(lu: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve with the factors of ``lu_factor`` for a stack of right-hand sides."""
    x = np.take_along_axis(b, order[:, :, None], 1)
    n = lu.shape[1]
    starts = range(0, n, PANEL)
    for lo in starts:
        hi = min(lo + PANEL, n)
        x[:, lo:hi] = np.linalg.solve(np.tril(lu[:, lo:hi, lo:hi], -1) + np.eye(hi - lo), x[:, lo:hi])
        x[:, hi:] -= lu[:, hi:, lo:hi] @ x[:, lo:hi]
    for lo in reversed(starts):
        hi = min(lo + PANEL, n)
        x[:, lo:hi] = np.linalg.solve(np.triu(lu[:, lo:hi, lo:hi]), x[:, lo:hi])
        x[:, :lo] -= lu[:, :lo, lo:hi] @ x[:, lo:hi]
    return x


#: How far entries of L, and those of U beside the largest one, may lie from what ``lu_expanded`` makes of generators.
GENERATED = 1e-14


def lu_generators(u: np.ndarray, v: np.ndarray, d: np.ndarray, lu: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factors ``lu`` of a stack of ``u v' + diag(d)`` as 4 r + 1 numbers a row, and where these give them back.

    Without row exchanges L is ``u a'`` below the diagonal and U is ``b v'`` above it: u, v, a, b and the pivots are kept.
    """
    m, n, r = u.shape
    left, a, b, pivots = np.tile(np.eye(r), (m, 1, 1)), np.empty((m, n, r)), np.empty((m, n, r)), np.empty((m, n))
    with np.errstate(all="ignore"):
        for j in range(n):
            column = (left @ v[:, j, :, None])[:, :, 0]
            b[:, j] = (u[:, j, None, :] @ left)[:, 0]
            pivots[:, j] = d[:, j] + (u[:, j] * column).sum(1)
            a[:, j] = column / pivots[:, j, None]
            left = left - a[:, j, :, None] * b[:, j, None, :]
        kept = np.concatenate([np.swapaxes(x, 1, 2) for x in (u, v, a, b)] + [pivots[:, None]], axis=1)
        off = np.abs(lu_expanded(kept) - lu)
        below = np.tril(np.ones((n, n), bool), -1)
        scale = np.where(below, 1.0, np.abs(lu).max((1, 2))[:, None, None])
        good = (off <= GENERATED * scale).all((1, 2)) & (order == np.arange(n)).all(1)
    return kept, good


def lu_expanded(kept: np.ndarray) -> np.ndarray:
    """Dense LU factors out of a stack of generators."""
    r, n = kept.shape[1] // 4, kept.shape[2]
    u, v, a, b = (kept[:, k * r : (k + 1) * r] for k in range(4))
    lu = np.tril(np.swapaxes(u, 1, 2) @ a, -1) + np.triu(np.swapaxes(b, 1, 2) @ v, 1)
    lu[:, np.arange(n), np.arange(n)] = kept[:, -1]
    return lu


def factor_sweep(grams: np.ndarray, where: object) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """The steps of merging neighbouring subtrees with grams ``V'u``, and the merged gram.

    A step has, for each pair, the factors of its coupling system, the two grams, and the solution for u.
    """
    r, steps = grams.shape[2], []
    while len(grams) > 1:
        half = len(grams) // 2
        g0, g1, rest = grams[0 : 2 * half : 2], grams[1 : 2 * half : 2], grams[2 * half :]
        lu, order = lu_factor(coupling(g0, g1), where)
        eta = lu_solve(lu, order, np.concatenate([g1, g0], axis=1))
        steps.append((lu, order, g0, g1, eta))
        grams = np.concatenate([g0 - g0 @ eta[:, :r] + g1 - g1 @ eta[:, r:], rest])
    return steps, grams[0]


def replay_sweep(steps: list[tuple[np.ndarray, ...]], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``sweep`` does to right-hand sides alone: merged ``V'd``, and for each subtree its coefficients of u."""
    r, passed = sums.shape[1], []
    for lu, order, g0, g1, eta_u in steps:
        half = len(g0)
        d0, d1, rest = sums[0 : 2 * half : 2], sums[1 : 2 * half : 2], sums[2 * half :]
        eta = lu_solve(lu, order, np.concatenate([d1, d0], axis=1))
        passed.append((eta, eta_u))
        sums = np.concatenate([d0 - g0 @ eta[:, :r] + d1 - g1 @ eta[:, r:], rest])
    x = np.zeros((1, *sums.shape[1:]))
    for eta, eta_u in reversed(passed):
        parent = x[: len(eta)]
        both = [eta[:, s] + parent - eta_u[:, s] @ parent for s in (slice(0, r), slice(r, 2 * r))]
        x = np.concatenate([np.stack(both, axis=1).reshape(-1, *parent.shape[1:]), x[len(eta) :]])
    return sums[0], x


#: Fixed values of the 48-bit linear congruential generator (the rand48 family).
LCG_MULTIPLIER = 0x5DEECE66D
LCG_INCREMENT = 0xB
LCG_SEED_LOW = 0x330E
LCG_MASK = (1 << 48) - 1


def lcg_states(seed: int, skip: int, count: int) -> np.ndarray:
    """States ``skip+1 .. skip+count`` of the generator, as unsigned 64-bit integers.

    2**48 divides 2**64, so wrapping products are exact after masking.  The jump
    over ``skip`` draws costs log(skip), which lets tasks start anywhere.
    """
    mult, inc, n = 1, 0, skip
    step_mult, step_inc = LCG_MULTIPLIER, LCG_INCREMENT
    while n:
        if n & 1:
            mult, inc = mult * step_mult & LCG_MASK, (inc * step_mult + step_inc) & LCG_MASK
        step_mult, step_inc = step_mult * step_mult & LCG_MASK, (step_mult + 1) * step_inc & LCG_MASK
        n >>= 1
    start = (mult * (((seed & 0xFFFFFFFF) << 16) + LCG_SEED_LOW) + inc) & LCG_MASK
    powers = np.full(count + 1, LCG_MULTIPLIER, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(powers[:-1])])
    states = powers * np.uint64(start) + sums * np.uint64(LCG_INCREMENT)
    return states[1:] & np.uint64(LCG_MASK)


def uniform_many(seeds: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` draws in [0, 1) of each seed, a row per seed."""
    low = np.asarray(seeds, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    start = (low << np.uint64(16)) + np.uint64(LCG_SEED_LOW)
    powers = np.full(count + 1, LCG_MULTIPLIER, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.accumulate(powers[:-1])
    states = powers[1:] * start[:, None] + sums * np.uint64(LCG_INCREMENT)
    return (states & np.uint64(LCG_MASK)) / float(1 << 48)


def uniform(seed: int, skip: int, count: int) -> np.ndarray:
    """Uniform draws in [0, 1)."""
    return lcg_states(seed, skip, count) / float(1 << 48)
