"""Numpy kernels for vertical vibration: Butterworth sections, zero-phase filtering, one stretch of a drive's sensors."""

from __future__ import annotations

import math
from functools import cache

# Grid rate, bands (whole, body, wheel) and order of the band-pass, longest gap inside a run, seconds of a
# run's ends that count as its edge, cut-off of the gravity low pass.
RATE, BANDS, ORDER, GAP_S, EDGE_S, GRAVITY_HZ = 200.0, ((0.5, 15.0), (0.5, 5.0), (5.0, 15.0)), 4, 0.05, 1.0, 0.2
#: Samples that one step of the recurrence takes at once.
BLOCK = 256


@cache
def butterworth(order: int, low: float | None, high: float, rate: float) -> tuple[tuple[float, ...], ...]:
    """Second-order sections (b0, b1, b2, a1, a2) of a band-pass, or of a low-pass of even order where low is None.

    Analogue prototype, band transformation, bilinear transformation with the edges pre-warped.
    """
    import numpy as np

    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    proto = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low is None:
        poles, gain, ends = proto * warp(high), warp(high) ** order, (1.0, 2.0, 1.0)
    else:
        w1, w2 = warp(low), warp(high)
        half = proto * (w2 - w1) / 2
        root = np.sqrt(half**2 - w1 * w2 + 0j)
        poles, gain, ends = np.concatenate([half + root, half - root]), (w2 - w1) ** order, (1.0, 0.0, -1.0)
    digital = (2 * rate + poles) / (2 * rate - poles)
    k = gain * (1.0 if low is None else (2 * rate) ** order) / np.prod(2 * rate - poles).real
    up = digital[digital.imag > 0]
    out = [[*ends, -2 * p.real, abs(p) ** 2] for p in sorted(up, key=abs)]
    out[0][:3] = [c * k for c in out[0][:3]]
    return tuple(tuple(s) for s in out)


@cache
def _matrices(section: tuple[float, ...], n: int):
    """Of a section over n samples: outputs of inputs, outputs of a state, state of inputs, state of a state."""
    import numpy as np

    b0, b1, b2, a1, a2 = section
    step, into, at = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
    powers = [np.eye(2)]
    for _ in range(n):
        powers.append(step @ powers[-1])
    free = np.array([at @ p for p in powers[:n]])
    impulse = np.concatenate([[b0], [at @ powers[k] @ into for k in range(n - 1)]])
    i, j = np.indices((n, n))
    forced = np.where(i >= j, impulse[np.maximum(i - j, 0)], 0.0)
    return forced, free, np.array([powers[n - 1 - k] @ into for k in range(n)]), powers[n]


def section_filter(x, section: tuple[float, ...], steady: bool = True):
    """x through one section that starts in its steady state for x[0], or at rest. Blocks of samples are matrix
    products; only two numbers go from block to block."""
    import numpy as np

    b0, b1, b2, a1, a2 = section
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    state = np.array([gain - b0, b2 - a2 * gain]) * (x[0] if steady else 0.0)
    n = len(x) // BLOCK * BLOCK
    out = np.empty_like(x)
    forced, free, state_of, carry = _matrices(section, BLOCK)
    if n:
        rows = x[:n].reshape(-1, BLOCK)
        ends, starts = rows @ state_of, np.empty((len(rows), 2))
        for k, e in enumerate(ends):
            starts[k] = state
            state = carry @ state + e
        out[:n] = (rows @ forced.T + starts @ free.T).ravel()
    if len(x) > n:
        rest = np.concatenate([x[n:], np.zeros(BLOCK - len(x) + n)])
        out[n:] = (forced @ rest + free @ state)[: len(x) - n]
    return out


def zero_phase(x, sections: tuple[tuple[float, ...], ...], pad: int):
    """x forward and backward through all sections, its ends mirrored through their last points for `pad` samples."""
    import numpy as np

    x = np.asarray(x, dtype=float)
    pad = min(len(x) - 1, pad)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    for _ in range(2):
        for s in sections:
            y = section_filter(y, s)
        y = y[::-1]
    return y[pad : pad + len(x)] if pad > 0 else y


def band_pass_runs(x, run, band: tuple[float, float], rate: float = RATE, order: int = ORDER):
    """x band-passed within each run (number >= 0), NaN outside and in runs too short for the band."""
    import numpy as np

    sections = butterworth(order, *band, rate)
    least = max(3 * (2 * len(sections) + 1) * 2, int(2 * rate / band[0]))
    out = np.full(len(x), np.nan)
    for r in np.unique(run[run >= 0]):
        at = np.flatnonzero(run == r)
        if len(at) > least:
            out[at] = zero_phase(x[at] - x[at].mean(), sections, int(3 * rate / band[0]))
    return out


def runs(valid):
    """Numbers of the stretches of true, -1 elsewhere."""
    import numpy as np

    first = valid & ~np.concatenate([[False], valid[:-1]])
    return np.where(valid, np.cumsum(first) - 1, -1)


def stretch(acc, gravity, gyro, first: int, last: int, whole: tuple[bool, bool], rate: float = RATE, gap_s: float = GAP_S, edge_s: float = EDGE_S, bands=BANDS, order: int = ORDER):
    """Grid samples first..last-1 of a drive from the sensor rows around them: (vertical raw, one column per band,
    rotation, edge). acc, gravity and gyro are (n, 4) arrays of seconds and x, y, z in order of time, the last two may
    be empty. whole says whether the drive begins, and ends, within these samples: elsewhere the ends of what is given
    are no ends of the signal."""
    import numpy as np

    t, xyz = acc[:, 0], acc[:, 1:]
    if len(gravity) >= 10:
        g = np.column_stack([np.interp(t, gravity[:, 0], gravity[:, k]) for k in (1, 2, 3)])
    else:  # no gravity sensor: what is left of the acceleration below the cut-off
        low = butterworth(2, None, GRAVITY_HZ, float(1 / np.median(np.diff(t))))
        g = np.column_stack([zero_phase(xyz[:, k], low, 3 * 3) for k in range(3)])
    size = np.linalg.norm(g, axis=1, keepdims=True)
    g = g / np.where(size == 0, np.nan, size)
    raw = np.einsum("ij,ij->i", xyz, g)
    grid = np.arange(first, last) / rate
    j = np.searchsorted(t, grid)
    valid = (t[np.clip(j, 1, len(t) - 1)] - t[np.clip(j, 1, len(t) - 1) - 1]) <= gap_s
    valid &= (j > 0) | (whole[0] & (grid <= t[0])) | (grid == t[0])
    valid &= j < len(t)
    run, x = runs(valid), np.interp(grid, t, raw)
    edge, n = ~valid, int(edge_s * rate)
    for r in np.unique(run[run >= 0]):
        at = np.flatnonzero(run == r)
        if at[0] > 0 or whole[0]:
            edge[at[:n]] = True
        if at[-1] < len(grid) - 1 or whole[1]:
            edge[at[-n:]] = True
    columns = [band_pass_runs(x, run, b, rate, order) for b in bands]
    turn = np.full(len(grid), np.nan)
    if len(gyro) >= 10:
        w = np.column_stack([np.interp(grid, gyro[:, 0], gyro[:, k]) for k in (1, 2, 3)])
        up = np.column_stack([np.interp(grid, t, g[:, k]) for k in range(3)])
        up /= np.where((size := np.linalg.norm(up, axis=1, keepdims=True)) == 0, np.nan, size)
        flat = w - np.einsum("ij,ij->i", w, up)[:, None] * up
        turn = np.sqrt(sum(band_pass_runs(flat[:, k], run, bands[0], rate, order) ** 2 for k in range(3)))
    return x, columns, turn, edge
