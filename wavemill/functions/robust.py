"""Vectorised robust decomposition and outlier test of many series at once (rows of a matrix padded with NaN).

Every step is either local to a window of samples or rests on sums and medians of a whole series, so that the
distributed form for long series (``operators/spikes.py``) gives the same result from its own sums and medians.
"""

from __future__ import annotations

import numpy as np

from wavemill.functions.distributions import esd_limit

#: Fixed value: the median absolute deviation times this estimates a normal standard deviation.
MAD_SCALE = 1.4826
#: The fit of the decomposition stays within so many scatters of the series' median.
FIT_SCATTERS = 3.0
#: Values beyond so many median absolute deviations have no weight.
CUT_OFF = 6.0


def row_median(sorted_rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of rows sorted with their NaN last, ``n`` values each."""
    r = np.arange(len(n))
    low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, sorted_rows.shape[1] - 1)
    return (sorted_rows[r, low] + sorted_rows[r, high]) / 2


def bisquare(distance: np.ndarray, mad: np.ndarray) -> np.ndarray:
    """Weights that fall from 1 at distance 0 to 0 at ``CUT_OFF`` deviations; 1 where the deviation is 0."""
    scale = np.where(mad > 0, CUT_OFF * mad, np.inf)
    return np.square(np.clip(1 - np.square(distance / scale), 0, 1))


def local_trend(y: np.ndarray, w: np.ndarray, window: int) -> np.ndarray:
    """Local linear regression at every value of the rows, with tricube times the given weights; 0 where no
    neighbour has any weight. Rows must be centred, values without weight finite."""
    half = window // 2
    at = np.arange(-half, half + 1)
    kernel = (1 - (np.abs(at) / (half + 1)) ** 3) ** 3
    wide = np.pad(w, ((0, 0), (half, half)))
    flat, value = wide.ravel(), np.pad(w * y, ((0, 0), (half, half))).ravel()

    def gathered(series: np.ndarray, taps: np.ndarray) -> np.ndarray:
        return np.correlate(series, taps, "same").reshape(wide.shape)[:, half : wide.shape[1] - half]

    s0, s1, s2 = (gathered(flat, kernel * at**k) for k in range(3))
    t0, t1 = (gathered(value, kernel * at**k) for k in range(2))
    det = s0 * s2 - s1 * s1
    line = det > 1e-6 * s0 * s2
    some = s0 > 1e-9
    out = np.where(line, (s2 * t0 - s1 * t1) / np.where(line, det, 1.0), t0 / np.where(some, s0, 1.0))
    return np.where(some, out, 0.0)


def _season(rest: np.ndarray, w: np.ndarray, phase: np.ndarray, period: int) -> np.ndarray:
    """The weighted mean of each phase, less the mean over the phases that have any weight, at every value."""
    m = len(rest)
    cell = (np.arange(m)[:, None] * period + phase).ravel()
    part = np.bincount(cell, (w * rest).ravel(), m * period)
    total = np.bincount(cell, w.ravel(), m * period)
    some = (total > 1e-9).reshape(m, period)
    mean = np.where(some, (part / np.where(total > 1e-9, total, 1.0)).reshape(m, period), 0.0)
    mean = np.where(some, mean - (mean.sum(1) / np.maximum(some.sum(1), 1))[:, None], 0.0)
    return np.take_along_axis(mean, phase, 1)


def decompose(x: np.ndarray, phase: np.ndarray, period: int, window: int, level: np.ndarray, mad: np.ndarray) -> np.ndarray:
    """Residuals of a robust seasonal-trend decomposition of rows with known medians and deviations.

    ``x``: rows padded with NaN; ``phase``: the season of each value. Trend: local regression; season: a weighted
    mean per phase. Two rounds; bisquare weights of the values and then also of the first residuals keep outliers
    out, and the fit stays within ``FIT_SCATTERS`` scatters of the median.
    """
    there = np.isfinite(x)
    n = there.sum(1)
    y = np.where(there, x - level[:, None], 0.0)
    w = there * bisquare(np.abs(y), mad[:, None])
    trend = local_trend(y, w, window)
    season = _season(y - trend, w, phase, period)
    rest = y - trend - season
    spread = row_median(np.sort(np.where(there, np.abs(rest), np.nan), 1), np.maximum(n, 1))
    w = w * bisquare(np.abs(rest), spread[:, None])
    trend = local_trend(y - season, w, window)
    season = _season(y - trend, w, phase, period)
    most = FIT_SCATTERS * MAD_SCALE * mad[:, None]
    return np.where(there, y - np.clip(trend + season, -most, most), np.nan)


def residual_scale(rest_mad: np.ndarray, mad: np.ndarray) -> np.ndarray:
    """The scatter of the residuals, at most that of the values, and over 0 where theirs is."""
    return MAD_SCALE * np.maximum(np.minimum(rest_mad, mad), 1e-9 * mad)


def extreme_deviates(rest: np.ndarray, mad: np.ndarray, alpha: float) -> np.ndarray:
    """Which values of each row the generalised ESD test calls outliers.

    The robust form of the test: distances from the residuals' centre 0 in units of their robust scatter, the
    greatest first, against the limits of Rosner's test; up to half of a row. All up to the last one above its
    limit are outliers. A row whose own deviation ``mad`` is 0 has none.
    """
    m, length = rest.shape
    n = np.isfinite(rest).sum(1)
    size = np.abs(rest)
    scale = residual_scale(row_median(np.sort(size, 1), np.maximum(n, 1)), mad)
    size = np.where(np.isfinite(rest) & (scale > 0)[:, None], size / np.where(scale > 0, scale, 1.0)[:, None], -1.0)
    least = np.array([esd_limit(int(k), int(k) // 2, alpha) if k >= 8 else np.inf for k in n])
    most = (size > least[:, None]).sum(1)
    marks = np.zeros(rest.shape, bool)
    rows = np.flatnonzero(most)
    if not len(rows):
        return marks
    top = -np.sort(-size[rows], 1)[:, : int(most[rows].max())]
    limit = np.full(top.shape, np.inf)
    for r, (k, c) in enumerate(zip(n[rows].tolist(), most[rows].tolist())):
        c = min(c, k // 2)
        limit[r, :c] = [esd_limit(k, i, alpha) for i in range(1, c + 1)]
    above = top > limit
    last = top.shape[1] - 1 - above[:, ::-1].argmax(1)
    cut = np.where(above.any(1), top[np.arange(len(rows)), last], np.inf)
    marks[rows] = size[rows] >= cut[:, None]
    return marks
