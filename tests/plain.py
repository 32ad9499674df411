"""Wave detection, peaks and matches of one series in plain numpy, day by day: what the native operators are held against."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from loomfield.operators import waves as wv
from loomfield.operators.detection import LEVEL, PRESETS, QUIET, Preset


def peak_places(x: np.ndarray, prominence: float, distance: int) -> list[tuple[int, float]]:
    """Places and prominences of peaks: maxima (the middle of a plateau, never an edge), the
    highest of those nearer than distance, of at least the prominence."""
    if len(x) < 3 or np.isnan(x).all():
        return []
    x = np.nan_to_num(x)
    first = np.flatnonzero(np.concatenate([[True], np.diff(x) != 0]))
    last = np.concatenate([first[1:], [len(x)]]) - 1
    level = x[first]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    places = (first[top] + last[top]) // 2
    keep = np.ones(len(places), bool)
    for i in np.argsort(x[places], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(places - places[i]) < distance
            near[i] = False
            keep[near] = False
    found = []
    for p in places[keep]:
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p], higher[higher > p]
        a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(x))
        rise = float(x[p] - max(x[a : p + 1].min(), x[p:b].min()))
        if rise >= prominence:
            found.append((int(p), rise))
    return found


def _centred(x: np.ndarray, window: int) -> np.ndarray:
    """Zero-padded centred average; an even window has one more day before."""
    return np.convolve(x, np.ones(window))[(window - 1) // 2 :][: len(x)] / window


def smoothed(x: np.ndarray, window: int) -> np.ndarray:
    """The centred average, edges zeroed."""
    s, edge = _centred(x, window), window // 2
    s[:edge] = s[max(len(s) - edge, 0) :] = 0
    return s


def baseline(s: np.ndarray, p: Preset) -> np.ndarray:
    """A low percentile over a window cut at the ends, averaged and never negative."""
    half, n = p.window // 2, len(s)
    low = np.empty(n)
    inner = range(half, n - half)
    if len(inner):
        low[half : n - half] = np.percentile(sliding_window_view(s, 2 * half + 1), p.percentile, axis=1)
    for i in (i for i in range(n) if i not in inner):
        low[i] = np.percentile(s[max(0, i - half) : i + half + 1], p.percentile)
    return np.round(np.maximum(_centred(low, p.smooth), 0), 9)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _summits(e: np.ndarray, p: Preset) -> list[int]:
    """Places that nothing nearby exceeds, well above the floor, each the least duration behind the one before."""
    half = max(p.min_days // 2, 3)
    middle = e[half : len(e) - half]
    high = np.flatnonzero((middle >= sliding_window_view(e, 2 * half + 1).max(axis=1)) & (middle > max(0.1 * e.max(), 3 * p.floor))) + half
    kept = high[:1].tolist()
    while len(later := high[high >= kept[-1] + p.min_days] if kept else high):
        kept.append(int(later[0]))
    return kept


def _valley(e: np.ndarray, p: Preset) -> int | None:
    """The lowest place between two summits, the ends of e, if it is deep and lasts; else none."""
    lower = min(e[0], e[-1])
    under = e < (1 - p.split) * lower
    lowest = int(np.argmin(e))
    lasts = max((z - a + 1 for a, z in _runs(under)), default=0) >= max(p.min_days, 10)
    return lowest if under[lowest] and lasts and lower - e[lowest] >= 2 * p.floor else None


def _split(s: np.ndarray, b: np.ndarray, start: int, end: int, p: Preset) -> list[tuple[int, int]]:
    """A region cut behind the valleys between its summits; parts that are too short stay with the part before."""
    e = (s - b)[start : end + 1]
    if len(e) <= 2 * p.min_days:
        return [(start, end)]
    tops = _summits(e, p)
    heads = [0]
    for one, two in zip(tops, tops[1:], strict=False):
        v = _valley(e[one : two + 1], p)
        if v is not None and one + v - heads[-1] >= p.min_days:
            heads.append(one + v + 1)
    if len(heads) > 1 and len(e) - heads[-1] < p.min_days:
        heads.pop()
    return [(start + a, start + z - 1) for a, z in zip(heads, [*heads[1:], len(e)], strict=True)]


def _trim(s: np.ndarray, b: np.ndarray, start: int, end: int, peak: int) -> tuple[int, int]:
    """The part of a region between the quiet stretches nearest to its peak.

    Quiet is QUIET days or more under LEVEL of the way from the region's lowest baseline to its peak.
    """
    low = b[start : end + 1].min()
    quiet = _runs(s[start : end + 1] < low + LEVEL * (s[peak] - low)) if s[peak] > low else []
    long = [(start + a, start + z) for a, z in quiet if z - a + 1 >= QUIET]
    return max((z + 1 for _, z in long if z < peak), default=start), min((a - 1 for a, _ in long if a > peak), default=end)


def _valid(values: np.ndarray, ma: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The series without gaps and its average; none for a series that is too short or all zero."""
    x = np.nan_to_num(np.asarray(values, float))
    if np.isfinite(np.asarray(values, float)).sum() < ma + 2:
        return None
    s = smoothed(x, ma)
    return (x, s) if s.any() else None


def candidates(values: np.ndarray, p: Preset = PRESETS["standard"], ma: int = 7) -> list[tuple[int, int, int, float, float, bool]]:
    """(start, peak, end, peak value, averaged peak, whether it is significant) of each wave that one daily series may have."""
    if (series := _valid(values, ma)) is None:
        return []
    x, s = series
    b = baseline(s, p)
    need = b * p.rel + p.floor
    merged: list[list[int]] = []
    for a, z in _runs(s > b + need):
        if merged and a - merged[-1][1] <= p.gap:
            merged[-1][1] = z
        else:
            merged.append([a, z])
    out, before = [], 0
    for a, z in [part for r in merged if r[1] - r[0] + 1 >= p.min_days for part in _split(s, b, *r, p)]:
        onset = max(a - p.lookback, 0)
        falls = np.flatnonzero(np.diff(s[onset : a + 1]) <= 0)
        start = max(onset + int(falls[-1]) + 1 if len(falls) else onset, before)
        before = z + 1
        peak = start + int(np.argmax(s[start : z + 1]))
        first, last = _trim(s, b, start, z, peak)
        out.append((first, peak, last, float(x[peak] if x[peak] > 0 else s[peak]), float(s[peak]), bool(s[peak] - b[peak] >= p.significance * need[peak])))
    return out


def find_waves(values: np.ndarray, p: Preset = PRESETS["standard"], ma: int = 7) -> list[tuple[int, int, int, float]]:
    """(start, peak, end, peak value) of each wave of one daily series."""
    return [w[:4] for w in candidates(values, p, ma) if w[5]]


def prominent_waves(values: np.ndarray, prominence: float = 1000, merge: int = 0, ma: int = 7) -> list[tuple[int, int, int, float]]:
    """Waves by prominence: each peak of the average with the nearest days under a tenth of it; peaks at most merge days apart are one."""
    if (series := _valid(values, ma)) is None:
        return []
    raw = np.asarray(values, float)
    waves: list[tuple[int, int, int, float]] = []
    for k, _ in peak_places(series[1], prominence, 1):
        value = float(series[1][k] if np.isnan(raw[k]) else raw[k])
        under = np.flatnonzero(raw < 0.1 * value)  # never a gap
        start, end = max(under[under < k], default=k), min(under[under > k], default=k)
        if waves and merge > 0 and k - waves[-1][1] <= merge:
            first, top, last, most = waves[-1]
            waves[-1] = (first, k, int(end), value) if value > most else (first, top, max(last, int(end)), most)
        else:
            waves.append((int(start), k, int(end), value))
    return waves


def default_prominence(values: np.ndarray, preset: str = "standard") -> float:
    x, p = np.asarray(values, float), PRESETS[preset]
    return float(max(x.max() * p.height, x[x > 0].std() * p.spread if (x > 0).any() else 1.0, 1.0))


def best_smoothing(values: np.ndarray, windows: tuple[int, ...] = (3, 5, 7, 14)) -> int:
    """The widest window so far as each takes 15 % of the variance that the one before left."""
    x = np.clip(np.nan_to_num(np.asarray(values, float)), 0, None)
    if (x > 0).sum() < 2 * max(windows):
        return windows[0]
    left = [float(np.var(_centred(x, w))) for w in windows]
    for k in range(1, len(windows)):
        if left[k - 1] > 0 and (left[k - 1] - left[k]) / left[k - 1] < 0.15:
            return windows[k - 1]
    return windows[-1]


def greedy(cases: list[int], deaths: list[int], max_lag: int) -> list[tuple[int, int]]:
    """Each case, in order, with the nearest later death not taken yet, within max_lag days."""
    found, later = [], sorted(deaths)
    for c in sorted(cases):
        later = [d for d in later if d >= c]
        if later and later[0] - c <= max_lag:
            found.append((c, later.pop(0)))
    return found


D = date(2020, 1, 1)


def frame(spark, series):
    """(unit, date, value) of series by unit; NaN is null."""
    return spark.createDataFrame([(u, D + timedelta(i), None if np.isnan(v) else float(v)) for u, x in series.items() for i, v in enumerate(x)], "unit string, date date, value double")


def native(spark, values, **how) -> list[tuple[int, int, int, float]]:
    """(start, peak, end, peak value) of the waves that the native operator finds in one series."""
    rows = wv.detect(frame(spark, {"u": values}), **how).orderBy("wave_number").collect()
    return [((r.start_date - D).days, (r.peak_date - D).days, (r.end_date - D).days, r.peak_value) for r in rows]
