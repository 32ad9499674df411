"""Wave detection over whole series, natively.

One shuffle brings each series (of a unit, a metric) together as arrays of its days; all
that follows are column expressions over these arrays: average, moving threshold, regions
above it merged over short gaps, cuts at deep and lasting valleys, onset, peak, trimming and
significance. Several presets share one average. Rows of one day stay side by side;
null values count as 0 in averages and as no peak value; a series with too few days, or
without any positive average, has no waves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.arrays import at, centred, last, let, lets, longest_run, loose, part, peaks, places, rolling_quantile, runs, smoothed, spaced, total, variance, where_largest


@dataclass(frozen=True)
class Preset:
    window: int = 42
    percentile: float = 10
    smooth: int = 21
    rel: float = 0.30
    floor: float = 2.0
    min_days: int = 14
    gap: int = 35
    split: float = 0.60
    significance: float = 2.5
    lookback: int = 28
    height: float = 0.13
    spread: float = 0.8
    merge: int = 28


#: Fixed values; the last three are those of detection by prominence.
PRESETS = {
    "conservative": Preset(56, 10, 28, 0.50, 3.0, 21, 56, 0.75, 3.5, 42, 0.22, 1.5, 45),
    "standard": Preset(),
    "sensitive": Preset(28, 15, 14, 0.15, 1.0, 7, 21, 0.45, 1.5, 14, 0.07, 0.4, 14),
}
#: Days in a row under the level that end a wave, and the level as a share of the peak's elevation.
QUIET, LEVEL = 5, 0.10
#: Smoothing windows, and the share of the variance that a wider one must take.
WINDOWS, SHARE = (3, 5, 7, 14), 0.15


def gathered(df: DataFrame, keys=("unit",)) -> DataFrame:
    """A row for each series: its days d, raw values, values x without gaps, how many are known, and their total."""
    days = F.sort_array(F.collect_list(F.struct("date", F.when(~F.isnan("value"), F.col("value").cast("double")).alias("v"))))
    out = df.groupBy(*keys).agg(days.alias("days"))
    raw = F.transform("days", lambda e: e["v"])
    return out.select(*keys, F.transform("days", lambda e: e["date"]).alias("d"), raw.alias("raw")).select(
        *keys, "d", "raw", F.transform("raw", lambda v: F.coalesce(v, F.lit(0.0))).alias("x"), F.size(F.filter("raw", lambda v: v.isNotNull())).alias("known"), F.aggregate("raw", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))).alias("total"),
    )


def best_window(x: Column) -> Column:
    """The widest smoothing window so far as each takes SHARE of the variance that the one before left."""
    def chain(*left: Column) -> Column:
        out = F.lit(WINDOWS[-1])
        for k in range(len(WINDOWS) - 1, 0, -1):
            out = F.when((left[k - 1] > 0) & ((left[k - 1] - left[k]) / left[k - 1] < SHARE), WINDOWS[k - 1]).otherwise(out)
        return out

    def of(x: Column) -> Column:
        few = F.size(F.filter(x, lambda v: v > 0)) < 2 * max(WINDOWS)
        return F.when(few, WINDOWS[0]).otherwise(lets(chain, *[variance(centred(x, F.lit(w))) for w in WINDOWS]))

    return let(F.transform(x, lambda v: F.greatest(v, F.lit(0.0))), of)


def _threshold(s: Column, p: Column) -> Column:
    """The baseline: a rolling low percentile, averaged, never negative, and to nine places, so that which of
    equally low days is the first does not hang on the order of a sum."""
    return let(rolling_quantile(s, F.floor(p["window"] / 2).cast("int"), p["percentile"]), lambda low: F.transform(centred(low, p["smooth"]), lambda v: F.round(F.greatest(v, F.lit(0.0)), 9)))


def _valley(e: Column, one: Column, two: Column, p: Column) -> Column:
    """The lowest place between two summits if it is deep and lasts; else null."""
    def of(seg: Column, lower: Column) -> Column:
        cut = (1 - p["split"]) * lower
        low = F.array_min(seg)
        lasts = longest_run(F.filter(F.transform(seg, lambda _, i: i), lambda i: at(seg, i) < cut)) >= F.greatest(p["min_days"], F.lit(10))
        return F.when((low < cut) & (lower - low >= 2 * p["floor"]) & lasts, one + (F.array_position(seg, low) - 1).cast("int"))

    return lets(of, part(e, one, two), F.least(at(e, one), at(e, two)))


def _split(s: Column, b: Column, r: Column, p: Column) -> Column:
    """A region cut behind the valleys between its summits; parts that are too short stay with the part before."""
    half = F.greatest(F.floor(p["min_days"] / 2).cast("int"), F.lit(3))
    length = r["z"] - r["a"] + 1

    def of(e: Column) -> Column:
        least = let(F.greatest(0.1 * F.array_max(e), 3 * p["floor"]), lambda v: F.filter(places(half, length - half - 1), lambda i: (at(e, i) > v) & (at(e, i) >= F.array_max(part(e, i - half, i + half)))))
        return let(spaced(least, p["min_days"]), lambda tops: let(F.transform(places(1, F.size(tops) - 1), lambda k: _valley(e, at(tops, k - 1), at(tops, k), p)), cut))

    def cut(valleys: Column) -> Column:
        heads = F.aggregate(valleys, F.array(F.lit(0)), lambda h, v: F.when(v.isNotNull() & (v - last(h) >= p["min_days"]), F.array_append(h, v + 1)).otherwise(h))
        kept = lambda h: F.when((F.size(h) > 1) & (length - last(h) < p["min_days"]), F.slice(h, 1, F.size(h) - 1)).otherwise(h)
        return let(let(heads, kept), lambda h: F.transform(h, lambda a, k: F.struct((r["a"] + a).alias("a"), (r["a"] + F.coalesce(at(h, k + 1), length) - 1).alias("z"))))

    e = F.transform(places(r["a"], r["z"]), lambda i: at(s, i) - at(b, i))
    return F.when(length > 2 * p["min_days"], let(e, of)).otherwise(F.array(r))


def _trimmed(s: Column, b: Column, start: Column, end: Column, peak: Column) -> list[Column]:
    """Where the part of a region between the quiet stretches nearest to its peak begins and ends."""
    low = F.array_min(part(b, start, end))
    level = low + LEVEL * (at(s, peak) - low)
    quiet = F.when(at(s, peak) > low, let(level, lambda v: F.filter(places(start, end), lambda i: at(s, i) < v))).otherwise(F.array().cast("array<int>"))
    span = QUIET - 1

    def of(q: Column) -> Column:
        before = F.filter(q, lambda i, k: (i < peak) & F.coalesce(at(q, k - span) == i - span, F.lit(False)))
        after = F.filter(q, lambda i, k: (i > peak) & F.coalesce(at(q, k + span) == i + span, F.lit(False)))
        return F.struct(F.coalesce(F.array_max(before) + 1, start).alias("first"), F.coalesce(F.array_min(after) - 1, end).alias("last"))

    return let(quiet, of)


def _candidates(x: Column, s: Column, p: Column) -> Column:
    """Every wave that a series may have: first, peak and last day, value and averaged value of the peak, whether it is significant."""
    def of(b: Column) -> Column:
        need = lambda i: at(b, i) * p["rel"] + p["floor"]
        above = F.filter(F.transform(s, lambda _, i: i), lambda i: at(s, i) > at(b, i) + need(i))
        whole = let(above, lambda f: F.filter(runs(f, p["gap"]), lambda r: r["z"] - r["a"] + 1 >= p["min_days"]))
        cut = F.flatten(F.transform(whole, lambda r: _split(s, b, r, p)))

        def wave(r: Column, before: Column) -> Column:
            onset = F.greatest(r["a"] - p["lookback"], F.lit(0))
            falls = F.filter(places(onset, r["a"] - 1), lambda j: at(s, j + 1) - at(s, j) <= 0)
            start = F.greatest(let(falls, lambda f: F.coalesce(last(f) + 1, onset)), before)
            summit = lambda a: let(a + where_largest(part(s, a, r["z"])), lambda k: let(_trimmed(s, b, a, r["z"], k), lambda t: F.struct(
                t["first"].alias("first"), k.alias("peak"), t["last"].alias("last"), F.when(at(x, k) > 0, at(x, k)).otherwise(at(s, k)).alias("value"), at(s, k).alias("averaged"), (at(s, k) - at(b, k) >= p["significance"] * need(k)).alias("kept"),
            )))
            return let(start, summit)

        return let(cut, lambda parts: F.transform(parts, lambda r, i: wave(r, F.coalesce(at(parts, i - 1)["z"] + 1, F.lit(0)))))

    return let(_threshold(s, p), of)


def profiled(df: DataFrame, presets=("standard",), ma: int | str | tuple = 7, keys=("unit",)) -> DataFrame:
    """gathered() with the average s and, for each preset, the candidates; a series that can have no waves has none.

    ma: days of the average, or "auto" for best_window() of each series; several of these
    give a row for each, with it as text in window.
    """
    out = gathered(df, keys)
    if isinstance(ma, tuple):
        out, keys = out.withColumn("window", F.explode(F.array(*[F.lit(str(m)) for m in ma]))), (*keys, "window")
        out = out.withColumn("ma", F.when(F.col("window") == "auto", best_window(F.col("x"))).otherwise(F.col("window").try_cast("int")))
    else:
        out = out.withColumn("ma", best_window(F.col("x")) if ma == "auto" else F.lit(ma))
    kinds = [F.struct(F.lit(k).alias("preset"), *[F.lit(v).alias(f) for f, v in vars(PRESETS[k]).items()]) for k in presets]
    out = out.select(*keys, "d", "raw", "x", "known", "total", "ma", smoothed(F.col("x"), F.col("ma")).alias("s"), F.explode(F.array(*kinds)).alias("p"))
    usable = (F.col("known") >= F.col("ma") + 2) & F.exists("s", lambda v: v != 0)
    return out.withColumn("found", F.when(usable, lets(lambda x, s: _candidates(x, s, F.col("p")), F.col("x"), loose(F.col("s")))))


def waves_of(profile: DataFrame, keys=("unit",), outer: bool = False) -> DataFrame:
    """The significant waves, a row each, numbered by series and preset; with outer also a row for a series without any."""
    day = lambda w, c: at(F.col("d"), w[c])
    kept = F.filter("found", lambda w: w["kept"])
    rows = profile.select(*keys, F.col("p.preset").alias("preset"), "d", "x", (F.posexplode_outer if outer else F.posexplode)(kept).alias("i", "w"))
    w = F.col("w")
    return rows.select(
        *keys, "preset", (F.col("i") + 1).cast("long").alias("wave_number"), day(w, "first").alias("start_date"), day(w, "peak").alias("peak_date"), day(w, "last").alias("end_date"), w["value"].alias("peak_value"),
        F.when(w.isNotNull(), F.greatest(F.date_diff(day(w, "last"), day(w, "first")), F.lit(1))).cast("long").alias("duration_days"), total(part(F.col("x"), w["first"], w["last"])).alias("wave_burden"),
    )


def prominent(df: DataFrame, prominence: float | str = 1000, merge: int = 0, ma: int = 7, preset: str = "standard") -> DataFrame:
    """Waves by prominence: each peak of the average with the nearest days under a tenth of it; peaks at most merge days apart are one.

    prominence "auto": what default_prominence() makes of the series and the preset.
    """
    out = gathered(df).withColumn("s", smoothed(F.col("x"), F.lit(ma)))
    least = default_prominence(F.col("x"), PRESETS[preset]) if prominence == "auto" else F.lit(float(prominence))
    out = out.where((F.col("known") >= ma + 2) & F.exists("s", lambda v: v != 0)).withColumn("least", least)

    def wave(k: Column, raw: Column, s: Column) -> Column:
        value = F.coalesce(at(raw, k), at(s, k))
        under = let(value, lambda v: F.filter(F.transform(raw, lambda _, i: i), lambda i: at(raw, i) < 0.1 * v))
        return let(under, lambda u: F.struct(
            F.coalesce(F.array_max(F.filter(u, lambda i: i < k)), k).alias("first"), k.alias("peak"), F.coalesce(F.array_min(F.filter(u, lambda i: i > k)), k).alias("last"), value.alias("value"), F.lit(True).alias("kept"),
        ))

    def joined(acc: Column, w: Column) -> Column:
        v = last(acc)
        one = F.when(w["value"] > v["value"], F.struct(v["first"].alias("first"), w["peak"].alias("peak"), w["last"].alias("last"), w["value"].alias("value"), F.lit(True).alias("kept")))
        one = one.otherwise(F.struct(v["first"].alias("first"), v["peak"].alias("peak"), F.greatest(v["last"], w["last"]).alias("last"), v["value"].alias("value"), F.lit(True).alias("kept")))
        close = (F.size(acc) > 0) & (w["peak"] - v["peak"] <= merge) & F.lit(merge > 0)
        return F.when(close, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), one)).otherwise(F.array_append(acc, w))

    each = lets(lambda raw, s: F.transform(peaks(s, F.col("least"), 1), lambda t: wave(t["place"], raw, s)), F.col("raw"), F.col("s"))
    empty = F.array().cast("array<struct<first:int,peak:int,last:int,value:double,kept:boolean>>")
    found = F.aggregate(each, empty, joined)
    return waves_of(out.select("unit", F.struct(F.lit(preset).alias("preset")).alias("p"), "d", "x", found.alias("found"))).drop("preset")


def default_prominence(x: Column, p: Preset) -> Column:
    """A share of the largest value or of the spread of positive ones, whichever is more, at least 1."""
    spread = let(F.filter(x, lambda v: v > 0), lambda up: F.when(F.size(up) > 0, F.sqrt(variance(up)) * p.spread).otherwise(F.lit(p.spread)))
    return F.greatest(F.coalesce(F.array_max(x), F.lit(0.0)) * p.height, spread, F.lit(1.0))
