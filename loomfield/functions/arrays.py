"""Column expressions over one series held as an array: averages, runs, peaks and matches as folds.

Places count from 0. Every fold walks one array, so its work is bounded by one unit's days.
Arrays that a lambda reads are bound by let(): a column that the optimizer replaces by its
definition would else be computed anew for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lets(body: Callable[..., Column], *values: Column) -> Column:
    """body of several values, each evaluated once."""
    if len(values) == 1:
        return let(values[0], lambda v: body(v))
    return let(values[0], lambda v: lets(lambda *rest: body(v, *rest), *values[1:]))


def loose(a: Column) -> Column:
    """The same array as objects: each slice of a column's binary form would convert the whole of it."""
    return F.transform(a, lambda v: v)


def at(a: Column, i) -> Column:
    """The element at a place; null beyond the ends."""
    return F.get(a, i)


def last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def part(a: Column, first: Column, end: Column) -> Column:
    """The elements from first to end, both included, as far as there are any."""
    first = F.greatest(first, F.lit(0))
    return F.slice(a, first + 1, F.greatest(F.least(end, F.size(a) - 1) - first + 1, F.lit(0)))


def places(first, end) -> Column:
    """first to end, both included; empty if end comes before."""
    first, end = (F.lit(x) if isinstance(x, int) else x for x in (first, end))
    return F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def where_largest(a: Column) -> Column:
    """The first place of the largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def variance(a: Column) -> Column:
    """Of the whole population."""
    around = lambda a, mean: F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(a)
    return let(a, lambda a: let(total(a) / F.size(a), lambda mean: around(a, mean)))


def centred(x: Column, window: Column) -> Column:
    """Zero-padded centred averages; an even window has one more day before."""
    after = F.floor((window - 1) / 2).cast("int")
    return let(loose(x), lambda x: F.transform(x, lambda _, i: total(part(x, i - window + 1 + after, i + after)) / window))


def smoothed(x: Column, window: Column) -> Column:
    """Centred averages, 0 within half a window of the ends."""
    edge = F.floor(window / 2).cast("int")
    return let(centred(x, window), lambda s: F.transform(s, lambda v, i: F.when((i < edge) | (i >= F.size(s) - edge), 0.0).otherwise(v)))


def quantile(a: Column, percent: Column) -> Column:
    """Of an array without nulls, interpolated between the two nearest elements."""
    def between(ordered: Column) -> Column:
        def of(place: Column) -> Column:
            low = F.floor(place).cast("int")
            return at(ordered, low) + (place - low) * (at(ordered, F.ceil(place).cast("int")) - at(ordered, low))

        return let(percent / 100 * (F.size(ordered) - 1), of)

    return let(F.sort_array(a), between)


def rolling_quantile(x: Column, half: Column, percent: Column) -> Column:
    """Over half a window on either side, cut at the ends."""
    return let(loose(x), lambda x: F.transform(x, lambda _, i: quantile(part(x, i - half, i + half), percent)))


def runs(flagged: Column, gap) -> Column:
    """Stretches (a, z) of ascending places of which neighbours are at most gap apart."""
    def of(flagged: Column) -> Column:
        first = F.filter(flagged, lambda v, i: (i == 0) | (v - at(flagged, i - 1) > gap))
        end = F.filter(flagged, lambda v, i: (i == F.size(flagged) - 1) | (at(flagged, i + 1) - v > gap))
        return F.zip_with(first, end, lambda a, z: F.struct(a.alias("a"), z.alias("z")))

    return let(flagged, of)


def longest_run(flagged: Column) -> Column:
    """The length of the longest stretch of neighbouring places; 0 without any."""
    return F.coalesce(F.array_max(F.transform(runs(flagged, 1), lambda r: r["z"] - r["a"] + 1)), F.lit(0))


def spaced(found: Column, distance: Column) -> Column:
    """The first of ascending places, and each next one at least so far behind the one kept before."""
    return F.aggregate(found, F.array().cast("array<int>"), lambda kept, i: F.when((F.size(kept) == 0) | (i >= last(kept) + distance), F.array_append(kept, i)).otherwise(kept))


def _lowest_within(turns: Column) -> Column:
    """For each turn the lowest value since the last higher one: a stack of ever lower values, each with that low."""
    def step(acc: Column, e: Column) -> Column:
        low = F.least(e["v"], F.array_min(F.transform(F.filter(acc["stack"], lambda t: t["v"] <= e["v"]), lambda t: t["low"])))
        return let(low, lambda m: F.struct(
            F.array_append(F.filter(acc["stack"], lambda t: t["v"] > e["v"]), F.struct(e["v"].alias("v"), m.alias("low"))).alias("stack"), F.array_append(acc["lows"], m).alias("lows"),
        ))

    start = F.struct(F.array().cast("array<struct<v:double,low:double>>").alias("stack"), F.array().cast("array<double>").alias("lows"))
    return F.aggregate(turns, start, step, lambda acc: acc["lows"])


def peaks(x: Column, prominence, distance) -> Column:
    """Peaks (place, value, rise) of an array without nulls, in order.

    A peak is a maximum, of a plateau its middle, never at an edge. Of those nearer than
    distance the highest stays, of equal ones the last; then the prominence decides.
    """
    prominence, distance = (F.lit(v) if isinstance(v, (int, float)) else v for v in (prominence, distance))
    return let(loose(x), lambda x: _peaks(x, prominence, distance))


def _peaks(x: Column, prominence: Column, distance: Column) -> Column:
    def of(first: Column) -> Column:
        level = lambda r: at(x, at(first, r))
        end = lambda r: F.coalesce(at(first, r + 1), F.size(x)) - 1
        n = F.size(first)
        side = lambda r, s: F.signum(level(r) - level(r + s))  # noqa: E731  null beyond the edges
        turn = lambda r: (r == 0) | (r == n - 1) | (side(r, -1) == side(r, 1))
        turns = F.transform(F.filter(F.transform(first, lambda _, r: r), turn), lambda r: F.struct(
            F.floor((at(first, r) + end(r)) / 2).cast("int").alias("place"), level(r).alias("v"), ((r > 0) & (r < n - 1) & (side(r, -1) > 0)).alias("top"),
        ))
        return let(turns, risen)

    def risen(turns: Column) -> Column:
        found = lambda left, right: F.filter(F.transform(turns, lambda t, i: F.struct(t["place"].alias("place"), t["v"].alias("value"), (t["v"] - F.greatest(at(left, i), at(right, i))).alias("rise"), t["top"].alias("top"))), lambda t: t["top"])
        return lets(lambda left, right: let(found(left, right), chosen), _lowest_within(turns), F.reverse(_lowest_within(F.reverse(turns))))

    def chosen(tops: Column) -> Column:
        order = F.sort_array(F.transform(tops, lambda t: F.struct(t["value"], t["place"])), asc=False)
        kept = F.aggregate(order, F.array().cast("array<int>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.abs(k - t["place"]) < distance), kept).otherwise(F.array_append(kept, t["place"])))
        near = lambda t, held: (distance <= 1) | F.array_contains(held, t["place"])
        return let(F.when(distance > 1, kept), lambda held: F.filter(tops, lambda t: near(t, held) & (t["rise"] >= prominence)))

    first = F.filter(F.transform(x, lambda _, i: i), lambda i: (i == 0) | (at(x, i) != at(x, i - 1)))
    return F.when(F.size(x) >= 3, let(first, of)).otherwise(F.array().cast("array<struct<place:int,value:double,rise:double,top:boolean>>"))


def matched(events: Column, max_lag: int) -> Column:
    """Pairs of a case and the nearest later death not taken yet, in order of cases, within max_lag days.

    events: (date, side, value) in order, side 0 a case and 1 a death. Cases wait in a queue;
    a death goes to the first one that still may take it.
    """
    def step(acc: Column, e: Column) -> Column:
        waiting = F.filter(acc["waiting"], lambda c: F.date_diff(e["date"], c["date"]) <= max_lag)
        pair = lambda c: F.struct(c["date"].alias("case_peak_date"), e["date"].alias("death_peak_date"), F.date_diff(e["date"], c["date"]).cast("long").alias("lag_days"), c["value"].alias("case_peak_value"), e["value"].alias("death_peak_value"))
        case = F.struct(e["date"].alias("date"), e["value"].alias("value"))
        return let(waiting, lambda queue: F.when(e["side"] == 0, F.struct(F.array_append(queue, case).alias("waiting"), acc["found"].alias("found"))).otherwise(
            F.struct(F.slice(queue, 2, F.greatest(F.size(queue) - 1, F.lit(0))).alias("waiting"), F.when(F.size(queue) > 0, F.array_append(acc["found"], pair(at(queue, 0)))).otherwise(acc["found"]).alias("found")),
        ))

    start = F.struct(F.array().cast("array<struct<date:date,value:double>>").alias("waiting"), F.array().cast("array<struct<case_peak_date:date,death_peak_date:date,lag_days:bigint,case_peak_value:double,death_peak_value:double>>").alias("found"))
    return F.aggregate(events, start, step, lambda acc: acc["found"])
