"""Column builders: keys, rates, intervals and statistics that are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "00000"
PER = 100_000.0


def pad_fips(c: Column, width: int = 5) -> Column:
    """A key as text of at least width digits; what can't be read as a number is all zeros."""
    s = F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)).cast("long").cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def location(name: Column, state: Column) -> Column:
    return F.concat_ws(", ", name, state)


def split_location(loc: Column) -> tuple[Column, Column]:
    """Name and state, cut at the last ", "; no state where there is none."""
    has = loc.contains(", ")
    return F.when(has, F.regexp_extract(loc, r"^(.*), (.*)$", 1)).otherwise(loc), F.when(has, F.regexp_extract(loc, r"^(.*), (.*)$", 2))


def number(c: Column) -> Column:
    """A number or null, never NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def rate(count: Column, population: Column, per: float = PER) -> Column:
    """count per people; missing where the population is missing or not positive."""
    return F.when(population > 0, count / population * per)


def cfr(deaths: Column, cases: Column) -> Column:
    return F.when(cases > 0, deaths / cases * 100)


def county_type(population: Column, threshold: float = 100_000) -> Column:
    return F.when(population >= threshold, "Urban").otherwise("Rural")


def rucc_type(code: Column) -> Column:
    return F.when(code.between(1, 3), "Metro").when(code.between(4, 9), "Nonmetro")


def poisson_ci(count: Column, population: Column, per: float = PER, z: float = 1.959964) -> tuple[Column, Column]:
    """Byar's interval of a rate; null for invalid input, lower end 0 for no events."""
    ok = (population > 0) & (count >= 0)
    k = F.when(ok, count)
    low = F.when(k == 0, 0.0).when(k > 0, k * F.pow(1 - 1 / (9 * F.greatest(k, F.lit(1e-9))) - z / (3 * F.sqrt(F.greatest(k, F.lit(1e-9)))), 3))
    high = (k + 1) * F.pow(1 - 1 / (9 * (k + 1)) + z / (3 * F.sqrt(k + 1)), 3)
    low = F.when(low < 0, 0.0).otherwise(low)
    return low / population * per, high / population * per


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def fisher_ci(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    ok = (n > 3) & (F.abs(r) < 1)
    half = z / F.sqrt(F.when(n > 3, n - 3))
    return F.when(ok, F.tanh(F.atanh(F.when(ok, r)) - half)), F.when(ok, F.tanh(F.atanh(F.when(ok, r)) + half))


#: Where each scale begins to call a value strong and moderate (fixed values).
SCALES = {"association": (0.6, 0.3), "vaccination": (0.5, 0.3), "clustering": (0.4, 0.15), "fit": (0.5, 0.25)}


def strength(value: Column, scale: str = "association") -> Column:
    """strong, moderate or weak; null for null. Correlations count by size; the bounds of the vaccination scale must be exceeded, all others reached."""
    strong, moderate = SCALES[scale]
    size = F.abs(value) if scale in ("association", "vaccination") else value
    reaches = (lambda bound: size > bound) if scale == "vaccination" else (lambda bound: size >= bound)
    return F.when(reaches(strong), "strong").when(reaches(moderate), "moderate").when(value.isNotNull(), "weak")
