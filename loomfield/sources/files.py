"""Readers and writers of panel files: wide CSV in and out, long CSV, fixed width, GeoJSON."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions.exprs import number, pad_fips

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
IDS = ("countyFIPS", "County Name", "State", "StateFIPS", "Location")


def date_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if _DAY.fullmatch(c))


def read_text_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, every column as text; casts follow where types are known."""
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def wide_to_long(wide: DataFrame, value: str) -> DataFrame:
    """fips, state, county_name, date and value of a table with a column for each day."""
    keys = wide.select(pad_fips(F.col("countyFIPS")).alias("fips"), F.col("State").alias("state"), F.trim("County Name").alias("county_name"), *[F.col(f"`{c}`").cast("string").alias(c) for c in date_columns(wide)])
    long = keys.unpivot(["fips", "state", "county_name"], date_columns(wide), "date", value)
    return long.select("fips", "state", "county_name", F.col("date").cast("date").alias("date"), number(F.col(value)).alias(value))


def long_to_wide(long: DataFrame, value: str, days: list[str]) -> DataFrame:
    """A column for each of the given days; for export."""
    return long.withColumn("day", F.date_format("date", "yyyy-MM-dd")).groupBy("fips", "state", "county_name").pivot("day", days).agg(F.first(value))


def read_panel(spark: SparkSession, cases: str, deaths: str, population: str) -> DataFrame:
    """The long panel of three wide files, joined by key and date."""
    c, d = wide_to_long(read_text_csv(spark, cases), "cases"), wide_to_long(read_text_csv(spark, deaths), "deaths")
    pop = read_text_csv(spark, population)
    column = next(x for x in pop.columns if x not in IDS)
    pop = pop.select(pad_fips(F.col("countyFIPS")).alias("fips"), F.col("State").alias("state"), number(F.col(column)).alias("population"))
    return c.join(d.drop("county_name"), ["fips", "state", "date"], "left").join(pop, ["fips", "state"], "left")


def read_fixed_width(spark: SparkSession, path: str, layout: dict[str, tuple[int, int]], encoding: str = "ISO-8859-1") -> DataFrame:
    """Columns by (start from 1, width), trimmed; blank is null."""
    # The text reader takes UTF-8 for granted; a CSV of one column does not, and is split among tasks.
    lines = spark.read.schema("value string").option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(path)
    return lines.select(*[F.nullif(F.trim(F.substring("value", a, n)), F.lit("")).alias(c) for c, (a, n) in layout.items()])


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """name, start (from 1), width, is_text and description of each variable of a layout file: @start name [$] width. /* description */."""
    text = spark.read.format("binaryFile").load(path).select(F.decode("content", "ISO-8859-1").alias("text"))
    # An entry is what stands between two @: words up to the comment, of which a $ may touch its neighbours.
    entry = text.select(F.explode(F.split("text", "@")).alias("e")).select(F.split("e", r"/\*", 2).alias("e")).where(F.size("e") == 2)
    words = F.split(F.trim(F.regexp_replace(F.get("e", F.lit(0)), r"\$", r" \$ ")), r"\s+")
    entry = entry.select(words.alias("w"), F.trim(F.get(F.split(F.get("e", F.lit(1)), r"\*/"), F.lit(0))).alias("description"))
    of = lambda k: F.element_at("w", k)
    entry = entry.where((F.size("w") >= 3) & of(1).rlike("^[0-9]+$") & of(-1).rlike(r"^[0-9]+\.$"))
    return entry.select(of(2).alias("name"), of(1).cast("int").alias("start"), F.rtrim(of(-1), F.lit(".")).cast("int").alias("width"), F.array_contains("w", "$").alias("is_text"), "description")


def layout_of(layout: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """What read_fixed_width() takes of some variables of a layout."""
    return {r["name"]: (r["start"], r["width"]) for r in layout.where(F.col("name").isin(names)).collect()}  # one row for each name


def read_features(spark: SparkSession, path: str, columns: dict[str, str], key: str, texts: tuple[str, ...] = (), encoding: str = "ISO-8859-1") -> DataFrame:
    """fips and the mapped columns of a wide CSV, numbers where they are not texts; columns that the file lacks are left out."""
    raw = read_text_csv(spark, path, encoding)
    kept = {new: old for old, new in columns.items() if old in raw.columns}
    return raw.select(pad_fips(F.col(f"`{key}`")).alias("fips"), *[(F.col(f"`{old}`") if new in texts else number(F.col(f"`{old}`"))).alias(new) for new, old in kept.items()])


def feature_table(base: DataFrame, *more: DataFrame) -> DataFrame:
    """base with the columns that it lacks of each further table by fips; a table that is None is left out. One row for each key."""
    for other in more:
        if other is not None:
            new = [c for c in other.columns if c not in base.columns]
            base = base.join(other.select("fips", *new).dropDuplicates(["fips"]), "fips", "left")
    return base


def read_vaccination(spark: SparkSession, path: str, columns: dict[str, str], date_format: str = "MM/dd/yyyy") -> DataFrame:
    """fips, date and the mapped percentages of a long CSV, each within 0 and 100; rows without a known date, or with a key that is not five characters long, are dropped."""
    raw = read_text_csv(spark, path)
    share = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)))
    out = raw.select(F.col("FIPS").alias("fips"), F.try_to_date("Date", date_format).alias("date"), *[share(number(F.col(f"`{old}`"))).alias(new) for old, new in columns.items() if old in raw.columns])
    return out.where(F.col("date").isNotNull() & (F.length("fips") == 5))


def optional(read, *args, **kw) -> DataFrame | None:
    """What a reader gives, or None for a source that is missing."""
    try:
        return read(*args, **kw)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def catalog(spark: SparkSession, entries: dict[str, tuple], df: DataFrame | None = None) -> DataFrame:
    """column, label, category, units, year, description of variables; of those only that df has, if given."""
    rows = [(c, *e) for c, e in entries.items() if df is None or c in df.columns]
    return spark.createDataFrame(rows, "column string, label string, category string, units string, year string, description string")


def state_view(rings: DataFrame, states: DataFrame, state: str) -> DataFrame:
    """One row: the box and the middle of a state's units, for zooming; nothing for an unknown state."""
    p = rings.join(F.broadcast(states.where(F.col("state") == state).select("fips").distinct()), "fips", "left_semi").select(F.explode("ring").alias("p"))
    x, y = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    box = p.agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north")).where("west is not null")
    return box.withColumns({"lon": (F.col("west") + F.col("east")) / 2, "lat": (F.col("south") + F.col("north")) / 2})


#: Latitude, longitude and zoom of each state's map (fixed values).
STATE_ZOOM = {
    "AL": (32.8, -86.8, 6), "AK": (64.0, -153.0, 3), "AZ": (33.7, -111.4, 6), "AR": (34.8, -92.4, 6), "CA": (37.0, -119.5, 5), "CO": (39.0, -105.5, 6), "CT": (41.6, -72.7, 8), "DE": (39.0, -75.5, 8),
    "FL": (27.7, -81.8, 6), "GA": (32.8, -83.6, 6), "HI": (21.1, -156.5, 5), "ID": (44.2, -114.0, 6), "IL": (40.0, -89.0, 6), "IN": (39.8, -86.2, 7), "IA": (42.0, -93.5, 6), "KS": (38.5, -97.5, 6),
    "KY": (37.7, -84.7, 6), "LA": (31.0, -91.5, 6), "ME": (45.3, -69.0, 7), "MD": (39.1, -76.8, 7), "MA": (42.2, -71.8, 7), "MI": (44.3, -85.4, 6), "MN": (46.0, -93.9, 6), "MS": (32.8, -89.7, 6),
    "MO": (38.5, -92.3, 6), "MT": (47.0, -110.0, 5), "NE": (41.5, -99.9, 6), "NV": (39.5, -116.9, 6), "NH": (43.5, -71.5, 8), "NJ": (40.0, -74.5, 8), "NM": (34.5, -106.6, 6), "NY": (43.0, -75.5, 6),
    "NC": (35.5, -79.8, 6), "ND": (47.5, -100.5, 6), "OH": (40.4, -82.9, 6), "OK": (35.5, -97.5, 6), "OR": (44.0, -121.3, 6), "PA": (40.8, -77.8, 6), "RI": (41.7, -71.5, 9), "SC": (34.0, -81.0, 6),
    "SD": (44.5, -100.0, 6), "TN": (35.5, -86.5, 6), "TX": (31.0, -99.0, 5), "UT": (39.0, -111.5, 6), "VT": (44.0, -72.7, 7), "VA": (37.8, -78.2, 6), "WA": (47.5, -120.5, 6), "WV": (38.5, -81.9, 7),
    "WI": (44.3, -89.6, 6), "WY": (43.0, -107.5, 6),
}


def state_zoom(df: DataFrame, state: str = "state") -> DataFrame:
    """df with zoom: the struct (lat, lon, zoom) of each row's state, null for an unknown one."""
    views = F.create_map(*[x for k, v in STATE_ZOOM.items() for x in (F.lit(k), F.struct(*[F.lit(n).alias(name) for n, name in zip(v, ("lat", "lon", "zoom"), strict=True)]))])
    return df.withColumn("zoom", F.try_element_at(views, F.col(state)))


def write_csv(df: DataFrame, path: str, order: list[str], places: int | None = None) -> None:
    """Rows in order as one CSV with a header: a map slice or a comparison, of the size of a report."""
    rounded = df if places is None else df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    rounded.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """fips and ring (array of points) of each polygon's rings."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>>>"
    shapes = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    polygon, several = F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("f.geometry.type") == "Polygon", polygon).otherwise(F.flatten(several))
    return shapes.select(F.col("f.id").alias("fips"), F.explode(rings).alias("ring"))


def write_master(df: DataFrame, path: str, places: int = 4) -> None:
    """A CSV with a header, doubles rounded."""
    df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)
