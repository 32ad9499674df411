"""Personal data: patterns, and terms that disclose them by corpus co-occurrence.

Four kinds are found by pattern in the whole text. Beside them, words that stand near
such entities are weighed by information: the disclosure of an entity, or of a kind,
by a term is the pointwise mutual information of both, as a share of the information
content of what is disclosed, log(p(entity | term) / p(entity)) / -log p(entity). It is
1 where a term never occurs without the entity, or one of the kind, near. Terms that
reach the threshold wherever they stand outside entities are removed where they disclose
an entity, and generalised to the kind's name where they disclose a kind only, if two
texts or more show it and chance would not: over all terms, less than CHANCE of them would stand
near in so many texts if places were dealt at random. MANY texts always suffice, as odds
say little where most words stand near a kind.

Probabilities are over the places of words of all distinct texts, so that copies add
nothing; near means within NEAR words of three letters or more and within REACH
characters, whole words only. Only DataFrame functions are used.

Null is taken as an empty text, which has no spans. Positions are code points, ends
exclusive. Texts of any length are read whole. Repeated rows each give a row; extra
columns, of whatever name, are ignored. An empty table gives an empty result. Of a
term's disclosures the largest counts, then the one of more texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import stored

_NAME = "A-Za-z0-9._%+-"
#: Patterns by kind, in the order of results. They match as the plain patterns
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+){3},
#: [0-9]([ -]?[0-9])+ of 13 digits or more and \+[0-9][ ().0-9-]+[0-9] do from left to
#: right, but start only where a run starts and never give characters back.
PATTERNS = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){13})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Characters without which a kind can't be there.
SIGNS = {"email": "@", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What separates words.
_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Letters that have one small letter: texts keep their positions in lower case.
_CAPITALS = "".join(c for c in map(chr, range(0x10000)) if len(c.lower()) == 1 and c != c.lower())
#: Terms up to so many are part of the plan; more are joined by a shuffle.
SENT = 1000
NEAR, REACH = 3, 80
#: Terms that chance may make of all.
CHANCE = 0.01
MANY = 20


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.ascii(c) - 48 + F.when(i % 2 == 1, F.ascii(c) - 48 - F.when(F.ascii(c) >= 53, 9).otherwise(0)).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


NO_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _with_spans(df: DataFrame, name: str, text: Column, pattern: Column | str, kind: str, where: Column) -> DataFrame:
    """df with a column of spans (kind, start, end, value) of a pattern, leftmost and not overlapping."""
    whole = F.concat(F.lit(r"(?s)\G(.*?)("), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(")"))
    gaps, found = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("v")))
    steps = F.when(where, steps).otherwise(F.array().cast("array<struct<g:int,m:int,v:string>>"))

    def place(s: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("_steps", 1, i), F.lit(0), lambda a, x: a + x["g"] + x["m"]) + s["g"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + s["m"]).alias("end"), s["v"].alias("value"))

    # The steps are a column of their own: inside the lambda they would be found anew for each span.
    return df.withColumn("_steps", steps).withColumn(name, F.transform("_steps", place)).drop("_steps")


def with_entities(df: DataFrame) -> DataFrame:
    """df (with text) and spans: all of the four kinds that pass their checks, by kind and then start."""
    for kind, p in PATTERNS.items():
        seen = F.col("text").contains(SIGNS[kind]) if kind in SIGNS else F.lit(True)
        df = _with_spans(df, f"_{kind}", F.col("text"), p, kind, seen & F.col("text").rlike(p.replace(r"|\G", "")))
    kinds = [F.filter(f"_{kind}", _checked(kind)) for kind in PATTERNS]
    return df.withColumn("spans", F.concat(*kinds)).drop(*[f"_{kind}" for kind in PATTERNS])


def _low(text: Column) -> Column:
    return F.translate(text, _CAPITALS, _CAPITALS.lower())


def _words(text: Column) -> Column:
    """Words outside the patterns in lower case."""
    for p in PATTERNS.values():
        text = F.regexp_replace(text, p.replace(r"|\G", ""), " ")
    return F.filter(F.split(_low(text), _GAP), lambda w: F.length(w) >= 3)


def _terms(text: Column) -> Column:
    """_words() of a whole text; reads spans."""
    return F.when(F.size("spans") > 0, _words(text)).otherwise(F.filter(F.split(_low(text), _GAP), lambda w: F.length(w) >= 3))


def disclosing_terms(spark: SparkSession, texts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Terms with what they disclose; texts has text.

    Returns term, kind, disclosure, n_texts, entity (whether it discloses a single one):
    each term once, with what it discloses most.
    """
    found = stored(spark, with_entities(texts.select("text").distinct()), "distinct")
    near = found.select("text", F.explode("spans").alias("s"))
    # Up to REACH characters at each side, without a word that is cut there.
    before = F.substring("text", F.greatest(F.col("s.start") - REACH + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(REACH)))
    before = F.when(F.col("s.start") > REACH, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    after = F.substring("text", F.col("s.end") + 1, F.lit(REACH))
    after = F.when(F.length("text") > F.col("s.end") + REACH, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
    words = F.concat(F.slice(F.reverse(_words(before)), 1, NEAR), F.slice(_words(after), 1, NEAR))
    near = near.select(F.col("s.kind").alias("kind"), F.xxhash64(F.lower("s.value")).alias("e"), F.xxhash64("text").alias("h"), words.alias("words"))
    near = stored(spark, near.select("kind", "e", "h", F.explode("words").alias("term")).groupBy("term", "kind", "e", "h").agg(F.count("*").alias("n")), "near")
    if near.isEmpty():
        return spark.createDataFrame([], "term string, kind string, disclosure double, n_texts long, entity boolean")
    places = stored(spark, found.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_all")), "places")
    total, terms = places.agg(F.sum("n_all"), F.count("*")).first()
    share = lambda n: F.least(n / F.lit(float(total or 1)), F.lit(1.0))

    kinds = near.groupBy("kind").agg(share(F.sum("n")).alias("p_kind"))
    entities = near.groupBy("kind", "e").agg(share(F.sum("n")).alias("p"))
    by_entity = near.groupBy("term", "kind", "e").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_near")).where("n_texts >= 2").join(entities, ["kind", "e"]).join(F.broadcast(kinds), "kind")
    by_kind = near.groupBy("term", "kind", "h").agg(F.sum("n").alias("n")).groupBy("term", "kind").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_near")).where("n_texts >= 2").join(F.broadcast(kinds), "kind").withColumn("p", F.col("p_kind"))
    # The first text says which entity is meant, so that it only has the odds of the kind.
    parts = [df.select("term", "kind", "n_texts", "n_near", "p", "p_kind", F.lit(entity).alias("entity")) for df, entity in ((by_entity, True), (by_kind, False))]
    both = parts[0].unionByName(parts[1])
    weighed = both.where("p < 1").join(places, "term").withColumn("given", F.least(F.col("n_near") / F.col("n_all"), F.lit(1.0)))
    weighed = weighed.withColumn("disclosure", F.log(F.col("given") / F.col("p")) / -F.log("p"))
    odds = (F.col("n_texts") - 1) * -F.log("p") - F.log("p_kind")
    weighed = weighed.where((F.col("disclosure") >= threshold) & ((odds >= F.log(F.lit(terms / CHANCE))) | (F.col("n_texts") >= MANY)))
    best = weighed.groupBy("term").agg(F.max(F.struct("disclosure", "n_texts", "kind")).alias("m"), F.max("entity").alias("entity"))
    return stored(spark, best.select("term", "m.kind", "m.disclosure", "m.n_texts", "entity"), "terms")


def sanitise(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, keep: tuple = ()) -> DataFrame:
    """doc_id, the columns named by keep, spans (array of kind, start, end; term spans last) and clean, the text with spans generalised.

    Spans of a kind become its name in brackets, and so do terms that disclose only a kind;
    terms that disclose an entity are removed. Also n_base: the spans by pattern.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(text_col, F.lit("")).alias("text"))
    terms = disclosing_terms(spark, texts, threshold)
    texts = with_entities(texts)
    n = terms.count()
    edge = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
    if n == 0:
        texts = texts.withColumns({"_terms": F.array().cast(NO_SPANS), "_names": F.create_map().cast("map<string,string>")})
    else:
        own = F.array_distinct(_terms(F.col("text")))
        if n <= SENT:
            rows = terms.orderBy("term").collect()  # SENT at most
            few = F.array(*[F.lit(r["term"]) for r in rows])
            names = [F.lit(x) for r in rows if not r["entity"] for x in (r["term"], r["kind"])]
            listed = F.array_join(F.array_sort(F.array_intersect(own, few)), "|")
            texts = texts.withColumns({"_listed": F.when(listed != "", listed), "_names": F.create_map(*names).cast("map<string,string>")})
        else:
            texts = texts.withColumn("_text", F.xxhash64("text"))
            held = texts.select("_text", F.explode(own).alias("term")).join(terms.select("term", F.when(~F.col("entity"), F.col("kind")).alias("kind")), "term").groupBy("_text")
            held = held.agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("_listed"), F.map_from_entries(F.collect_set(F.when(F.col("kind").isNotNull(), F.struct("term", "kind")))).alias("_names"))
            texts = texts.join(held, "_text", "left")
        whole = F.concat(F.lit(f"(?<!{edge})(?:"), F.col("_listed"), F.lit(f")(?!{edge})"))
        texts = _with_spans(texts, "_terms", _low(F.col("text")), whole, "term", F.col("_listed").isNotNull())
        apart = lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
        texts = texts.withColumn("_terms", F.filter("_terms", apart))
    texts = texts.withColumn("n_base", F.size("spans")).withColumn("spans", F.concat("spans", "_terms"))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.when(s["kind"] == "term", F.try_element_at("_names", s["value"])).otherwise(s["kind"]).alias("name"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        name = F.coalesce(F.concat(F.lit("["), F.upper(s["name"]), F.lit("]")), F.lit(""))
        out = F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), name)
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate(order, start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))))
    return texts.select("doc_id", *keep, "spans", "n_base", clean.alias("clean"))
