"""URL filters by association rules.

Rules given by host and path decide first. The urls that they decide are labelled with
their verdict, all others with none: these are the background, so that a token is as sure
as the share of all urls with it that a rule decides. Tokens that stand in the same urls
are one item, and any of them stands for it: a rule with two of them is as sure with one,
so no rule is lost, and urls that share many steps do not multiply combinations. FP-growth
mines combinations of items that go with a label; rules pruned by count, support, confidence, lift over
the label's share of all urls, and redundancy decide the urls that no given rule decides.
Each mined rule stands in an inverted index under its rarest token; a url looks up its
tokens and keeps the rules that it holds whole. The one of the largest lift decides (then of more
confidence, support, tokens, then of the larger tokens); where it says none, or there is
no rule, the default verdict holds.

A null url, or one without ://, has an empty host and path, no tokens and the default
verdict. Urls of any length are read whole. Urls of one host and path count once in
mining; repeated rows each give a row; extra columns, of whatever name, are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import ascii_lower, stored

#: (verdict, host, path) of the rules that decide first (fixed values).
RULES = (("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/"))
#: Mined rules up to so many are sent to the executors; more are joined by a shuffle.
SENT = 20_000


def url_parts(url):
    """host and path columns of a url column."""
    rest = F.when(F.locate("://", url) > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host, path):
    """Distinct tokens: the host and its last one and two labels, words of its other labels, steps of the path with their depth."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), F.size(labels)), ".")
    suffixes = F.transform(F.array(last(1), last(2), host), lambda x: F.concat(F.lit("d:"), x))
    own = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
    words = F.transform(F.flatten(F.transform(own, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("h:"), x))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    return F.when(F.size(labels) > 0, F.array_distinct(F.concat(suffixes, words, steps))).otherwise(F.array().cast("array<string>"))


def labelled(spark: SparkSession, pages: DataFrame, id_col: str, url_col: str, rules: tuple) -> tuple[DataFrame, DataFrame]:
    """Urls (page_id, host, path, rule, given) and their distinct token sets (host, path, tokens, given; none for the background)."""
    host, path = url_parts("url")
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest comes last and wins
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(f"{h}/{p}")).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    urls = urls.withColumns({"rule": rule, "given": verdict})
    sets = urls.groupBy("host", "path").agg(F.first("given").alias("given")).select("host", "path", url_tokens(F.col("host"), F.col("path")).alias("tokens"), F.coalesce("given", F.lit("none")).alias("given"))
    return urls, stored(spark, sets.where("size(tokens) > 0"), "tokens")


def merged_items(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Items of tokens that are in the same urls, least or more: item (the largest token), n (urls) and alike (all of its tokens).

    Also given and, as tokens, the items of each url. Urls of a token are told apart by their number and two sums of hashes.
    """
    seen = sets.select("host", "path", "given", F.explode("tokens").alias("token"))
    urls = [F.sum(F.shiftright(F.xxhash64(*c), 24)) for c in (("host", "path"), ("path", "host"))]
    found = seen.groupBy("token").agg(F.count("*").alias("n"), urls[0].alias("a"), urls[1].alias("b")).where(F.col("n") >= least).groupBy("n", "a", "b").agg(F.max("token").alias("item"), F.collect_set("token").alias("alike"))
    chosen = found.select("item", F.col("item").alias("token"))
    chosen = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    return found.select("item", "n", "alike"), seen.join(chosen, "token", "left").groupBy("host", "path", "given").agg(F.collect_list("item").alias("tokens"))


def mine(spark: SparkSession, sets: DataFrame, min_count: int = 5, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.2) -> DataFrame | None:
    """The index of rules (anchor, ruled, alike, label, lift, confidence, support) mined from sets (host, path, tokens, given); None without labels.

    A rule holds where a url has one of the tokens of each of its items; alike lists these, ruled the items.
    """
    n = sets.count()
    if sets.where("given <> 'none'").isEmpty():
        return None
    support = max(min_support, min(min_count / n, 1.0))
    kinds, items = merged_items(sets, support * n - 0.5)
    kinds = stored(spark, kinds, "items")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items.select(F.concat("tokens", F.array(F.concat(F.lit("="), "given"))).alias("items")))
    mined = found.associationRules.where((F.size("consequent") == 1) & F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")) & (F.col("lift") >= min_lift))
    mined = stored(spark, mined.select(F.array_sort("antecedent").alias("ruled"), F.substring(F.element_at("consequent", 1), 2, 99).alias("label"), "lift", "confidence", "support"), "rules")
    # A rule is redundant where a rule of one token less is as sure.
    shorter = mined.withColumn("out", F.explode("ruled")).select(F.array_remove("ruled", F.col("out")).alias("less"), F.col("ruled").alias("t"), "label", "confidence")
    as_sure = (F.col("a.less") == F.col("b.ruled")) & (F.col("a.label") == F.col("b.label")) & (F.col("b.confidence") >= F.col("a.confidence"))
    redundant = shorter.alias("a").join(mined.alias("b"), as_sure).select(F.col("a.t").alias("ruled"), F.col("a.label").alias("label")).distinct()
    kept = mined.join(redundant, ["ruled", "label"], "left_anti")
    parts = kept.withColumn("item", F.explode("ruled")).join(kinds, "item").groupBy("ruled", "label", "lift", "confidence", "support")
    anchors = parts.agg(F.collect_list("alike").alias("alike"), F.min_by("alike", F.struct("n", "item")).alias("anchors"))
    return stored(spark, anchors.select("*", F.explode("anchors").alias("anchor")).drop("anchors"), "index")


def matched(sets: DataFrame, index: DataFrame) -> DataFrame:
    """host, path, label and mined (the tokens of the rule) of the sets (host, path, tokens) that hold a rule whole."""
    index = F.broadcast(index) if index.count() <= SENT else index
    seen = sets.select("host", "path", "tokens", F.explode("tokens").alias("anchor")).join(index, "anchor").where(F.forall("alike", lambda x: F.arrays_overlap(x, F.col("tokens"))))
    # Of the tokens of an item that the url has the largest one tells the rule.
    own = F.array_join(F.array_sort(F.transform("alike", lambda x: F.array_max(F.array_intersect(x, F.col("tokens"))))), " ")
    best = F.max(F.struct("lift", "confidence", "support", F.size("ruled").alias("k"), own.alias("mined"), "label"))
    return seen.groupBy("host", "path").agg(best.alias("m")).select("host", "path", "m.label", "m.mined")


def held_out(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, parts: int = 3, **limits) -> DataFrame:
    """given, label, n: what rules mined without a part of the urls (by hash) say of that part."""
    _, sets = labelled(spark, pages, id_col, url_col, rules)
    part = F.pmod(F.xxhash64("host", "path"), F.lit(parts))
    index = mine(spark, sets.where(part > 0), **limits)
    rest = sets.where(part == 0)
    said = matched(rest, index) if index is not None else rest.select("host", "path", F.lit("none").alias("label"))
    return rest.join(said, ["host", "path"], "left").groupBy("given", F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


def url_filter(
    spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, default: str = "allow", **limits
) -> DataFrame:
    """page_id, host, path, rule (as host/path, else null) and verdict of every url, with the tokens of the mined rule that decided (mined).

    limits: min_count, min_support, min_confidence and min_lift of mined rules.
    """
    urls, sets = labelled(spark, pages, id_col, url_col, rules)
    index = mine(spark, sets, **limits)
    if index is None:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    best = matched(sets.where("given = 'none'"), index)
    out = urls.where("given is null").join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce(F.nullif("label", F.lit("none")), F.lit(default)).alias("verdict"), "mined")
    return out.unionByName(urls.where("given is not null").select("page_id", "host", "path", "rule", F.col("given").alias("verdict"), F.lit(None).cast("string").alias("mined")))
