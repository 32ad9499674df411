"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens, tags and stretches of text, each told apart by the
tags that it stands in. Across the pages of one host every token has an occurrence
vector, its count in each page; it is kept as a sum of hashes of (page, count), so
that vectors are equal where the sums are and Spark adds them up before a shuffle.
Tokens of one host with one vector, in MIN_SHARE of its pages or more, form an
equivalence class. A class is valid where its tokens have one order on all pages, no
class of more support is interleaved with it, and it is nested in the same slot of the
same class everywhere. Support is also counted by contents (a page's longest text), so
that near copies of one article do not make its passages a template.

The nested valid classes are the host's template, and what stands behind each token of
a class up to the next one is a slot. Slots are judged over all pages of the host: those
whose text stands in the article (or main) element for the most part are main; where a
host has none, all are, but those whose text is links for the most part (menus that
change from page to page). Text of the template outside articles is left out, unless
nothing would remain. So are elements for navigation, headers, footers, asides, notices,
adverts, forms, scripts, styles or comments of readers. Pages of hosts without a
template are judged by their own elements.

A host's classes are bounded by the mean number of tokens of its pages: each stands in
MIN_SHARE of them. A host whose longest text is the same notice on all pages counts as
copies, and its texts stay.

Null and empty pages have an empty text, an empty table gives an empty result. Unclosed
tags and stray ends are borne, pages of any length are read whole. Pages without a host
form a host of their own. Repeated rows each give a row; extra columns, of whatever
name, are ignored. Of classes of equal support the one of the smaller hash counts as
the larger one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import stored
from loomfield.llm.url_filter import url_parts

#: Elements whose content is no markup, with what ends them (as does the end of the page).
RAW = {name: re.compile(rf"</{name}\s*>|$", re.I) for name in "script style noscript template textarea title svg iframe".split()}
RAW_NAME, COMMENT_END, QUOTED = re.compile(rf"<({'|'.join(RAW)})\b", re.I), re.compile(r"-->|$"), re.compile(r"['\">]")
#: Texts, and tags without a < in them; a match looks no further than the next <.
USUAL = re.compile(rf"[^<]++|<(?!(?:{'|'.join(RAW)})\b)/?[a-zA-Z][^<>'\"]*+(?:(?:\"[^\"<]*+\"|'[^'<]*+')[^<>'\"]*+)*+>", re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
MARK = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:[\s=>/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements, and words of class, id or role, that never hold main text.
ASIDE = frozenset("nav footer aside form menu button select dialog head fieldset".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer "
    "gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related reply respond search share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Class tokens up to so many are sent to the executors, with their hosts; more are joined by a shuffle.
SENT = 200_000
#: Pages, and contents, that a template takes at least, and the share of a host's that a class takes.
MIN_PAGES, MIN_SHARE = 8, 0.8


#: Longer texts are hashed anew each time, so that the memory of hashes is bounded in bytes, too.
REMEMBERED = 200


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


_short = lru_cache(1 << 16)(_digest)


@lru_cache(1 << 16)
def _inside(path: int, name: str) -> int:
    """The path of an element inside another one."""
    return _digest(f"{path}/{name}")


def _hash(text: str) -> int:
    return (_short if len(text) <= REMEMBERED else _digest)(text)


class Scanner:
    """Cuts a page into comments, tags, raw elements and texts, in time in proportion to its length.

    A tag ends at the first > outside quotes; one that never ends is text. Places that a
    scan without end has passed outside quotes are not passed again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "'\">"}
        self.next, self.since, self.dead = -1, 0, set()

    def mark(self, p: int) -> int:
        """The first quote or > from p on; the length of the page if there is none."""
        if not self.since <= p <= self.next:
            found = QUOTED.search(self.page, p) if p <= max(self.last.values()) else None
            self.since, self.next = p, found.start() if found else len(self.page)
        return self.next

    def tag_end(self, p: int) -> int | None:
        """Where the tag that begins before p ends; none if it never does."""
        passed = []
        while p <= self.last[">"] and (q := self.mark(p)) not in self.dead and q < len(self.page):
            if self.page[q] == ">":
                return q + 1
            passed.append(q)
            if q >= self.last[self.page[q]]:
                break
            p = self.page.find(self.page[q], q + 1) + 1
        self.dead.update(passed)
        return None

    def tokens(self) -> Iterator[tuple[str, bool]]:
        """Each token, and whether it is a raw element."""
        page, p, usual = self.page, 0, USUAL.match
        while p < len(page):
            if m := usual(page, p):
                yield m.group(), False
                p = m.end()
                continue
            end, raw = None, False
            if page.startswith("<!--", p):
                end = COMMENT_END.search(page, p + 4).end()
            elif (m := RAW_NAME.match(page, p)) and p < self.last[">"]:
                end, raw = RAW[m.group(1).lower()].search(page, page.find(">", p) + 1).end(), True
            elif NAME.match(page, p):
                end = self.tag_end(p + 2)
            elif page[p + 1 : p + 2] in ("!", "?") and p < self.last[">"]:
                end = page.find(">", p) + 1
            end = p + 1 if end is None else end
            yield page[p:end], raw
            p = end


def walk(page: str) -> Iterator[tuple[tuple[int, bool], str, bool, bool, bool]]:
    """(path, token, is text, inside an article, outside main text) of each token of a page.

    A path is the hash of the names of open elements, and whether a link is among them.
    """
    top = ((0, False), False, False)
    stack: list[tuple[str, tuple]] = []  # name, what holds inside it: path, in an article, off
    opened: Counter = Counter()
    path, inside, off = top

    def close(name: str) -> tuple:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return stack[-1][1] if stack else top

    for token, raw in Scanner(page).tokens():
        if token[0] != "<" or token == "<":
            yield path, token, True, inside, off
            continue
        if raw or token[1] in "!?":
            yield path, "<hidden>", False, inside, True
            continue
        name = NAME.match(token).group(1).lower()
        if token[1] == "/":
            if opened[name]:
                path, inside, off = close(name)
            yield path, f"</{name}>", False, inside, off
            continue
        if name in CLOSES_P and opened["p"] and any(x[0] == "p" for x in stack[-8:]):
            path, inside, off = close("p")
        marks = " ".join(x for found in MARK.findall(token) for x in found if x).lower()
        yield path, f"<{name} {marks}>", False, inside, off
        if name in VOID or token.endswith("/>"):
            continue
        bad = name in ASIDE or (name == "header" and not inside) or (bool(marks) and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", marks)) and name not in ("html", "body", "article", "main")) or bool(HIDDEN.search(token))
        path, inside, off = ((_inside if len(name) <= REMEMBERED else _inside.__wrapped__)(path[0], name), path[1] or name == "a"), inside or name in MAIN, off or bad
        stack.append((name, (path, inside, off)))
        opened[name] += 1


def _text(chunk: str) -> str:
    return " ".join(html.unescape(chunk).split())


def _key(path: tuple[int, bool], token: str, is_text: bool, inside: bool) -> int | None:
    """What tells a token apart; text of articles and white space are no tokens of a template."""
    if not is_text:
        return _hash(f"{path[0]}\n{token}")
    if inside or token.isspace():
        return None
    return _hash(f"{path[0]}\n{_text(token)}")


def tokens_of(page: str) -> Counter:
    """How often each token is in a page."""
    found = Counter(_key(path, token, is_text, inside) for path, token, is_text, inside, _ in walk(page))
    found.pop(None, None)
    return found


def shape_of(page: str, classes: dict[int, int], rank: dict[int, int]) -> tuple[int, list, dict]:
    """What a page says of its host's classes (token to class; rank: the larger the support, the lower).

    Returns the hash of its longest text, rows (class, order of its tokens, the slot that it
    is nested in, whether a class before it is interleaved) and by slot [characters in
    articles, in links, all].
    """
    longest, slots, slot = "", defaultdict(lambda: [0, 0, 0]), (0, 0)
    at: dict[int, list[int]] = defaultdict(list)
    order: dict[int, list[int]] = defaultdict(list)
    times: Counter = Counter()
    for i, (path, token, is_text, inside, off) in enumerate(walk(page)):
        if is_text and not off and len(token) > len(longest):
            longest = token
        key = _key(path, token, is_text, inside)
        if (c := classes.get(key)) is not None:
            at[c].append(i)
            order[c].append(key)
            times[key] += 1
            slot = (key, times[key])
        elif is_text and not off and (n := len(token.strip())):
            sums = slots[slot]
            sums[0] += n * inside
            sums[1] += n * path[1]
            sums[2] += n
    parent, bad = {}, set()
    for a, b in combinations(sorted(at, key=rank.__getitem__), 2):
        i, j = bisect_left(at[a], at[b][0]), bisect_left(at[a], at[b][-1])
        if i != j and bisect_left(at[b], at[a][0]) != bisect_left(at[b], at[a][-1]):
            bad.add(b)
        elif i == j and 0 < i < len(at[a]):
            parent[b] = max(parent.get(b, (-1, 0, 0)), (at[a][i - 1], a, i))
    rows = [(c, _digest(str(keys)), _hash(str(parent.get(c, (0, 0, 0))[1:])), c in bad) for c, keys in order.items()]
    return _digest(_text(longest)), rows, slots


class Template:
    """The tokens of a host's classes, those of valid ones, and its slots: whether they are main."""

    def __init__(self, tokens=(), slots=()):
        self.tokens = {x["t"]: x["valid"] for x in tokens or ()}
        self.slots = {(x["t"], x["k"]): x["main"] for x in slots or ()}


def extract(page: str, template: Template | None = None) -> str:
    """The main text of a page."""
    found: list[tuple[str, bool, bool | None, bool]] = []  # text or block end, inside an article, slot is main, template
    has_article, slot, times = False, (0, 0), Counter()
    tokens, slots = (template.tokens, template.slots) if template else ({}, {})
    for path, token, is_text, inside, off in walk(page):
        has_article |= inside
        key = _key(path, token, is_text, inside) if tokens else None
        if key in tokens:
            times[key] += 1
            slot = (key, times[key])
        if is_text:
            if not off:
                found.append((token, inside, slots.get(slot), tokens.get(key, False)))
        elif (name := NAME.match(token)) and name.group(1) not in INLINE:
            found.append(("\n", inside, True, False))
    alone = lambda x: x[1] or not has_article
    for keep in (lambda x: (alone(x) if x[2] is None else x[2]) and not x[3], alone):
        if text := _text("".join(x[0] if keep(x) or x[0] == "\n" else "" for x in found)):
            return text
    return ""


def _classes(pages: DataFrame, min_pages: int, min_share: float, min_size: int) -> DataFrame:
    """host, its number of pages, and classes: tokens and support of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                each = [tokens_of(x or "") for x in part.column(2).to_pylist()]
                row = pa.array([i for i, c in enumerate(each) for _ in c], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array([t for c in each for t in c], pa.int64()), pa.array([n for c in each for n in c.values()], pa.int64())], ["host", "page_id", "t", "n"])

    counted = pages.select("host", "page_id", "html").mapInArrow(run, "host string, page_id long, t long, n long")
    vectors = counted.groupBy("host", "t").agg(F.count("*").alias("support"), F.sum(F.shiftright(F.xxhash64("page_id", "n"), 24)).alias("v1"), F.sum(F.shiftright(F.xxhash64("n", "page_id"), 24)).alias("v2"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    frequent = vectors.where(F.col("support") >= min_pages * min_share).join(sizes, "host").where(F.col("support") >= F.col("pages") * min_share)
    classes = frequent.groupBy("host", "v1", "v2", "support").agg(F.collect_set("t").alias("ts")).where(F.size("ts") >= min_size)
    return classes.groupBy("host").agg(F.collect_list(F.struct("ts", "support")).alias("classes"))


def _with_hosts(pages: DataFrame, hosts: DataFrame, tokens, kind: str) -> DataFrame:
    """pages with what is known of their hosts, sent to the executors where it is small enough."""
    n = hosts.agg(F.sum(tokens + 10)).first()[0] or 0
    return pages.join(F.broadcast(hosts) if n <= SENT else hosts, "host", kind)


def templates(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_size: int = 2) -> DataFrame:
    """host, tokens (t, valid) and slots (t, k, main: behind the k-th t of a page) of hosts with valid classes.

    pages has host, page_id and html.
    """
    found = stored(spark, _classes(pages, min_pages, min_share, min_size), "classes")
    judged = _with_hosts(pages.select("host", "html"), found, F.aggregate("classes", F.lit(0), lambda a, x: a + F.size(x["ts"])), "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for k in range(0, len(batch), 200):
                part, rows = batch.slice(k, 200), []
                for host, page, classes in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        listed = sorted((-c["support"], min(c["ts"]), c["ts"]) for c in classes.as_py())
                        known[host] = {t: c for _, c, ts in listed for t in ts}, {c: i for i, (_, c, _) in enumerate(listed)}
                    content, shape, slots = shape_of(page or "", *known[host])
                    rows += [(host, content, 0, c, 0, order, parent, int(bad)) for c, order, parent, bad in shape]
                    rows += [(host, content, 1, t, i, *sums) for (t, i), sums in slots.items()]
                    rows.append((host, content, 2, 0, 0, 0, 0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], ["host", "content", "kind", "t", "k", "x", "y", "z"])

    rows = judged.select("host", "html", "classes").mapInArrow(run, "host string, content long, kind long, t long, k long, x long, y long, z long")
    length = lambda c: F.when(F.col("kind") == 1, F.col(c))
    sums = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz"] + [F.sum(length(c)).alias(f"sum_{c}") for c in "xyz"]
    by_content = stored(spark, rows.groupBy("host", "kind", "t", "k", F.when(F.col("kind") != 1, F.col("content")).alias("content")).agg(*sums), "shapes")
    again = [f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for f in (F.min, F.max, F.sum) for c in "xyz"]
    shapes = by_content.groupBy("host", "kind", "t", "k").agg(F.count("*").alias("contents"), *again)
    many = shapes.where("kind = 2").select("host", F.col("contents").alias("of")).where(F.col("of") >= min_pages)
    one = (F.col("min_x") == F.col("max_x")) & (F.col("min_y") == F.col("max_y")) & (F.col("max_z") == 0)
    valid = shapes.where("kind = 0").join(many, "host").where(one & (F.col("contents") >= min_pages) & (F.col("contents") >= F.col("of") * min_share)).select("host", F.col("t").alias("c"))
    valid = valid.groupBy("host").agg(F.collect_set("c").alias("valid"))
    within, link = F.col("sum_x") * 2 > F.col("sum_z"), F.col("sum_y") * 2 > F.col("sum_z")
    slots = shapes.where("kind = 1").groupBy("host").agg(F.collect_list(F.struct("t", "k", within.alias("within"), link.alias("link"))).alias("slots"))
    has_main = F.exists("slots", lambda x: x["within"])
    judged = F.transform("slots", lambda x: F.struct(x["t"].alias("t"), x["k"].alias("k"), F.when(has_main, x["within"]).otherwise(~x["link"]).alias("main")))
    tokens = F.flatten(F.transform("classes", lambda c: F.transform(c["ts"], lambda t: F.struct(t.alias("t"), F.array_contains("valid", F.array_min(c["ts"])).alias("valid")))))
    return found.join(valid, "host").join(slots, "host").select("host", tokens.alias("tokens"), judged.alias("slots"))


def main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    host, _ = url_parts("url")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host)
    found = stored(spark, templates(spark, own, min_pages), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                texts = []
                for host, page, tokens, slots in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), part.column(5), strict=True):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = Template(tokens.as_py(), slots.as_py())
                    texts.append(extract(page or "", known[host]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    judged = _with_hosts(own, found, F.size("tokens") + F.size("slots"), "left")
    return judged.select("page_id", "url", "host", "html", "tokens", "slots").mapInArrow(run, "page_id long, url string, text string, n_chars long")
