"""Legal but odd pages and urls end in time, with the results of plain rules."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomfield.llm import html_extract as he
from loomfield.llm import url_filter as uf

#: The tokens of a page as one pattern, which takes time by the square of unclosed tags.
PATTERN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
BITS = ["<a ", "<b>", "</b>", '"', "'", ">", "<", "<!--", "-->", "<script", "</script >", "<p>", "</p", '<div class="x nav">', "</div>", "text ", "&amp;", "\n", "<?x", "<!d", "<br/>", "<svg>", "</SVG>", "<title ", "<a href='x\"y'>", "</a>"]


def test_tokens_follow_the_pattern():
    random.seed(3)
    for _ in range(20_000):
        page = "".join(random.choices(BITS, k=random.randint(0, 40)))
        assert list(he.Scanner(page).tokens()) == [(m.group(), bool(m.group(1))) for m in PATTERN.finditer(page)]


@pytest.mark.parametrize("page", ["<a " * 400_000, "<b>x" * 100_000, "<b>x" * 50_000 + "</i>" * 50_000, '<a "' * 300_000 + '">', "<a '\"<b" * 100_000 + ">", "<script " * 150_000, "<!x " * 300_000, "<!--" * 300_000, "<p " + "class=x " * 100_000 + ">y"])
def test_broken_pages_end(page):
    began = time.process_time()
    he.extract(page)
    assert time.process_time() - began < 20


def test_urls_that_share_many_steps(spark):
    steps = "/".join(f"s{i}" for i in range(60))
    urls = [f"http://bad.shop.biz/en/{steps}/{i}" for i in range(60)] + [f"http://n{i}.good.org/x/{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (("block", "shop.biz", "en/s0/s1/s2"), ("allow", "good.org", "x/1"))
    new = [(200 + i, f"http://other.shop.biz/de/{steps.replace('s0/', 'z/')}/{i}") for i in range(12)]
    got = {r.page_id: r for r in uf.url_filter(spark, df.union(spark.createDataFrame(new, df.schema)), rules=rules).collect()}
    assert all(got[i].verdict == "block" and got[i].mined is None for i in range(60))
    assert len(got) == 132
    _, sets = uf.labelled(spark, df, "page_id", "url", rules)
    index = uf.mine(spark, sets).where("label = 'block'").select("ruled", "alike").distinct().collect()
    assert [(len(r.ruled), len(r.alike[0])) for r in index] == [(1, 65)]  # the steps, what names the host, and en are one item
    _, items = uf.merged_items(sets, 5)
    assert items.where("given = 'block'").select(F.explode("tokens")).distinct().count() == 1
