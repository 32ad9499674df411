"""The SQL of the queries against the queries on small planted tables, nulls and ties among them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomfield.llm import license_scan, queries

NOTICES = [
    "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "Er kam mit ihr. Released under the Apache License", "under mit terms the license was released",
    "cc by nc " + "word " * 200 + "licensed under cc by sa 4 0", "word " * 75 + license_scan.TEMPLATES[8][1] + " word" * 300, "MIT license, mit License " + "x " * 90 + license_scan.TEMPLATES[2][1],
]
PERSONAL = [
    "call +1 (988) 555-2485 or a.b@mail6.example.com, 53.183.220.240 and 4111 1111 1111 1111", "1.2.3.999 +12 x@y 1.2.3.4.5.6.7.8 4111-1111 11111111 4111 1111 1111 1112",
    "Later Özgür and KLARFELD went on", "🎉 é 00010.0.0.255 ÄÖ q.r@mail.example.com\nKlarfeld", "a" * 200 + " unheard q.s@mail.example.com " + "b" * 200,
    *[f"see Özgür Klarfeld o.k@mail.example.com today {x}" for x in ("first words", "second one", "third thing", "third thing")],
    *[f"w{i} x helpline +1 555 555 {1000 + i} thanks w{i}" for i in range(30)],
    *[f"see some other words thanks for today number n{i} mail example com" for i in range(400)],
]
URLS = [
    None, "", "no host", "http://", "HTTPS://Www.Example.COM/en/7/a?x#y", "ftp://net/de/", "http://a-b.net/de/8", "x://example.net/de/8#z", "y://q.org/es/1",
    *[f"http://bad{i % 7}.shop.biz/ads/{i}" for i in range(20)], *[f"http://n{i}.com/{'en' if i % 3 else 'fr'}/{i}" for i in range(60)], *[f"https://u{i}.net/de/x/{i % 4}" for i in range(30)],
]


def values(df):
    return sorted(tuple("~" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df)


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_pii", "op4_url_filter"])
@pytest.mark.parametrize("empty", [False, True])
def test_sql_gives_the_rows_of_the_query(spark, tmp_path, name, empty):
    texts = [None, "", "   \n", *NOTICES, *PERSONAL]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for table, df in (("documents", docs), ("pages", pages)):
        df.where(F.lit(not empty)).write.parquet(f"{tmp_path}/{table}.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    with duckdb.connect() as con:
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert values(got.select(columns).collect()) == values(want)
    if name == "op3_pii" and not empty:
        assert any("term:" in str(r) for r in want)
    if name == "op4_url_filter" and not empty:
        assert {"allow", "block"} <= {v for r in want for v in r} and any("p0:" in str(r[columns.index("mined")]) for r in want)
