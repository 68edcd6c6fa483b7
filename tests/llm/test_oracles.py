"""The registered queries against their SQL, on planted tables with nulls and on the driver's small ones."""

import math
import os

import duckdb
import pytest

from tests.llm.test_operators import SCHEMA, corpus
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("planted"))
    docs = [(r[0], r[1], "en", "a", len(r[1] or "")) for r in corpus()]
    texts = [r[1] or "" for r in docs]
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{d}/documents.parquet")
    items = [(i, " ".join(t.split()[k : k + n])) for i, (t, k, n) in enumerate([(texts[4], 3, 30), (texts[1], 0, 10), (texts[2], 1, 4)])] + [(3, None), (4, "zz")]
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    hosts = ["http://a.example.com/de/x", "https://B.Example.net/en/?q", "ftp://shop.co.uk:80/x#y", "http://one.org/fr/z", "no scheme", None, "http://bad.io/1", "http://bad.io/2?x://y"]
    pages = [(i, hosts[i % 8], None if i % 9 == 0 else f"<p>{'é' * (i % 5)}</p>") for i in range(80)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    labels = [(i, None if i % 13 == 0 else int(i % 8 < 6), int(i % 8 == 7)) for i in range(80)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def rows(names, found):
    one = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 9)) if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("tables", ["planted", pytest.param("driver", marks=pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables"))])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, planted, tables, name):
    d = planted if tables == "planted" else SF
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        at = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    got = queries.queries()[name](spark, d)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    found = rows(got.columns, got.collect())
    assert found == rows(names, want.fetchall()) and found
