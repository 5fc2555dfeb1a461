"""URL filters: rules, aliases over links, and the components behind them."""

import random

import pytest

from undula.llm import urls
from undula.llm.components import components

SCHEMA = "page_id bigint, url string, html string, host string, key string"


def judge(spark, rows):
    d = spark.createDataFrame([(i, u, h, "h", "k") for i, u, h in rows], SCHEMA)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(d).collect()}


def test_rules(spark):
    got = judge(
        spark,
        [
            (1, "http://A.Example.COM/en/x?q#f", None), (2, "https://www.example.com/en/", ""), (3, "x://b.www.example.com/en/1", ""), (4, "http://example.com", ""),
            (5, "http://n.net/fr/1", ""), (6, "http://n.net/en/", ""), (7, None, None), (8, "no scheme/en/", ""), (9, "", ""), (10, "http://badexample.com/en/", ""),
            (11, "http://É.example.com/en/", ""), (12, "a://b://example.com/en/", ""), (13, "http://x.net?/es/", ""), (14, "http://" + "y" * 50_000 + ".net/es/", ""),
        ],
    )
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4] == ("example.com", "", None, "allow")
    assert got[5][2:] == ("net/fr/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == ("com/", "allow")
    assert got[11][0] == "É.example.com" and got[11][3] == "block"
    assert got[12][:2] == ("b:", "//example.com/en/")
    assert got[13][:3] == ("x.net", "", None)
    assert got[14][3] == "block"


def test_blocks_follow_links_and_allows_win(spark):
    link = '<link href="{}" rel="canonical">'
    got = judge(
        spark,
        [
            (1, "http://a.org/1", '<html><LINK rel=canonical href="http://b.org/2?utm_source=x">'),
            (2, "https://b.org/2.html", '<meta http-equiv="refresh" content="0; url=http://c.net/fr/3">'),
            (3, "http://c.net/fr/3", ""), (4, "http://d.org/", link.format("//a.org/1/")), (5, "http://e.org/5", link.format("/6")), (6, "http://e.org/6", ""),
            (7, "http://f.org/", link.format("http://x.example.com/en/7")), (8, "http://www.example.com/en/8", link.format("http://x.example.com/en/7")),
            (9, "http://a.org/1", ""), (9, "http://a.org/1", ""), (10, "http://x.example.com/en/7", ""),
        ],
    )
    assert [got[i][3] for i in (1, 2, 3, 4, 9)] == ["block"] * 5
    assert [got[i][3] for i in (5, 6)] == ["allow"] * 2
    assert got[7][3] == "allow"  # its class has an explicitly allowed page
    assert got[8][3] == "allow" and got[10][3] == "block"  # own rules stand


def test_empty_table(spark):
    assert judge(spark, []) == {}


def test_too_many_rules(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        urls.fitting_rule(F.lit(""), F.lit(""), [urls.RULES[0]] * 1001)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(500, 500 + i) for i in range(1, 80)] + [(900 + i, 901 + i) for i in range(40)] + [(1, None), (3, 3)]
    root = {}
    for a, b in edges:
        if b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if b is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == root


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_all_links_of_a_page_count(spark):
    canonical = '<link rel="{}" href="{}">'.format
    refresh = '<meta http-equiv=refresh content="0;url={}">'.format
    pages = [
        (1, "http://a.org/1", canonical("canonical", "http://a.org/1") + canonical("canonical", "http://b.net/fr/1")),  # itself first, then a blocked page
        (2, "http://a.org/2", canonical("alternate canonical", "/1")), (3, "http://a.org/3", canonical("nofollow  canonical  x", "http://a.org/2")),
        (4, "http://a.org/4", canonical("canonical-not", "http://b.net/fr/1") + "<link rel='alternate' href='http://b.net/fr/1'>"),
        (5, "http://a.org/5", refresh("http://a.org/6") + refresh("http://a.org/7")), (6, "http://a.org/6", refresh("http://a.org/5")),
        (7, "http://a.org/7", "<link rel='x canonical' href='//c.org/8'/><link href=http://a.org/3 rel=canonical>"), (8, "https://c.org/8", None), (9, "http://b.net/fr/1", ""),
    ]
    got = {k: v[3] for k, v in judge(spark, pages).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "block", 9: "block"}


def test_links_equal_the_sql(spark, tmp_path):
    from undula.llm.queries import ORACLES, QUERIES

    rng = random.Random(7)
    url = lambda: rng.choice(["http://a.org/{}", "https://b.com/x/{}", "http://c.net/fr/{}", "http://www.example.com/en/{}", "http://x.example.com/en/{}"]).format(rng.randrange(40))
    link = lambda: rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' rel='a canonical b'>", '<meta http-equiv="refresh" content="1; url={}">', '<link rel="alternate" href="{}">', "<link rel=canonical href={}>"]).format(url())
    rows = [(i, url(), rng.choice([None, "", "<p>"] + ["".join(link() for _ in range(rng.randrange(4)))] * 3)) for i in range(120)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = sorted(map(str, con.execute(ORACLES["op3_urls"]).fetchall()))
    got = QUERIES["op3_urls"](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(set(r.verdict for r in got.collect())) == 2
