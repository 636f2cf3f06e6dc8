import html as html_lib
import re

from pyspark.sql import functions as F

from hopflow.llm import html_extraction as H


def expected(source):
    """The article of the pages of the test tables, by patterns that hold for them."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    parts = re.split(r"</?(?:p|h1|br|article)>", body[1])
    texts = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
    return " ".join(t for t in texts if t)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in df.collect()}
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == expected(rows[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><div class="top-menu"><a href=x>Home</a></div>
<div id=w><div class="cookieNotice">We use cookies</div><div class=lead>Always the same here</div><div class=c><h1>Head &amp; {0}</h1><p>First
  <b>bo</b>ld {0}<br>next&nbsp;line {0}<p>Second {0} <span class="share">tweet</span> end {0}</div></div>
<section class="comments"><p>Nice {0}</p></section><aside>side</aside><form>Name <input></form><script>var a="</p><p>x";</script><footer>&copy; x</footer></body></html>"""


def test_template_takes_what_pages_share(spark):
    rows = [(i, f"https://user@Host.example:80/{i}", PAGE.format(f"w{i}")) for i in range(8)] + [(99, "https://lone.example/", PAGE.format("z"))]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got[3] == "Head & w3 First bold w3 next line w3 Second w3 end w3"
    assert got[99] == "Always the same here Head & z First bold z next line z Second z end z"


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a.b", "plain < text"), (4, "http://a.b", "<p>cut <b"), (5, "http://a.b", "<article><p>a</div>b</p>" + "c " * 50_000),
            (6, None, "<main><article>in</article> out</main>"), (7, None, "<main>m<!-- x --> n</main> o"), (7, None, "<main>m<!-- x --> n</main> o"), (8, None, "<script>never closed <p>x"), (9, None, "&am &amp &#x41;&bogus;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["text"]) for r in H.extract(df).collect()), key=str)
    assert dict(got)[1] == "" and dict(got)[2] == "" and dict(got)[None] == "plain < text" and dict(got)[4] == "cut"
    assert dict(got)[5] == "a b " + "c " * 49_999 + "c" and dict(got)[6] == "in" and dict(got)[8] == "" and dict(got)[9] == "&am & A&bogus;"
    assert [t for i, t in got if i == 7] == ["m n", "m n"]
    assert H.extract(df.limit(0)).collect() == []


def test_classes_must_be_ordered_and_nested():
    assert H.accept([[1, 2, 3], [4, 5]], [1, 4, 5, 2, 3]) == {1, 2, 3, 4, 5}
    assert H.accept([[1, 2, 3], [4, 5]], [1, 4, 2, 5, 3]) == {1, 2, 3}
    assert H.accept([[1, 2, 3], [4, 5]], [3, 4, 5, 2, 1]) == {4, 5}


MARKED = "<html><body><article><h1>Head {0}</h1><div class=note>Read more on our site</div><p>Text {0}</p></article></body></html>"
TEASER = "<html><body class=b><article>Our best offers</article><div class=story><p>Story {0}</p><p>goes on {0}</p></div></body></html>"


def test_template_inside_article_and_of_each_layout(spark):
    rows = [(i, "http://h.example/", (TEASER if i >= 14 else MARKED).format(f"w{i}")) for i in range(20)]
    # The same page throughout: nothing tells its text from a template.
    rows += [(100 + i, "http://same.example/", MARKED.format("w")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head w{i} Text w{i}" for i in range(14))
    assert all(got[i] == f"Story w{i} goes on w{i}" for i in range(14, 20))
    assert got[100] == "Head w Read more on our site Text w"


def test_whole_table_without_marked_articles(spark):
    """Without <article> and <main> tags, templates and containers alone find the same text."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r["html"] for r in df.collect()}
    bare = df.withColumn("html", F.regexp_replace("html", r"</?(article|main)>", ""))
    for r in H.extract(bare).collect():
        assert r["text"] == expected(rows[r["page_id"]])


def test_templates_against_plain_code(spark):
    """Classes of tokens with equal occurrence vectors, found by writing out the vectors."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", F.regexp_extract("url", H.HOST, 1))
    hosts = {}
    for r in df.collect():
        hosts.setdefault(r["host"], []).append(H.counted(H.read_page(r["html"])))
    keys = {}
    for host, pages in hosts.items():
        keys.setdefault(host if len(pages) >= H.LEAST_PAGES else "*." + ".".join(host.split(".")[-2:]), []).extend(pages)
    want = {}
    for host, pages in keys.items():
        if len(pages) < H.LEAST_PAGES:
            continue
        vectors, at = {}, {}
        for n, page in enumerate(pages):
            for t, (c, _, place) in page.items():
                vectors.setdefault(t, {})[n] = c
                at[t] = place
        layouts = {t: len(v) for t, v in vectors.items() if t and at[t] is None and len(v) >= max(H.LEAST_PAGES, H.LEAST_LAYOUT * len(pages))}
        classes = {}
        for t, v in vectors.items():
            if at[t] in layouts and len(v) >= max(H.LEAST_PAGES, H.LEAST_SHARE * layouts[at[t]]):
                classes.setdefault(tuple(sorted(v.items())), set()).add(t)
        want[host] = {frozenset(c) for c in classes.values() if len(c) > 1}
    got = {r["host"]: {frozenset(c) for c in r["classes"]} for r in H.templates(df).collect()}
    assert got == want and sum(map(len, want.values())) > 20


def test_small_hosts_share_the_template_of_their_domain(spark):
    page = "<html><body><div class=w><p>Our shop since 1990</p><div class=s><p>Story {0}</p><p>goes on {0}</p></div><p>Call us</p></div></body></html>"
    rows = [(i, f"http://h{i // 2}.shops.example/{i}", page.format(f"w{i}")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story w{i} goes on w{i}" for i in range(12)}


def test_hostile_markup_takes_linear_time_and_memory():
    import time
    import tracemalloc

    for source in ("<div>" * 200_000, "<p>" * 150_000 + "</b>" * 150_000 + "</td>" * 150_000, "<div class=x>" * 50_000 + "y" + "</div>" * 50_000, "<a <" * 250_000, "<a href=\"" * 100_000, "<!--" * 250_000):
        tracemalloc.start()
        began = time.time()
        H.main_text(source, None)
        assert time.time() - began < 20 and tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()


def test_hot_host_is_dealt_over_tasks(spark):
    rows = [(i, "http://hot.example/", MARKED.format(f"w{i}")) for i in range(300)] + [(1000 + i, f"http://c{i % 40}.example/", MARKED.format(f"v{i}")) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: f"Head {w} Text {w}" for i, _, h in rows for w in [h.split("Head ")[1].split("<")[0]]}


def test_names_that_only_contain_a_mark_are_kept():
    kept = ("share-price", "ad-free", "social-history", "related-work", "widget", "commentary", "main-content", "menuhin", "loginless")
    gone = ("ad", "ad-box", "ads", "cookieNotice", "top-menu", "comments", "related-posts", "sidebar-widget", "x ad", "ad-300x250", "nav_bar")
    for name in kept:
        assert H.main_text(f"<div class=\"{name}\">text</div>", None) == "text", name
    for name in gone:
        assert H.main_text(f"<div class=\"{name}\">text</div>", None) == "", name


def test_memory_of_long_attributes():
    import tracemalloc

    for source in ("<div data-x=" + "a" * 4_000_000 + ">t</div>", "<div " + "a='b' " * 600_000 + ">t</div>", "<a <" * 1_000_000):
        tracemalloc.start()
        H.main_text(source, None)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


def test_tables_have_files_for_hosts_not_for_partitions(spark):
    """Of 60 partitions that all have tokens, only the templates of three hosts are written, and nothing stays cached."""
    from pathlib import Path

    from hopflow.llm.common import shared_dir

    rows = [(i, f"http://h{i % 3}.example/", MARKED.format(f"w{i}")) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, cached = Path(shared_dir(spark).removeprefix("file://")), spark.sparkContext._jsc.getPersistentRDDs().size()
    before = set(folder.rglob("*.parquet"))
    changed = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        found = H.extract(df.repartition(60))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = [p for p in set(folder.rglob("*.parquet")) - before if p.is_file()]
    assert len(files) <= 4  # with tables of tokens: 68
    assert {r["page_id"]: r["text"] for r in found.collect()} == {i: f"Head w{i} Text w{i}" for i in range(300)}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_pages_are_shuffled_only_for_large_templates(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plans, texts = [], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (H.BROADCAST_BYTES, -1):
            monkeypatch.setattr(H, "BROADCAST_BYTES", most)
            found = H.extract(df)
            plans.append(found._jdf.queryExecution().executedPlan().toString())
            texts.append({r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in found.collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plans[0] and "hashpartitioning" in plans[1]
    assert texts[0] == texts[1] and len(texts[0]) == df.count()


def test_signatures_do_not_depend_on_the_order_of_rows(spark):
    rows = [(f"h{i % 2}.example", MARKED.format(f"w{i // 6}")) for i in range(60)]  # three copies of each page in each host
    got = []
    for some in (rows, rows[::-1]):
        found = H.occurrences(spark.createDataFrame(some, "host string, html string").coalesce(1))
        got.append({(r["host"], r["token"], r["at"]): (r["signature"], r["pages"]) for r in found.collect()})
    assert got[0] == got[1] and len(got[0]) > 20


def test_memory_of_templates_in_a_batch():
    """2000 pages of one host, whose template has 2000 tokens, are read one by one."""
    import tracemalloc

    import pyarrow as pa

    n = 2000
    classes = pa.array([[list(range(1 << 40, (1 << 40) + n))]], pa.list_(pa.list_(pa.int64()))).take(pa.array([0] * n))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["u"] * n), pa.array(["<p>t</p>"] * n), classes], names=["id", "url", "html", "classes"])
    tracemalloc.start()
    (out,) = H.extracted(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column(2).to_pylist() == ["t"] * n and most < 10 << 20
