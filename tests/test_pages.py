"""HTML, frontmatter, robots and the page source."""

from __future__ import annotations

import json

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuswatch.functions import html as hx
from corpuswatch.functions import robots as plain_robots
from corpuswatch.functions import text as tx
from corpuswatch.operators import manifest, robots
from corpuswatch.plans import registry
from corpuswatch.sources import frontmatter, http, listings, register

MD = [
    ("<h1>Title</h1><p>Some <b>bold</b> and <em>soft</em>  text.</p>", "# Title\n\nSome **bold** and *soft* text."),
    ("<ul><li>one<ul><li>two</li></ul></li><li>three</li></ul>", "- one\n\n  - two\n\n- three"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n\n2. b"),
    ('<p>See <a href="/x?y=1">the page</a> or <a href="#z">here</a>.</p>', "See [the page](https://h.example/x?y=1) or [here](#z)."),
    ("<pre><code><div class='token-line'><span>a = 1</span><br></div><div class='token-line'>b</div></code></pre>", "```\na = 1\nb\n```"),
    ("<pre>x\n```\ny</pre>", "````\nx\n```\ny\n````"),
    ("<pre>a<pre>b</pre>c</pre>", "```\nabc\n```"),
    ('<nav>skip</nav><p>keep</p><div aria-hidden="true">no</div><script>var x="</p>";</script><p>too</p>', "keep\n\ntoo"),
    ("<p>a<br>b</p><hr><p>c</p>", "a\nb\n\n---\n\nc"),
    ("<blockquote>q</blockquote>", "> q"),
    ("<p>1 &lt; 2 &amp;amp; 3</p>", "1 < 2 & 3"),
    ('<img src="i.png" alt="pic">', "![pic](https://h.example/d/i.png)"),
    ('<div><a href="/y"></a>rest</div>', "rest"),
    ("<form><p>law</p><select><option>x</option></select></form>", "law"),
    ('<p>a <code>b</code></p><img aria-hidden="true" src="z"><p>c</p>', "a `b`\n\nc"),
]


MD += [
    ("<ul><li>one<li>two<ul><li>three</ul></ul>", "- one\n\n- two\n\n  - three"),
    ("<p>one<p>two</div>three", "one\n\ntwo\n\nthree"),
    ("<p><b>open</p><p>next</b> end</p>", "**open\n\nnext** end"),
    ('<a href="/x"><h3>Title</h3></a>', "### [Title](https://h.example/x)"),
    ("<nav><p>no</nav></p><p>yes", "yes"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep\n\nafter"),
]


@pytest.mark.parametrize(("source", "want"), MD)
def test_markdown(source, want):
    assert hx.html_to_markdown(source, "https://h.example/d/") == want


def test_markdown_of_nothing_usable_is_none():
    assert hx.html_to_markdown("") is None and hx.html_to_markdown(None) is None
    assert hx.html_to_markdown("<script>x</script>") is None
    assert hx.html_to_markdown("<p>&lt;!DOCTYPE html&gt;</p>") is None


def test_main_region_is_the_first_article_then_main():
    assert hx.html_to_markdown("<main>m</main><article>a</article>") == "a"
    assert hx.html_to_markdown("<article> </article><main>m</main>x") == "m"


HTML = [
    ("<!DOCTYPE html><p>", True), ("  <HTML>", True), ("﻿<!-- a --><!-- b -->\n<head>", True), ('<?xml version="1.0"?><!-- c --><html>', True),
    ("# doc\n```html\n<!doctype html>", False), ("", False), ("<!-- never closed <html>", False), ("<p><html>", False), ("---\na: 1\n---\n<html>", False),
]


def test_opening_as_html_is_the_same_in_both_forms(spark):
    got = spark.createDataFrame(HTML, "t string, want boolean").select("want", tx.looks_like_html(F.col("t")).alias("is"), "t").collect()
    assert [(r["is"], hx.opens_as_html(r["t"])) for r in got] == [(w, w) for _, w in HTML]


def test_articles_are_chunked_by_number():
    page = '<div class="eli-subdivision" id="art_2"><p class="title-article-norm">Article 2</p><p class="stitle-article-norm">Scope</p><div><p>One   two</p></div></div><div class="eli-subdivision" id="x"><p>no</p></div>'
    assert hx.articles(page) == {2: "## Article 2\n\n### Scope\n\nOne two\n"}
    assert hx.articles(None) == {}
    assert hx.articles('<div class="eli-subdivision" id="art_1"><p>cut') == {}  # an article that never ends isn't whole


#: Titles cut within a reference, bare ampersands, references of references.
CUT = [f"<html><article><h1>{title}</h1><p>{text}</p></article></html>" for title, text in (
    ("and &amp", "a &amp; b"), ("and &am", "one &amp;amp two"), ("and&&amp", "&quot;x&quot; &lt"), ("plain &", "&amp;lt; &ampx; &copy 1 &#39;"), ("R&D", "a && b &; &# &amp;&amp"),
)]


def rows_and_sql(spark, folder, name):
    """What a registered query and its SQL give for the pages in ``CUT``."""
    spark.createDataFrame([(k, f"https://h.example/{k}", html) for k, html in enumerate(CUT)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    sql = registry.ORACLE_SQL[name].replace("FROM pages", f"FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(folder))
    with duckdb.connect() as con:
        want = con.execute(sql)
        assert [c[0] for c in want.description] == got.columns
        return sorted(tuple(r) for r in got.collect()), sorted(want.fetchall())


def test_chunks_of_cut_references_are_as_in_the_sql(spark, tmp_path):
    got, want = rows_and_sql(spark, tmp_path, "article_chunks")
    assert got == want and got[0][2].startswith("## and &amp\n")


def test_chunks_read_references_as_browsers_do_unless_told_otherwise():
    page = '<div class="eli-subdivision" id="art_1"><p title="&copy">a &amp b &copy; &ampc; &#38 &#38;</p><script>x && y &amp; z</script></div>'
    assert hx.articles(page) == {1: "a & b © &c; & &\nx && y &amp; z\n"}
    assert hx.articles(page, terminated=True) == {1: "a &amp b © &ampc; &#38 &\nx && y &amp; z\n"}


def test_markdown_of_cut_references_is_as_in_the_sql(spark, tmp_path):
    got, want = rows_and_sql(spark, tmp_path, "html_to_markdown")
    assert got == want and got[0][1].startswith("# and &amp\n")


def test_markdown_reads_references_as_browsers_do_unless_told_otherwise():
    page = '<p>a &amp b &copy; &ampc; &#38 &#38;</p><p><a href="/x?a=1&b=2&amp;c">to &amp;amp it</a> &amp;copy</p>'
    assert hx.html_to_markdown(page, "https://h.example/") == "a & b © &c; & &\n\n[to & it](https://h.example/x?a=1&b=2&c) ©"
    assert hx.html_to_markdown(page, "https://h.example/", terminated=True) == "a &amp b © &ampc; &#38 &\n\n[to &amp it](https://h.example/x?a=1&b=2&c) &copy"


@given(st.text())
def test_printable_leaves_nothing_unprintable(text):
    shown = hx.printable(text)
    assert shown.isprintable() and (shown == text or not text.isprintable())


def test_printable_escapes():
    shown = hx.printable("a\tb\n\x1b" + chr(0x202E) + chr(0xE0001))
    assert shown == "a\\tb\\n\\x1b\\u202e\\U000e0001" and hx.printable(None) is None


@pytest.mark.parametrize(("host", "want"), [("localhost", True), ("127.0.0.1", True), ("10.1.2.3", True), ("[::1]", True), ("100.64.0.1", True), ("224.0.0.1", True), ("8.8.8.8", False), ("example.org", False), ("", False)])
def test_private_hosts(host, want):
    assert hx.private_host(host) is want


def test_absolute_links():
    assert hx.absolute("../a", "https://h/x/y") == "https://h/a" and hx.absolute("mailto:x", "https://h/") == "mailto:x" and hx.absolute("a", "") == "a"


def test_column_forms(spark):
    rows = spark.createDataFrame([("<p>x</p>", "https://h/", "10.0.0.1"), (None, None, None)], "h string, u string, ip string")
    got = rows.select(hx.markdown_column(F.col("h"), F.col("u")), hx.private_host_column(F.col("ip")), hx.absolute_column(F.col("h"), F.col("u")), hx.printable_column(F.col("u"))).collect()
    assert got[0][:2] == ("x", True) and got[1][0] is None


# --- frontmatter and register ---------------------------------------------


def test_frontmatter():
    assert frontmatter.parse("no block") == ({}, "no block")
    assert frontmatter.parse("---\na: 2026-09-20\nb: [1, {c: 2026-01-01}]\n---\n\nbody\n") == ({"a": "2026-09-20", "b": [1, {"c": "2026-01-01"}]}, "body\n")
    assert frontmatter.parse("---\na: 1\n---") == ({"a": 1}, "") and frontmatter.parse("---\na: 1\n---\n\n") == ({"a": 1}, "")
    for bad in ("---\na: 1\n", "---\n- a\n---\n", "---\na: [\n---\n"):
        with pytest.raises(frontmatter.FrontmatterError):
            frontmatter.parse(bad)
    assert frontmatter.parse(frontmatter.dump({"b": 1, "a": "é"}, "x")) == ({"b": 1, "a": "é"}, "x")


def test_markdown_files_are_read_from_hidden_folders_too(spark, tmp_path):
    for name, text in (("a.md", "---\nid: a\n---\nA"), (".private/b.md", "B"), (".hidden.md", "no"), ("sub dir/c.md", "---\nbad"), ("d.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: (r["body"], r["error"]) for r in frontmatter.read(spark, str(tmp_path)).select("path", "body", "error").collect()}
    assert got["a.md"] == ("A", None) and got[".private/b.md"] == ("B", None) and got["sub dir/c.md"][1].startswith("unreadable") and len(got) == 3
    assert frontmatter.read(spark, str(tmp_path / "none")).count() == 0
    frontmatter.save(str(tmp_path / "n/e.md"), {"id": "e"}, "E")
    assert frontmatter.parse((tmp_path / "n/e.md").read_text()) == ({"id": "e"}, "E")


def test_sources_file(spark, tmp_path):
    path = tmp_path / "sources.json"
    assert register.read_sources(spark, str(path)).count() == 0
    path.write_text(json.dumps({"sources": [{"id": "s", "jurisdiction": "nl", "kind": "gazette", "url": "https://h.example/x", "tier": "sitemap", "unknown": 1, "allowed_hosts": "h.example"}, {"id": "t", "jurisdiction": "nl", "kind": "gazette", "url": "https://i.example/x"}]}))
    got = register.read_sources(spark, str(path)).orderBy("id").collect()
    assert [(r["adapter"], r["allowed_hosts"], r["delay_seconds"], r["status"]) for r in got] == [("sitemap", ["h.example"], 10, "proposed"), ("pagehash", ["i.example"], 10, "proposed")]
    for bad in ("{not json", "[1, 2]", '{"sources": [{"id": "s"}]}', '{"sources": 3}'):
        path.write_text(bad)
        with pytest.raises(register.RegisterError):
            register.read_sources(spark, str(path))


def test_snapshot_and_paths(tmp_path):
    path = tmp_path / "snap.json"
    assert register.read_snapshot(str(path)) is None
    register.write_json(str(path), {"b": 1, "a": 2})
    assert register.read_snapshot(str(path)) == {"a": 2, "b": 1}
    path.write_text("[]")
    with pytest.raises(register.RegisterError):
        register.read_snapshot(str(path))
    for name in ("../x", ".x", "", "a/b", "a b"):
        with pytest.raises(register.UnsafePath):
            register.safe_component(name)
    with pytest.raises(register.UnsafePath):
        register.contained(str(tmp_path), "../../etc")
    assert register.contained(str(tmp_path), "a/b").endswith("a/b")
    register.scaffold(str(tmp_path))
    register.scaffold(str(tmp_path))
    assert (tmp_path / "mirror/.gitignore").read_text() == "private/\n"


def test_a_table_can_be_replaced_by_what_reads_it(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(3).write.parquet(folder)
    register.replace_table(spark.read.parquet(folder).where("id > 0"), folder)
    assert sorted(r[0] for r in spark.read.parquet(folder).collect()) == [1, 2]


# --- robots and fetching ---------------------------------------------------

AP = "User-agent: *\nDisallow: /documenten\nAllow: /documenten/*\nDisallow: /search$\n\nUser-agent: corpuswatch\nUser-agent: other\nDisallow: /no\n"


def test_robots_verdicts(spark):
    files = spark.createDataFrame([("h", AP), ("free", ""), ("lone", "Disallow: /x\nUser-agent: a\nDisallow:\n")], "host string, text string")
    cases = [("h", "/documenten", "browser", False), ("h", "/documenten/1", "browser", True), ("h", "/search", "browser", False), ("h", "/search?q", "browser", True), ("h", "/no/x", "corpuswatch", False), ("h", "/documenten", "corpuswatch", True), ("free", "/a", "browser", True), ("lone", "/x", "a", True)]
    rules = robots.rules(files)
    for agent in ("browser", "corpuswatch", "a"):
        mine = [c for c in cases if c[2] == agent]
        req = spark.createDataFrame([(c[0], c[1]) for c in mine], "host string, path string")
        got = {(r["host"], r["path"]): r["allowed"] for r in robots.verdicts(req, rules, [f"{agent}/1.0"]).collect()}
        assert got == {(c[0], c[1]): c[3] for c in mine}
        own = plain_robots.parse(AP)
        assert all(plain_robots.allowed(own, agent, c[1]) is c[3] for c in mine if c[0] == "h")
    odd = spark.createDataFrame([("h", None), (None, "/x"), ("h", "/no"), ("h", "/no")], "host string, path string")
    assert sorted((tuple(r) for r in robots.verdicts(odd, rules, ["corpuswatch"]).collect()), key=str) == sorted([("h", None, False), (None, "/x", False), ("h", "/no", False), ("h", "/no", False)], key=str)
    states = spark.createDataFrame([(200,), (404,), (503,), (None,)], "s int").select(robots.file_state(F.col("s")), robots.status_class(F.col("s"))).collect()
    assert [tuple(r) for r in states] == [("rules", "answered"), ("none", "answered"), ("unknown", "unreachable"), ("unknown", "unreachable")]


ROUTES = {
    "https://h.example/robots.txt": [200, {}, "User-agent: *\nDisallow: /private"],
    "https://h.example/a": [200, {"content-type": "text/html"}, "<html>"],
    "https://h.example/moved": [301, {"Location": "http://h.example/a"}, ""],
    "https://h.example/away": [302, {"Location": "https://evil.example/"}, ""],
    "https://h.example/loop": [302, {"Location": "/loop"}, ""],
    "https://h.example/split": [302, {"Location": "/a b"}, ""],
    "https://h.example/busy": [503, {}, ""],
    "https://h.example/big": [200, {}, "x" * 100],
    "https://none.example/robots.txt": [404, {}, ""],
    "https://none.example/*": [200, {}, "ok"],
    "https://lost.example/a": [200, {}, "ok"],
}


def fetch(url, **options):
    waits = []
    f = http.Fetcher(http.routes_opener(ROUTES), sleep=waits.append, **{"resolver": http.public_address} | options)
    return f.get(url, ["h.example", "none.example", "lost.example"]), waits


def test_fetching():
    (status, headers, body, final), waits = fetch("https://h.example/moved")
    assert (status, body, final) == (200, b"<html>", "https://h.example/a") and headers == {"Content-Type": "text/html"} and waits == [10, 10]
    assert fetch("https://none.example/x")[0][0] == 200


@pytest.mark.parametrize(
    ("url", "error"),
    [("http://h.example/a", http.Refused), ("https://h.example/private/x", http.Refused), ("https://h.example/away", http.Refused), ("https://h.example/loop", http.Refused), ("https://h.example/split", http.Refused), ("https://other.example/", http.Refused), ("https://h.example/busy", http.Unreachable), ("https://h.example/gone", http.Unreachable), ("https://lost.example/a", http.Unreachable)],
)
def test_fetching_refuses_or_fails(url, error):
    with pytest.raises(error):
        fetch(url)


def test_budget_and_private_answers():
    with pytest.raises(http.Refused):
        fetch("https://h.example/big", budget=99)
    with pytest.raises(http.Refused):
        fetch("https://h.example/a", resolver=lambda host: ["8.8.8.8", "10.0.0.1"])
    for answer in ([], OSError("no such name"), UnicodeError("bad label")):
        def resolver(host, answer=answer):
            if isinstance(answer, Exception):
                raise answer
            return answer

        with pytest.raises(http.Unreachable):
            fetch("https://h.example/a", resolver=resolver)


def test_names_are_resolved_unless_told_otherwise():
    assert http.Fetcher(http.routes_opener(ROUTES)).resolver is http.resolve
    assert http.agent_of("browser").startswith("Mozilla") and http.agent_of("neutral") == "curl/8.0" and http.agent_of(None) == http.agent_of("odd") == http.PRODUCT


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("/a*b$", "/axxb", True), ("/a*b$", "/axxbc", False), ("/a*b", "/axxbc", True), ("/a$", "/a", True), ("/a$", "/ab", False), ("*", "/x", True), ("/*/x*y", "/q/xzy", True), ("/ab*b$", "/ab", False), ("/a*a$", "/a", False), ("", "/x", True)],
)
def test_robots_patterns_are_the_same_in_both_forms(spark, pattern, path, want):
    assert plain_robots.fits(pattern, path) is want
    row = spark.createDataFrame([(pattern, path)], "p string, t string").select(tx.robots_regex(F.col("p")).alias("rx"), "t")
    assert row.select(F.expr("t rlike rx")).first()[0] is want


def test_page_source(spark):
    spark.dataSource.register(http.PageSource)
    urls = ["https://h.example/a", "https://h.example/private/1", "https://none.example/y", "https://lost.example/a"]
    got = spark.read.format("pages").option("urls", json.dumps(urls)).option("routes", json.dumps(ROUTES)).option("delay", "0").load()
    rows = {r["url"]: r for r in got.collect()}
    assert rows[urls[0]]["status"] == 200 and bytes(rows[urls[0]]["body"]) == b"<html>"
    assert rows[urls[1]]["error"].startswith("refused") and rows[urls[2]]["status"] == 200
    assert got.rdd.getNumPartitions() == 3


# --- listings ---------------------------------------------------------------


def test_sitemap_index_is_capped_and_hostile_listings_are_refused(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://h/{k}.xml</loc></sitemap>" for k in range(5)) + "</sitemapindex>"
    files = spark.createDataFrame([("i", index), ("x", '<!DOCTYPE a [<!ENTITY b "c">]><urlset><url><loc>u</loc></url></urlset>'), ("h", "<html><url><loc>u</loc></url>")], "source string, body string")
    got = listings.sitemap_children(files, 3).orderBy("position").collect()
    assert [(r["n"], r["loc"]) for r in got] == [(5, "https://h/0.xml"), (5, "https://h/1.xml"), (5, "https://h/2.xml")]
    assert listings.sitemap(files).count() == 0
    why = dict(listings.errors(files.union(spark.createDataFrame([("cut", "<urlset><url><loc>u</loc>"), ("none", None)], "source string, body string"))).collect())
    assert set(why) == {"x", "h", "cut", "none"} and "document type" in why["x"] and "HTML" in why["h"] and "not XML" in why["cut"]


def test_listings_are_parsed_not_matched(spark):
    rows = [
        ("ns", '<?xml version="1.0" encoding="iso-8859-1"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://h/é&#x26;b</s:loc></s:url></s:urlset>'),
        ("comment", "<urlset><!-- <url><loc>https://h/no</loc></url> --><url><loc><![CDATA[https://h/a?b&c]]></loc><lastmod> </lastmod></url></urlset>"),
        ("atom", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="https://h/s"/><link href="https://h/a?b=1&amp;c=2"/><updated>d</updated></entry><entry><id>x</id></entry></feed>'),
    ]
    files = spark.createDataFrame(rows, "source string, body string")
    assert sorted((r["source"], r["loc"], r["lastmod"]) for r in listings.sitemap(files).collect()) == [("comment", "https://h/a?b&c", None), ("ns", "https://h/é&b", None)]
    assert [(r["source"], r["id"], r["link"], r["published"]) for r in listings.feed(files).collect()] == [("atom", "https://h/a?b=1&c=2", "https://h/a?b=1&c=2", "d")]


def test_needs_refresh_truth_table(spark):
    rows = [(False, None, None, None, None, True), (True, None, "a", None, "a", False), (True, "1", "b", "1", "a", True), (True, "1", None, "1", None, False), (True, "2", None, "1", None, True), (True, None, None, "1", None, True), (True, "1", None, None, None, True), (True, "", None, "", None, True)]
    table = spark.createDataFrame(rows, "p boolean, l string, h string, ol string, oh string, want boolean")
    got = table.select("want", manifest.needs_refresh(*(F.col(c) for c in ("p", "l", "h", "ol", "oh"))).alias("is")).collect()
    assert all(r["is"] == r["want"] for r in got)


def test_manifests(spark):
    files = spark.createDataFrame([("s", '{"https://x/1": "junk", "https://x/2": {"hash": "h"}}'), ("t", "{bad"), ("u", "[1]")], "source_id string, value string")
    assert [(r["source_id"], r["key"], r["hash"]) for r in manifest.read_manifests(files).collect()] == [("s", "https://x/2", "h")]
    old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "1")], "source_id string, key string, hash string")
    new = spark.createDataFrame([("s", "b", "2"), ("s", "c", "2")], "source_id string, key string, hash string")
    assert sorted((r["key"], r["hash"]) for r in manifest.upsert(old, new, ["source_id", "key"]).collect()) == [("a", "1"), ("b", "2"), ("c", "2")]
