"""The register's commands end to end over a folder and a route table."""

from __future__ import annotations

import json

import pytest

from corpuswatch import cli
from corpuswatch.register import Register
from corpuswatch.schema import DIMENSIONS
from corpuswatch.sources import frontmatter, http
from corpuswatch.sources.register import RegisterError

SITEMAP = "<urlset><url><loc>https://h.example/p/1</loc><lastmod>{m}</lastmod></url><url><loc>https://h.example/x</loc><lastmod>2024-01-01</lastmod></url></urlset>"
FEED = "<rss><channel><item><guid>g1</guid><link>https://h.example/p/2</link></item></channel></rss>"
PAGE = "<!doctype html><article><h1>{t}</h1><p>Privacy text {t}</p></article>"
BASE = "02016R0679-20240101"
CSV = f"baseCelex,consolCelex,consolDate\n32016R0679,{BASE},2024-01-01\n32016R0679,02016R0679-20990101,2099-01-01\n32016R0679,bad,2024-01-01\n"
TEXT = """<html><p class="disclaimer">d</p><p class="reference">02016R0679 — EN — 01.01.2024</p><div class="eli-subdivision" id="art_1"><p class="title-article-norm">Article 1</p><p>One</p></div>
<div class="eli-subdivision" id="art_2"><p>Two</p></div></html>"""


def routes():
    return {
        "https://h.example/robots.txt": [404, {}, ""], "https://api.example/robots.txt": [404, {}, ""],
        "https://h.example/map.xml": [200, {}, SITEMAP.format(m="2024-01-01")], "https://h.example/feed": [200, {}, FEED],
        "https://h.example/p/1": [200, {}, PAGE.format(t="One")], "https://h.example/p/2": [200, {}, PAGE.format(t="Two")], "https://h.example/p/3": [200, {}, PAGE.format(t="Three")],
        "https://api.example/query*": [200, {}, CSV], f"https://api.example/doc/{BASE}": [200, {"content-type": "application/xhtml+xml"}, TEXT],
    }


def source(id, tier, url, **more):
    return {"id": id, "jurisdiction": "NL", "kind": "gazette", "url": url, "tier": tier, "status": "confirmed", "licence": {"redistribute": id == "map"}, "delay_seconds": 0} | more


SOURCES = [
    source("map", "sitemap", "https://h.example/map.xml", config={"include": ["https://h.example/p/"]}), source("feed", "feed", "https://h.example/feed"), source("page", "page-hash", "https://h.example/p/3"),
    source("act", "api", "https://api.example/doc", adapter="eurlex", config={"celex": "32016R0679", "language": "EN"}), source("never", "refuse", "https://h.example/never"), source("new", "feed", "https://h.example/feed", status="proposed"),
]


@pytest.fixture
def place(spark, tmp_path):
    table = routes()

    def client(s):
        return http.Fetcher(http.routes_opener(table), http.agent_of((s.get("headers") or {}).get("user_agent")), delay=0, sleep=lambda t: None, resolver=http.public_address)

    reg = Register(spark, str(tmp_path / "reg"), client, ("https://api.example/query", "https://api.example/doc"))
    reg.init()
    (tmp_path / "reg/sources.json").write_text(json.dumps({"schema": 1, "sources": SOURCES}))
    meta = {"id": "r", "title": "t", "status": "binds", "jurisdiction": "nl", "sources": [{"id": "map"}, {"id": "act"}], "confirmed_by": "me", "confirmed_at": "2024-01-01", "review_by": "2024-03-01", "applies": {"quote": "q", "cite": "c", "triggered_by": ["users: yes", {"size": "big"}]}}
    frontmatter.save(str(tmp_path / "reg/regimes/r.md"), meta, "### A-1 · T\n- **You must:** x\n- **It says:** y\n")
    return reg, table


def answer(reg, **values):
    answers = {d: {"value": values.get(d, True), "status": "confirmed"} for d in DIMENSIONS}
    frontmatter.save(reg.path("profile.md"), {"schema": 1, "confirmed_by": "me", "confirmed_at": "2024-01-01", "answers": answers}, "")


def kinds(reg):
    return sorted((r["kind"], r["source"]) for r in reg.open().collect())


def test_fetch_then_check_then_a_move(place, tmp_path):
    reg, table = place
    answer(reg)
    got = reg.fetch("2024-02-01")
    assert got["written"] == 5 and got["exit"] == 0 and got["refused"] == ["never"]
    assert (tmp_path / "reg/mirror/public/nl/map").is_dir() and (tmp_path / "reg/mirror/private/nl/page").is_dir()
    again = reg.fetch("2024-02-02")
    assert (again["written"], again["skipped"]) == (0, 4)
    fresh = reg.check("2024-02-03")
    assert (fresh["fresh"], fresh["moved"], fresh["unreachable"], fresh["exit"]) == (4, 0, 0, 0)
    assert kinds(reg) == [("source-next", "act")]
    table["https://h.example/map.xml"][2] = SITEMAP.format(m="2024-02-04")
    table["https://h.example/p/3"][2] = PAGE.format(t="Changed")
    del table["https://h.example/feed"]
    moved = reg.check("2024-03-05")
    assert (moved["fresh"], moved["moved"], moved["unreachable"], moved["exit"]) == (1, 2, 1, 1)
    want = [("date-passed", None), ("profile-stale", None), ("source-moved", "map"), ("source-moved", "page"), ("source-next", "act"), ("source-unreachable", "feed")]
    assert sorted(kinds(reg), key=str) == sorted(want, key=str)
    reg.check("2024-03-06")
    assert sorted(kinds(reg), key=str) == sorted(want, key=str)
    row = next(r for r in reg.open().collect() if r["source"] == "map")
    assert row["affects"] == ["r"] and row["changed"] == ["https://h.example/p/1"] and row["changed_total"] == 1
    assert reg.resolve(row["id"], "applied", "me", "2024-03-06") == "ok" and reg.resolve(row["id"], "applied", "me", "2024-03-06") == "already resolved" and reg.resolve("chg-9999", "applied", "me", "2024-03-06") == "unknown id"
    assert reg.check("2024-03-07", ["map"])["moved"] == 1 and ("source-moved", "map") in kinds(reg)
    assert reg.status()["open"] == 6 and reg.status()["last_check"] == "2024-03-07"
    assert [h["kind"] for h in reg.search("privacy changed one").collect()][0] == "mirror"


def test_refusals_come_before_any_request(place):
    reg, _ = place
    assert reg.check("2024-02-01", ["new"])["exit"] == 2 and "required confirmation" in reg.fetch("2024-02-01", ["new"])["details"]["new"]
    assert reg.check("2024-02-01", ["nobody"])["exit"] == 2 and reg.source_problems().count() == 0
    assert reg.fetch("2024-02-01", ["never"])["exit"] == 2


def test_a_page_of_site_chrome_is_refused(place):
    reg, table = place
    table[f"https://api.example/doc/{BASE}"][2] = "<html>nothing here</html>"
    got = reg.fetch("2024-02-01", ["act"])
    assert got["exit"] == 1 and got["details"]["act"] == ["G2: there is no disclaimer block"] and kinds(reg) == [("source-unreachable", "act")]
    table[f"https://api.example/doc/{BASE}"][2] = TEXT.replace("art_2", "art_1")
    assert reg.fetch("2024-02-01", ["act"])["details"]["act"] == ["G5: article numbers repeat or fall"]
    table["https://api.example/query*"][0] = 500
    assert reg.check("2024-02-01", ["act"])["unreachable"] == 1


def test_rescan_reports_drift_once(place):
    reg, _ = place
    assert reg.rescan("2024-02-01")["exit"] == 2
    answer(reg)
    assert reg.rescan("2024-02-01") == {"changed": [], "entries": 0, "exit": 0}
    answer(reg, users=[], sector="bank", size="big")
    older = reg.path("older.md")
    frontmatter.save(older, {"answers": {d: {"value": True} for d in DIMENSIONS}}, "")
    assert reg.profile_diff(older) == ["users", "size", "sector"]
    with pytest.raises(RegisterError):
        reg.profile_diff("no-such-reference")
    got = reg.rescan("2024-02-02")
    assert got["entries"] == 3 and sorted(got["changed"]) == ["sector", "size", "users"]
    filed = {r["summary"]: (r["kind"], r["affects"]) for r in reg.open().collect()}
    assert filed["users is no longer true"] == ("regime-gone", ["r"]) and filed["size changed"] == ("regime-new", ["r"]) and filed["sector changed"] == ("regime-new", [])
    assert reg.rescan("2024-02-03")["entries"] == 0
    with open(reg.path("profile.snapshot.json"), "w") as file:
        file.write("[]")
    with pytest.raises(RegisterError):
        reg.rescan("2024-02-04")


def test_problems_and_poisoned_files_do_not_stop_the_rest(place, tmp_path):
    reg, _ = place
    (tmp_path / "reg/regimes/bad.md").write_text("---\nid: x\n")
    (tmp_path / "reg/pending.jsonl").write_text("{nonsense\n")
    assert [r["path"] for r in reg.regime_problems().collect()] == ["bad.md"]
    assert reg.status()["unreadable"] == 1 and reg.profile_problems().count() == 15
    assert reg.check("2024-02-01")["moved"] == 4


def test_an_unreadable_profile_is_a_problem_and_stops_no_check(place, tmp_path):
    reg, _ = place
    (tmp_path / "reg/profile.md").write_text("---\nbad: [\n")
    problems = reg.profile_problems().collect()
    assert problems[0]["problem"].startswith("unreadable") and problems[0]["blocks"]
    assert reg.check("2024-02-01")["moved"] == 4 and reg.rescan("2024-02-01")["exit"] == 2 and reg.status()["last_check"] == "2024-02-01"


def test_dates_are_checked_before_anything_is_written(place, tmp_path):
    reg, _ = place
    before = (tmp_path / "reg/sources.json").read_text()
    for run in (reg.check, reg.fetch, reg.rescan):
        for bad in ("2024-13-01", "tomorrow", "01-02-2024"):
            with pytest.raises(ValueError, match="is not a date"):
                run(bad)
    assert (tmp_path / "reg/sources.json").read_text() == before and not (tmp_path / "reg/pending.jsonl").exists()


def test_a_malformed_listing_is_unreachable_and_a_redirect_stays_on_allowed_hosts(place):
    reg, table = place
    table["https://h.example/map.xml"][2] = "<urlset><url><loc>https://h.example/p/1</loc></url>"
    got = reg.check("2024-02-01", ["map"])
    assert got["unreachable"] == 1 and "not XML" in got["details"]["map"]
    table[f"https://api.example/doc/{BASE}"] = [302, {"Location": "https://evil.example/x"}, ""]
    table["https://evil.example/*"] = [200, {"content-type": "text/html"}, TEXT]
    got = reg.fetch("2024-02-01", ["act"])
    assert got["exit"] == 1 and "host not allowed" in got["details"]["act"][0]


def test_a_listing_over_its_cap_says_so(place):
    reg, table = place
    table["https://h.example/map.xml"][2] = "<urlset>" + "".join(f"<url><loc>https://h.example/p/{k}</loc><lastmod>d</lastmod></url>" for k in range(2001)) + "</urlset>"
    got = reg.check("2024-02-01", ["map"])
    assert got["moved"] == 1 and got["details"]["map"] == "2000 of 2000 changed (listing exceeds 2000 pages, capped)"
    row = next(r for r in reg.open().collect() if r["source"] == "map")
    assert len(row["changed"]) == 20 and row["changed_total"] == 2000


def test_private_hosts_are_a_problem(place, tmp_path):
    reg, _ = place
    hosts = ["10.example.com", "100.64.0.1", "224.0.0.1", "[fe80::1]", "fd00::1", "h.example"]
    (tmp_path / "reg/sources.json").write_text(json.dumps({"sources": [source("x", "feed", "https://h.example/f", allowed_hosts=hosts)]}))
    found = [r["problem"] for r in reg.source_problems().collect()]
    assert len(found) == 1 and "(100.64.0.1, 224.0.0.1, [fe80::1], fd00::1)" in found[0]


def test_commands_print_and_exit(place, tmp_path, capsys, monkeypatch):
    reg, _ = place
    answer(reg)
    run = lambda *a: (cli.main(["--folder", str(tmp_path / "reg"), *a], reg), capsys.readouterr())
    code, out = run("check", "--today", "2024-02-01")
    assert code == 0 and out.out.startswith("fresh 0 · moved 4 · unreachable 0\n")
    assert run("check", "--today", "soon")[0] == 1 and run("check", "--source", "nobody")[0] == 2
    code, out = run("check", "--json", "--source", "map", "--today", "2024-02-02")
    assert code == 0 and json.loads(out.out)["moved"] == 1
    code, out = run("pending", "--json")
    rows = json.loads(out.out)
    assert code == 0 and {r["kind"] for r in rows} >= {"source-moved", "source-next"}
    assert run("resolve", rows[0]["id"], "--action", "applied", "--by", "me")[0] == 0
    code, out = run("resolve", rows[0]["id"], "--action", "applied", "--by", "me")
    assert code == 1 and "already resolved" in out.err
    assert run("fetch", "--source", "page", "--today", "2024-02-02")[1].out.startswith("written 1 · skipped 0 · refused 0")
    code, out = run("search", "privacy", "-k", "2", "--json")
    assert code == 0 and json.loads(out.out)[0]["kind"] == "mirror"
    assert run("status")[1].out.startswith("profile: valid") and "open" in json.loads(run("status", "--json")[1].out)
    for part in ("profile", "regimes", "sources"):
        assert run(part, "validate")[0] == 0
    assert run("profile", "diff", "--against", reg.path("profile.md"))[0] == 0 and run("profile", "diff", "--against", "nothing")[0] == 1
    assert run("rescan", "--today", "2024-02-03")[1].out.startswith("changed: nothing")
    (tmp_path / "reg/regimes/bad.md").write_text("---\nid: x\x1b[31m\n")
    code, out = run("regimes", "validate")
    assert code == 1 and "\x1b" not in out.out
    assert run()[0] == 1 and run("check", "--nonsense")[0] == 1
    assert cli.main(["--folder", str(tmp_path / "none"), "status"], None) == 2
    monkeypatch.setattr(cli, "prerequisites", lambda: ["a thing is missing"])
    assert cli.main(["--folder", str(tmp_path / "reg"), "status"], None) == 2 and "a thing is missing" in capsys.readouterr().err
