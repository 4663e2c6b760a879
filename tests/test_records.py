"""Logs, versions, freshness, profiles, regimes and search on small tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuswatch.functions import text as tx
from corpuswatch.operators import freshness, logs, profile, regimes, search, status, validate, versions
from corpuswatch.schema import DIMENSIONS, PENDING, RESOLUTION, SOURCE
from corpuswatch.streaming import logs as stream

LINES = [
    '{"id": "chg-0001", "kind": "source-moved", "severity": "major", "source": "s", "affects": ["r"], "to": "v2"}', "not json", "", "   ", "[1]", '{"kind": "x", "severity": "info"}',
    '{"id": "chg-0002", "severity": "info"}', '{"id": "chg-0003", "kind": 7, "severity": "info"}', '{"id": "chg-0004", "kind": "k", "severity": null}', '{"id": ["a"], "kind": "k", "severity": "info"}',
    '{"id": "chg-12345", "kind": "source-unreachable", "severity": "info", "source": "t"}', '{"id": "x-9", "kind": "profile-stale", "severity": "odd"}',
]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_log_lines_are_typed_before_they_count(spark):
    read = logs.read_lines(lines(spark, LINES))
    assert sorted(r["id"] for r in logs.entries(read, PENDING).collect()) == ["chg-0001", "chg-12345", "x-9"]
    assert logs.unreadable(read, logs.read_lines(lines(spark, ['{"id": "a"}', "{}"]), pending=False)).first()[0] == 8
    got = logs.enum_problems(logs.entries(read, PENDING)).collect()
    assert [r["id"] for r in got] == ["x-9"]


def test_ids_follow_the_largest_and_stay_wide(spark):
    entries = logs.entries(logs.read_lines(lines(spark, LINES)), PENDING)
    new = logs.with_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), ["name"], entries)
    assert sorted((r["name"], r["id"]) for r in new.collect()) == [("a", "chg-12346"), ("b", "chg-12347"), ("c", "chg-12348")]
    assert logs.with_ids(spark.createDataFrame([("a",)], "name string"), ["name"], entries.limit(0)).first()["id"] == "chg-0001"


def test_replay_ignores_order_and_resolution_frees_a_key(spark):
    rows = [(f"chg-{k:04d}", "source-moved", f"s{k % 3}") for k in range(1, 8)]
    done = [("chg-0002",), ("chg-0005",), ("chg-0005",), ("chg-0099",)]
    want = {"chg-0001", "chg-0003", "chg-0004", "chg-0006", "chg-0007"}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = logs.open_entries(spark.createDataFrame(rows, "id string, kind string, source string"), spark.createDataFrame(done, "id string"))
        assert {r["id"] for r in got.collect()} == want
    new = spark.createDataFrame([("k", "a"), ("k", None), ("k", "a"), ("j", "a")], "kind string, source string")
    filed = logs.suppress(new, spark.createDataFrame([("k", None)], "kind string, source string"), ["kind", "source"])
    assert sorted(map(tuple, filed.collect())) == [("j", "a"), ("k", "a")]
    assert logs.suppress(new, filed.union(spark.createDataFrame([("k", None)], "kind string, source string")), ["kind", "source"]).count() == 0


def test_extra_fields_never_replace(spark):
    row = logs.add_extra(spark.createDataFrame([("a",)], "id string"), {"id": F.lit("b"), "to": F.lit("v")}).first()
    assert (row["id"], row["to"]) == ("a", "v")


def test_versions(spark):
    rows = [("b", "v1", "2023-01-01"), ("b", "v3", "2025-01-01"), ("b", "v2b", "2024-01-01"), ("b", "v2a", "2024-01-01"), ("c", "n", "2030-01-01"), ("d", "o", "2020-01-01")]
    got = {r["base"]: (r["current"], r["next_version"], r["next_date"]) for r in versions.current_and_next(spark.createDataFrame(rows, "base string, version string, date string"), F.lit("2024-06-01")).collect()}
    assert got == {"b": ("v2a", "v3", "2025-01-01"), "c": (None, "n", "2030-01-01"), "d": ("o", None, None)}
    named = versions.well_formed(spark.createDataFrame([("02016R0679-20160504", "2016-05-04"), ("02016R0679-20160504\n", "2016-05-04"), ("x", "2016-05-04"), ("02016R0679-20160504", "4.5.2016")], "version string, date string"))
    assert named.count() == 1
    wanted = spark.createDataFrame([("32016R0679",)], "base string")
    links, ids, dates = spark.createDataFrame([("32016R0679", "w1"), ("32016R0679", "w2")], "base string, work string"), spark.createDataFrame([("w1", "02016R0679-1"), ("w2", "12016R0679-1")], "work string, version string"), spark.createDataFrame([("w1", "2020-01-01"), ("w2", "2020-01-01")], "work string, date string")
    assert [r["version"] for r in versions.consolidations(wanted, links, ids, dates).collect()] == ["02016R0679-1"]
    assert versions.lookup(wanted, spark.createDataFrame([], "base string, current string, next_version string, next_date string, error string")).first()["error"].endswith("no consolidation in the graph")


def test_freshness_is_three_valued(spark):
    rows = [("page-hash", 2, 1, 1, "moved"), ("page-hash", 2, 0, 1, "unreachable"), ("sitemap", 0, 0, 0, "fresh"), ("feed", 0, 0, 0, "unreachable"), ("feed", 2, 1, 0, "moved"), ("sitemap", 2, 1, 1, "unreachable")]
    got = spark.createDataFrame(rows, "tier string, n int, c int, f int, want string").select("want", freshness.decide(*(F.col(x) for x in ("tier", "n", "c", "f"))).alias("is")).collect()
    assert all(r["is"] == r["want"] for r in got)
    rows = [("v1", "v1", None, "fresh"), ("v2", "v1", None, "moved"), ("v1", None, None, "moved"), (None, "v1", None, "unreachable"), ("v1", "v1", "HTTP 500", "unreachable")]
    got = spark.createDataFrame(rows, "c string, l string, e string, want string").select("want", freshness.decide_version(F.col("c"), F.col("l"), F.col("e")).alias("is")).collect()
    assert all(r["is"] == r["want"] for r in got)


RESULTS = "id string, freshness string, version string, detail string, next_version string, known_next string, affects array<string>"


def test_filings_are_suppressed_while_open(spark):
    results = spark.createDataFrame([("a", "moved", "v2", "d", "v3", None, ["r"]), ("b", "unreachable", None, "e", None, None, []), ("c", "fresh", "v1", "", "v9", "v9", [])], RESULTS)
    none = spark.createDataFrame([], "kind string, source string, `to` string")
    first = freshness.filings(results, none)
    assert sorted((r["kind"], r["source"], r["to"]) for r in first.collect()) == [("source-moved", "a", "v2"), ("source-next", "a", "v3"), ("source-unreachable", "b", None)]
    assert freshness.filings(results, first.select("kind", "source", "to")).count() == 0
    assert tuple(freshness.run_report(results).first()) == (1, 1, 1, 1) and freshness.run_report(results.limit(0)).first()["exit"] == 2
    got = spark.createDataFrame([(3, 1, 0, False), (0, 0, 2, False)], "written int, skipped int, refused int, invalid boolean")
    assert tuple(freshness.fetch_report(got).first()) == (3, 1, 1)


def test_selection_and_stale_profile(spark):
    sources = spark.createDataFrame([("a", "confirmed", "feed"), ("b", "proposed", "feed"), ("c", "confirmed", "refuse")], "id string, status string, tier string")
    ids = lambda *a: sorted(r["id"] for r in freshness.selected(sources, *a).collect())
    assert ids(None) == ["a"] and ids(["b", "c"]) == ["b"] and ids(None, True) == ["a", "c"]
    assert freshness.profile_stale(True, True, False, "2024-01-01", "2024-01-02") and not freshness.profile_stale(True, True, False, "2024-01-02", "2024-01-02") and freshness.profile_stale(True, True, False, None, "x")


def test_first_items_and_affects(spark):
    items = spark.createDataFrame([("a", k) for k in range(100)] + [("b", 5)], "s string, i int")
    got = {r["s"]: (r["shown"], r["total"]) for r in freshness.first_items(items, "s", "i").collect()}
    assert got == {"a": (list(range(20)), 100), "b": ([5], 1)}
    listed = spark.createDataFrame([("r2", 1, "binds", ["s", "s"]), ("r1", 0, "undetermined", ["s", "t"]), ("r0", 2, "ruled-out", ["s"])], "id string, position int, status string, sources array<string>")
    assert {r["source"]: r["affects"] for r in freshness.affects(listed).collect()} == {"s": ["r1", "r2"], "t": ["r1"]}
    assert [r["source"] for r in freshness.affects(listed, spark.createDataFrame([("t",)], "id string")).collect()] == ["t"]


def answers(spark, values):
    return spark.createDataFrame([(s, json.dumps(v), st) for s, v, st in values], "slug string, value string, status string")


def test_profile_checks(spark):
    whole = [(d, 1, "confirmed") for d in DIMENSIONS]
    assert profile.checks(answers(spark, whole), F.lit(2)).count() == 0
    assert [r["blocks"] for r in profile.checks(answers(spark, whole), F.lit(1)).collect()] == [True]
    bad = [("establishment", None, "confirmed"), ("users", 1, "proposed"), ("size", 1, "odd"), ("role", None, "unanswered"), ("extra", 1, "confirmed"), *whole[5:12]]
    got = {r["problem"]: r["blocks"] for r in profile.checks(answers(spark, bad), F.lit(1)).collect()}
    assert got["establishment: confirmed but value is null"] and got["users: proposed, not confirmed"] is False and got["directed_activity: missing"] and got["extra: not a known dimension"] and got["role: unanswered"]
    assert any(k.startswith("attested while") and not b for k, b in got.items())


def test_drift_carries_forward_and_classifies(spark):
    snapshot = answers(spark, [("users", ["a"], ""), ("size", "small", ""), ("role", True, "")])
    now = answers(spark, [("users", [], "confirmed"), ("size", "big", "proposed"), ("role", 0, "confirmed")])
    current = profile.carried(now, snapshot)
    listed = spark.createDataFrame([("r1", "binds", 0, ["users: yes", "role"]), ("r2", "ruled-out", 1, ["users"]), ("r3", "undetermined", 2, ["users"])], "id string, status string, position int, triggered_by array<string>")
    got = sorted((r["slug"], r["kind"], r["affects"]) for r in profile.drift(profile.domain(spark), snapshot, current, profile.triggers(listed)).collect())
    assert got == [("role", "regime-new", ["r1"]), ("users", "regime-gone", ["r1"]), ("users", "regime-gone", ["r3"])]
    assert profile.drift(profile.domain(spark), current, current, profile.triggers(listed)).count() == 0


BODY = "intro\n- **You must:** lost\n\n## Obligations\n\n### A-1 · First thing\n- **You must:** do\n- **It says:** x\n- **You must:** do more\n### A-1 - Again\n- **You must:** y\n- **Odd:** z\n"
META = {"id": "r", "title": "t", "status": "binds", "jurisdiction": "nl", "sources": [{"id": "s"}], "confirmed_by": "me", "confirmed_at": "2024-01-01", "applies": {"quote": "q", "cite": "c"}}


def register(spark, metas):
    rows = spark.createDataFrame([(f"{m.get('file', m.get('id'))}.md", json.dumps({k: v for k, v in m.items() if k not in ("file", "body")}), m.get("body", "")) for m in metas], "path string, json string, body string")
    return rows.select("path", F.parse_json("json").alias("meta"), "body", F.get_json_object("json", "$.status").alias("status"))


def test_obligations_and_validation(spark):
    table = register(spark, [META | {"body": BODY}])
    found = regimes.obligations(table).orderBy("at").collect()
    assert [(r["id"], r["title"], r["fields"]) for r in found] == [("A-1", "First thing", {"You must": "do more", "It says": "x"}), ("A-1", "Again", {"You must": "y", "Odd": "z"})]
    got = {r["problem"] for r in regimes.validate(table, regimes.obligations(table)).collect()}
    assert got == {"obligations: duplicate id A-1", "A-1: unknown field 'Odd'"}
    row = regimes.counts(table, regimes.obligations(table)).first()
    assert (row["binds"], row["ruled_out"], row["obligations"], row["obligations_unclear"]) == (1, 0, 2, 1)


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"title": ""}, "title: required"), ({"status": "maybe"}, "status: must be one of ('binds', 'ruled-out', 'undetermined', 'no-longer-applies')"), ({"sources": ["nl"]}, "sources: must be a list of {id, version, retrieved}"),
        ({"applies": "text"}, "applies: must be a mapping"), ({"applies": {"quote": "q"}}, "applies: quote and cite are required when status is binds"), ({"status": "ruled-out"}, "exempt.reason: required when status is ruled-out"),
        ({"status": "ruled-out", "exempt": {"reason": "r"}, "body": BODY.split("### A-1 - ")[0]}, "obligations: a ruled-out regime must not list obligations"), ({"file": "other"}, "filename other.md does not match id r"),
    ],
)
def test_regime_rules(spark, change, problem):
    table = register(spark, [META | change])
    assert problem in {r["problem"] for r in regimes.validate(table, regimes.obligations(table)).collect()}
    fine = register(spark, [META])
    assert regimes.validate(fine, regimes.obligations(fine)).count() == 0


def test_scope_rule_is_three_valued(spark):
    rows = [(True, False, "binds"), (True, True, "ruled-out"), (False, None, "ruled-out"), (None, False, "undetermined"), (True, None, "undetermined"), (None, True, "ruled-out")]
    got = spark.createDataFrame(rows, "s boolean, e boolean, want string").select("want", regimes.status_of(F.col("s"), F.col("e")).alias("is")).collect()
    assert all(r["is"] == r["want"] for r in got)


def test_source_rules(spark):
    fine = {"id": "s", "url": "https://h.example/", "tier": "feed", "kind": "gazette", "status": "confirmed", "licence": {"redistribute": False}, "allowed_hosts": ["h.example"]}
    cases = {
        "a": {}, "b": {"tier": "x"}, "c": {"tier": "api"}, "d": {"adapter": "zz"}, "e": {"kind": "x"}, "f": {"status": "x"}, "g": {"licence": {}}, "h": {"url": "http://h.example/"}, "i": {"allowed_hosts": ["127.0.0.1"]},
        "j": {"tier": "api", "adapter": "eurlex", "config": {"celex": "1"}}, "k": {"tier": "api", "adapter": "eurlex", "config": {"celex": "32016R0679", "language": "XX"}},
    }
    table = spark.createDataFrame([(json.dumps(fine | {"id": k} | v),) for k, v in cases.items()], "j string").select(F.from_json("j", SOURCE).alias("s")).select("s.*")
    got = {}
    for r in validate.source_problems(validate.with_defaults(table)).collect():
        got.setdefault(r["id"], []).append(r["problem"])
    assert set(got) == set(cases) - {"a"} and all(len(v) == 1 for v in got.values())
    why = {r["id"]: r["why"] for r in validate.refusals(validate.with_defaults(table.where("id in ('a', 'f')")), True).collect()}
    assert set(why) == {"f"} and "required confirmation missing (status x)" in why["f"]


# --- search -----------------------------------------------------------------

DOCS = [("a.md", "other", "Privacy notice for users. Privacy matters."), ("b.md", "regime", "The notice period"), ("c.md", "other", ""), ("d.md", "other", "straße STRASSE 2024_x")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "path string, kind string, text string")


def test_tokens(spark):
    got = spark.createDataFrame([("The ÉCOLE a b2 I_x straße, ½²!",)], "t string").select(tx.tokenize(F.col("t"))).first()[0]
    assert got == ["école", "b2", "i_x", "strasse", "½²"]


def test_search_ranks_filters_and_repeats(spark):
    hits = search.search(docs(spark), "privacy notice", 5).collect()
    assert [h["path"] for h in hits] == ["a.md", "b.md"] and hits[0]["score"] > hits[1]["score"]
    only = search.search(docs(spark), "notice", 5, "regime").collect()
    whole = {h["path"]: h["score"] for h in search.search(docs(spark), "notice", 5).collect()}
    assert [(h["path"], h["score"]) for h in only] == [("b.md", whole["b.md"])]
    twice = search.search(docs(spark), "notice notice", 5).collect()
    assert all(abs(h["score"] - 2 * whole[h["path"]]) < 1e-5 for h in twice)
    assert search.search(docs(spark), "the of", 5).count() == 0 and search.search(docs(spark), "notice", 0).count() == 0
    assert search.search(docs(spark, []), "notice", 5).count() == 0
    with pytest.raises(ValueError):
        search.search(docs(spark), "notice", -1)


def test_snippets(spark):
    text = "x" * 100 + " needle\n\t and more " + "y" * 300
    got = search.with_snippets(search.search(docs(spark, [("a", "k", text)]), "needle", 1), docs(spark, [("a", "k", text)]), "needle").first()["snippet"]
    assert got == " ".join(text[41:201].split())


def test_index_is_kept_until_the_files_change(spark, tmp_path):
    index = search.Index(str(tmp_path / "index"))
    files = lambda d: d.select("path", F.octet_length("text").alias("size"), tx.content_hash(F.col("text")).alias("hash"))
    first = docs(spark)
    for query, kind in (("privacy notice", None), ("notice", "regime"), ("strasse strasse", None)):
        got = [tuple(r) for r in index.search(first, files(first), query, 5, kind).collect()]
        assert got == [tuple(r) for r in search.search(first, query, 5, kind).collect()]
    signed = search.signature(files(first)).first()
    more = docs(spark, [*DOCS, ("e.md", "other", "notice notice")])
    assert search.signature(files(more)).first() != signed and "e.md" in [r["path"] for r in index.search(more, files(more), "notice").collect()]


# --- streaming and status -----------------------------------------------------


def test_stream_replay_equals_the_batch(spark, tmp_path):
    folder, target = tmp_path / "log", str(tmp_path / "open")
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join(LINES))
    done = spark.createDataFrame([("chg-0001",)], "id string")
    stream.replay(spark, str(folder), done, target, str(tmp_path / "cp"))
    (folder / "2.jsonl").write_text('{"id": "chg-20000", "kind": "source-next", "severity": "info"}\n')
    stream.replay(spark, str(folder), done, target, str(tmp_path / "cp"))
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["chg-12345", "chg-20000", "x-9"]


def test_status_report(spark):
    table = register(spark, [META | {"body": BODY}])
    rep = status.report(answers(spark, []), table, regimes.obligations(table), lines(spark, LINES), lines(spark, ['{"id": "chg-0001"}', "bad"]), "2024-01-01").first().asDict()
    assert (rep["profile_problems"], rep["open"], rep["info"], rep["unreadable"], rep["obligations"]) == (15, 2, 1, 8, 2) and rep["profile_blocks"]
    assert "2 open" in status.render(rep) and RESOLUTION


def test_fences_headers_and_guards(spark):
    row = spark.createDataFrame([("a ```` b", {"content-type": "x"})], "t string, h map<string,string>").select(tx.fence(F.col("t")), tx.header_case(F.col("h")), validate.first_failure([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c")])).first()
    assert tuple(row) == ("`````", {"Content-Type": "x"}, "b")
    for path, kind in (("profile.md", "profile"), ("regimes/a.md", "regime"), ("mirror/x/y.md", "mirror"), ("z.md", "other")):
        assert spark.range(1).select(tx.kind_of(F.lit(path))).first()[0] == kind
