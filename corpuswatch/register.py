"""A register in a folder: the commands over its files, each a few operators and an append.

profile.md, regimes/*.md, sources.json, pending.jsonl, resolutions.jsonl,
profile.snapshot.json, last-check and mirror/ live under one folder. Dates come in as
arguments; what fetches pages is injected.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable
from datetime import date
from pathlib import Path
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .acquire import Run, host_of
from .functions import text as tx
from .operators import freshness, logs, manifest, profile, regimes, search, status, validate, versions
from .schema import DIMENSIONS, LOOKUP_BATCH, PENDING, RESOLUTION
from .sources import frontmatter
from .sources import register as files
from .sources.http import Fetcher, Refused, Unreachable, agent_of, network_opener

RESULT = "id string, freshness string, version string, detail string, next_version string, next_date string, known_next string, changed array<string>, changed_total long, affects array<string>"
#: What a version lookup asks of a graph endpoint: works that consolidate those of a batch, with their own numbers and dates.
LOOKUP = """PREFIX cdm: <http://publications.europa.eu/ontology/cdm#>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
SELECT ?work ?number ?day
WHERE {{
  ?act cdm:resource_legal_id_celex ?work .
  ?whole cdm:act_consolidated_consolidates_resource_legal ?act .
  OPTIONAL {{ ?whole cdm:resource_legal_id_celex ?number }}
  OPTIONAL {{ ?whole cdm:act_consolidated_date ?day }}
  VALUES ?work {{ {values} }}
}}"""


def default_fetcher(source: dict) -> Fetcher:
    return Fetcher(network_opener, agent_of((source.get("headers") or {}).get("user_agent")), source.get("delay_seconds") or 10)


def checked_date(text: str) -> str:
    """YYYY-MM-DD, or an error: dates are stored and compared as text."""
    try:
        return date.fromisoformat(text).isoformat()
    except (TypeError, ValueError) as error:
        raise ValueError(f"{text!r} is not a date (YYYY-MM-DD)") from error


class Register:
    """``fetcher`` makes a client for a source; ``api`` is (query endpoint, document prefix) of the api tier."""

    def __init__(self, spark: SparkSession, folder: str, fetcher: Callable[[dict], Fetcher] = default_fetcher, api: tuple[str, str] = ("", "")):
        self.spark, self.folder, self.fetcher, self.api = spark, folder.rstrip("/"), fetcher, api

    def path(self, name: str) -> str:
        return files.contained(self.folder, name)

    def init(self) -> None:
        files.scaffold(self.folder)
        if not os.path.exists(self.path("profile.md")):
            empty = {d: {"value": None, "status": "unanswered", "evidence": []} for d in DIMENSIONS}
            frontmatter.save(self.path("profile.md"), {"schema": 1, "confirmed_by": None, "confirmed_at": None, "answers": empty}, "")

    # --- logs -------------------------------------------------------------

    def lines(self, name: str) -> DataFrame:
        path = self.path(name)
        return self.spark.read.text(path) if os.path.isfile(path) else self.spark.createDataFrame([], "value string")

    def pending(self) -> DataFrame:
        return logs.entries(logs.read_lines(self.lines("pending.jsonl")), PENDING)

    def resolutions(self) -> DataFrame:
        return logs.entries(logs.read_lines(self.lines("resolutions.jsonl"), pending=False), RESOLUTION)

    def open(self) -> DataFrame:
        return logs.open_entries(self.pending(), self.resolutions())

    def _append(self, name: str, rows: list[dict]) -> None:
        with open(self.path(name), "a", encoding="utf-8", newline="\n") as file:
            file.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)

    def file(self, rows: DataFrame, order: list[str], today: str) -> int:
        """Appends log rows under new ids; a log is what people read, so a run adds few."""
        numbered = logs.with_ids(rows, order, self.pending(), self.resolutions()).collect()
        own = {"detected": today, "status": "pending"}
        self._append("pending.jsonl", [own | {k: v for k, v in r.asDict().items() if v is not None} for r in sorted(numbered, key=lambda r: (len(r["id"]), r["id"]))])
        return len(numbered)

    def resolve(self, id: str, action: str, by: str, today: str, note: str = "") -> str:
        """"ok", or why nothing was written."""
        today = checked_date(today)
        asked = self.spark.createDataFrame([(id, action)], "id string, action string")
        verdict = logs.guard_resolutions(asked, self.pending(), self.resolutions()).first()["verdict"]
        if verdict == "ok":
            self._append("resolutions.jsonl", [{"id": id, "resolved": today, "by": by, "action": action, "note": note}])
        return verdict

    # --- records ------------------------------------------------------------

    def regimes(self) -> DataFrame:
        read = frontmatter.read(self.spark, self.path("regimes"), recursive=False)
        text = lambda k: F.try_variant_get("meta", f"$.{k}", "string")
        ids = F.transform(F.try_variant_get("meta", "$.sources", "array<variant>"), lambda s: F.try_variant_get(s, "$.id", "string"))
        fired = F.transform(F.try_variant_get("meta", "$.applies.triggered_by", "array<variant>"), lambda t: F.coalesce(F.try_variant_get(t, "$", "string"), F.to_json(t)))
        slug = F.transform(fired, lambda t: F.regexp_extract(t, r'^(?:\{")?([^":{}]*)', 1))
        stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
        return read.select(
            "path", "meta", "body", "error", F.coalesce(text("id"), stem).alias("id"), F.coalesce(text("status"), F.lit("")).alias("status"), text("review_by").alias("review_by"),
            F.filter(ids, lambda i: i.isNotNull()).alias("sources"), slug.alias("triggered_by"), F.col("path").alias("position"),
        )

    def regime_problems(self) -> DataFrame:
        table = self.regimes()
        good = table.where("error is null")
        found = regimes.validate(good.select("path", "meta"), regimes.obligations(good))
        return found.unionByName(table.where("error is not null").select("path", F.col("error").alias("problem")))

    def _profile(self) -> dict:
        """The profile's fields. One that can't be read has none but says why under ``unreadable``, so that it stops no run over sources."""
        try:
            return frontmatter.parse(Path(self.path("profile.md")).read_text(encoding="utf-8"))[0]
        except (OSError, UnicodeDecodeError, frontmatter.FrontmatterError) as error:
            return {"unreadable": f"unreadable: {error}"}

    def answers(self, meta: dict | None = None) -> DataFrame:
        """slug, value (JSON), status of the answers that are mappings."""
        found = (self._profile() if meta is None else meta).get("answers")
        rows = [(str(k), json.dumps(v.get("value"), ensure_ascii=False, sort_keys=True), v.get("status") if isinstance(v.get("status"), str) else None) for k, v in (found if isinstance(found, dict) else {}).items() if isinstance(v, dict)]
        return self.spark.createDataFrame(rows, "slug string, value string, status string")

    def profile_problems(self) -> DataFrame:
        meta = self._profile()
        found = profile.checks(self.answers(meta), F.lit(sum(bool(meta.get(k)) for k in ("confirmed_by", "confirmed_at"))))
        if "unreadable" in meta:
            row = [(-1, meta["unreadable"], True)]
            found = found.unionByName(self.spark.createDataFrame(row, "ordinal int, problem string, blocks boolean"), allowMissingColumns=True)
        return found.orderBy("ordinal")

    def older_profile(self, against: str) -> dict:
        """The fields of a profile in a file, or of this one as a git reference has it."""
        if os.path.isfile(against):
            return frontmatter.parse(Path(against).read_text(encoding="utf-8"))[0]
        got = subprocess.run(["git", "show", "--end-of-options", f"{against}:./profile.md"], cwd=self.folder, capture_output=True, text=True, check=False)
        if got.returncode:
            raise files.RegisterError(got.stderr.strip() or f"cannot read {against}")
        return frontmatter.parse(got.stdout)[0]

    def profile_diff(self, against: str) -> list[str]:
        """Slugs whose value differs from that of an older profile (a file or a git reference), in order."""
        found = profile.diff(profile.domain(self.spark), self.answers(self.older_profile(against)), self.answers())
        return [r["slug"] for r in found.orderBy("ordinal").collect()]

    def sources(self) -> DataFrame:
        return files.read_sources(self.spark, self.path("sources.json"))

    def source_problems(self) -> DataFrame:
        return validate.source_problems(self.sources())

    def status(self) -> dict:
        good = self.regimes().where("error is null")
        last = self.path("last-check")
        checked = Path(last).read_text(encoding="utf-8").strip() if os.path.isfile(last) else None
        meta = self._profile()
        return status.report(self.answers(meta), good, regimes.obligations(good), self.lines("pending.jsonl"), self.lines("resolutions.jsonl"), checked).first().asDict()

    # --- search ---------------------------------------------------------------

    def search(self, query: str, k: int = 5, kind: str | None = None) -> DataFrame:
        """The best documents with snippets, from the stored index, which is made anew where files have changed."""
        docs = frontmatter.read(self.spark, self.folder).select("path", tx.kind_of(F.col("path")).alias("kind"), "text")
        sized = docs.select("path", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash"))
        hits = search.Index(self.path("search-index")).search(docs, sized, query, k, kind)
        return search.with_snippets(hits.where(~F.col("path").startswith("../") & ~F.col("path").contains("/../")), docs, query)

    # --- runs -------------------------------------------------------------------

    def _chosen(self, ids: list[str] | None, refuse: bool) -> tuple[list[dict], dict[str, str]]:
        chosen = freshness.selected(self.sources(), ids, refuse)
        refused = {r["id"]: r["why"] for r in validate.refusals(chosen, ids is not None).collect()}
        return [r.asDict(True) for r in chosen.collect()], refused

    def _manifest(self, source: dict) -> dict:
        try:
            found = json.loads(Path(self._mirror(source), "MANIFEST.json").read_text(encoding="utf-8"))
            return {k: v for k, v in found.items() if isinstance(v, dict)}
        except (OSError, ValueError, AttributeError):
            return {}

    def _mirror(self, source: dict) -> str:
        shown = "public" if (source["licence"] or {}).get("redistribute") is True else "private"
        return self.path(f"mirror/{shown}/{files.safe_component(source['jurisdiction'].lower())}/{files.safe_component(source['id'])}")

    def _stored(self, chosen: list[dict]) -> DataFrame:
        """The manifests' rows of the chosen sources."""
        texts = []
        for s in chosen:
            try:
                texts.append((s["id"], Path(self._mirror(s), "MANIFEST.json").read_text(encoding="utf-8")))
            except (OSError, UnicodeDecodeError):
                continue
        found = manifest.read_manifests(self.spark.createDataFrame(texts, "source_id string, value string"))
        return found.select(F.col("source_id").alias("source"), "key", "lastmod", "hash")

    def _run(self, chosen: list[dict]) -> Run:
        return Run(self.spark, chosen, self.fetcher)

    def _versions(self, sources: list[dict], today: str) -> dict[str, dict]:
        """What is in force and next of the api tier's works, asked for in batches; a failed batch's error is each member's."""
        works = sorted({(s["config"] or {}).get("celex") for s in sources if s["adapter"] == "eurlex"} - {None})
        out: dict[str, dict] = {}
        for k in range(0, len(works), LOOKUP_BATCH):
            batch = works[k : k + LOOKUP_BATCH]
            first = next(s for s in sources if (s["config"] or {}).get("celex") in batch)
            query = LOOKUP.format(values=" ".join(f'"{c}"^^xsd:string' for c in batch))
            try:
                hosts = [*(first["allowed_hosts"] or []), *host_of(self.api[0])]
                code, _, body, _ = self.fetcher(first).get(f"{self.api[0]}?{urlencode({'query': query, 'format': 'text/csv'})}", hosts)
                if code != 200:
                    raise Unreachable(f"lookup: HTTP {code}")
                rows = versions.of_base(versions.read_csv(self.spark, body.decode("utf-8", "replace"))).where(F.col("base").isin(batch))
                found = {r["base"]: r.asDict() for r in versions.current_and_next(versions.well_formed(rows), F.lit(today)).collect()}
                out |= {c: found.get(c, {"current": None, "next_version": None, "next_date": None}) for c in batch}
            except (Refused, Unreachable, ValueError) as error:
                out |= {c: {"error": str(error)} for c in batch}
        return out

    def _version_state(self, source: dict, known: dict[str, dict]) -> dict:
        now = known.get((source["config"] or {}).get("celex"), {"error": "no version number to look up"})
        if now.get("error") or not now["current"]:
            return {"freshness": "unreachable", "detail": now.get("error") or "no consolidation in the graph"}
        moved = now["current"] != source["last_version"]
        return {"freshness": "moved" if moved else "fresh", "version": now["current"], "next_version": now["next_version"], "next_date": now["next_date"], "changed": [now["current"]] * moved, "n_changed": int(moved), "detail": f"version {now['current']}"}

    def check(self, today: str, ids: list[str] | None = None) -> dict:
        """Did any source move? Files what is new and stores states, never versions."""
        today = checked_date(today)
        chosen, refused = self._chosen(ids, False)
        report = {"fresh": 0, "moved": 0, "unreachable": 0, "exit": 2 if refused or not chosen else 0, "details": dict(refused)}
        if chosen and not refused:
            known, run = self._versions(chosen, today), self._run(chosen)
            states = run.states(self._stored(chosen)) | {s["id"]: self._version_state(s, known) for s in chosen if s["adapter"] == "eurlex"}
            run.done()
            cited = {r["source"]: r["affects"] for r in freshness.affects(self.regimes()).collect()}
            names = [x.split()[0] for x in RESULT.split(", ")]
            looked = [{"id": s["id"], "known_next": s["next_version"], "affects": cited.get(s["id"], [])} | states[s["id"]] for s in chosen]
            rows = self.spark.createDataFrame([tuple((r | {"changed": r.get("changed") or [], "changed_total": r.get("n_changed") or 0}).get(c) for c in names) for r in looked], RESULT)
            counts = freshness.run_report(rows).first().asDict()
            report |= counts | {"details": {r["id"]: r["detail"] for r in looked}}
            open_now = self.open().select("kind", "source", "to", "affects")
            stale = open_now.where("kind = 'profile-stale'").count() > 0
            filed = freshness.filings(rows, open_now.select("kind", "source", "to"))
            lists = rows.select(F.col("id").alias("source"), "changed", "changed_total")
            moved = filed.join(lists, "source").withColumns({c: F.when(F.col("kind") == "source-moved", F.col(c)) for c in ("changed", "changed_total")})
            self.file(moved, ["source", "kind"], today)
            self._store_sources({r["id"]: {"last_checked": today, "last_status": r["freshness"]} | ({"next_version": r["next_version"]} if r.get("next_version") else {}) for r in looked})
            Path(self.path("last-check")).write_text(today + "\n", encoding="utf-8")
            meta = self._profile()
            if freshness.profile_stale(counts["moved"] > 0, "unreadable" not in meta, stale, str(meta.get("confirmed_at") or "") or None, today):
                self.file(self.spark.createDataFrame([("profile-stale", "info", "a source moved since the profile was confirmed")], "kind string, severity string, summary string"), ["kind"], today)
        if not refused:
            due = freshness.dates_passed(self.regimes(), self.open(), today)
            self.file(due.select(F.lit("date-passed").alias("kind"), F.lit("major").alias("severity"), F.array("id").alias("affects"), F.concat("id", F.lit(": review date "), "review_by", F.lit(" has passed")).alias("summary")), ["summary"], today)
        return report

    def _store_sources(self, changes: dict[str, dict]) -> None:
        path = self.path("sources.json")
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        for row in data["sources"]:
            row.update(changes.get(row["id"], {}))
        files.write_json(path, data)

    def fetch(self, today: str, ids: list[str] | None = None, force: bool = False) -> dict:
        """Brings the mirror up to date; a source's manifest keeps what was written before it failed."""
        today = checked_date(today)
        chosen, refused = self._chosen(ids, True)
        report = {"written": 0, "skipped": 0, "refused": sorted(refused), "details": dict(refused), "exit": 2 if refused else 0}
        if refused:
            return report
        never = sorted(s["id"] for s in chosen if s["tier"] == "refuse")
        report["refused"] += never
        report["exit"] = 2 if never and ids else report["exit"]
        chosen = [s for s in chosen if s["tier"] != "refuse"]
        done = {s["id"]: {"written": 0, "skipped": 0, "refused": [], "version": None} for s in chosen}
        stored, run = {s["id"]: self._manifest(s) for s in chosen}, self._run(chosen)
        try:
            self._acquire(run, chosen, stored, done, today, force)
            self._acquire_articles(chosen, stored, done, self._versions(chosen, today), today, force)
        finally:  # what was written counts, whatever came after
            run.done()
            for s in chosen:
                files.write_json(f"{self._mirror(s)}/MANIFEST.json", stored[s["id"]])
        for id, d in done.items():
            report["written"] += d["written"]
            report["skipped"] += d["skipped"]
            if d["refused"]:
                report["details"][id] = d["refused"]
                report["exit"] = max(report["exit"], 1)
        lost = [(id, "fetch refused: " + "; ".join(d["refused"])) for id, d in done.items() if d["refused"]]
        if lost:
            rows = self.spark.createDataFrame(lost, "source string, summary string").select(F.lit("source-unreachable").alias("kind"), F.lit("info").alias("severity"), "source", "summary")
            self.file(logs.suppress(rows, self.open(), ["kind", "source"]), ["source"], today)
        changes = {id: {"last_fetched": today} | ({"last_version": d["version"]} if d["version"] else {}) for id, d in done.items() if d["written"]}
        if changes:
            self._store_sources(changes)
        return report

    def _acquire(self, run: Run, chosen: list[dict], stored: dict, done: dict, today: str, force: bool) -> None:
        """Pages come back one partition at a time and are written to the folder one by one."""
        by = {s["id"]: s for s in chosen}
        if not run.of(lambda a: a.kind != "version"):
            return
        rows, skipped, failed = run.wanted(self._stored(chosen), force)
        for r in rows.toLocalIterator():
            self._page(by[r["source"]], r["path"], {"source_url": r["url"], "lastmod": r["lastmod"], "title": r["title"]}, r["markdown"], r["hash"], today)
            stored[r["source"]][r["key"]] = {"fetched": today, "lastmod": r["lastmod"], "hash": r["hash"], "path": r["path"], "version": None}
            done[r["source"]]["written"] += 1
        for r in skipped.collect():  # a row a source
            done[r["source"]]["skipped"] = r["skipped"]
        for r in failed.orderBy("source", "error").toLocalIterator():
            done[r["source"]]["refused"].append(r["error"])

    def _page(self, source: dict, name: str, meta: dict, text: str, digest: str, today: str) -> None:
        licence = source["licence"] or {}
        base = {"source": source["id"], "source_url": source["url"], "retrieved_at": today, "content_hash": digest, "licence_name": licence.get("name"), "attribution": licence.get("attribution")}
        frontmatter.save(files.contained(self._mirror(source), name), base | {k: v for k, v in meta.items() if v is not None}, text)

    def _acquire_articles(self, chosen: list[dict], stored: dict, done: dict, known: dict, today: str, force: bool) -> None:
        """The articles of versions that aren't stored yet, each with the text's banner."""
        by, current = {s["id"]: s for s in chosen if s["adapter"] == "eurlex"}, {}
        for id, source in by.items():
            now = known.get((source["config"] or {}).get("celex"), {"error": "no version number to look up"})
            if now.get("error") or not now["current"]:
                done[id]["refused"].append(f"resolve: {now.get('error') or 'no consolidation in force'}")
            elif now["current"] == source["last_version"] and not force:
                done[id]["skipped"] += 1
            else:
                current[id] = now["current"]
        if not current:
            return
        run = Run(self.spark, list(by.values()), self.fetcher, host_of(self.api[1]))
        try:
            parts, failed = run.consolidated(current, self.api[1])
            for r in failed.collect():  # a row a source at most
                done[r["source"]]["refused"].append(r["error"])
            banner = F.concat(F.lit("> Converted from HTML and split by article; only the official text is authentic. Source: "), "url", F.lit("\n\n"))
            day = tx.iso_date(F.split_part("version", F.lit("-"), F.lit(2)))
            whole = parts.withColumn("text", F.concat(banner, "markdown")).withColumn("hash", tx.content_hash(F.col("text"))).withColumn("day", day)
            for r in whole.orderBy("source", "number").toLocalIterator():
                name, key = f"{r['version']}/art_{r['number']}.md", f"{r['url']}#art_{r['number']}"
                source = by[r["source"]]
                self._page(source, name, {"source_url": key, "consolidated_date": r["day"], "language": r["lang"], "article": r["number"], "authentic_url": source["url"]}, r["text"], r["hash"], today)
                stored[r["source"]][key] = {"fetched": today, "lastmod": r["day"], "hash": r["hash"], "path": name, "version": r["version"]}
                done[r["source"]]["written"] += 1
                done[r["source"]]["version"] = r["version"]
        finally:
            run.done()

    def rescan(self, today: str) -> dict:
        """What changed in the confirmed answers since the last scan, filed by the regimes it touches."""
        today = checked_date(today)
        blocking = [r["problem"] for r in self.profile_problems().where("blocks").collect()]
        if blocking:
            return {"changed": [], "entries": 0, "error": "; ".join(blocking), "exit": 2}
        before = files.read_snapshot(self.path("profile.snapshot.json"))
        kept = self.spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False, sort_keys=True)) for k, v in (before or {}).items()], "slug string, value string")
        current = profile.carried(self.answers(), kept)
        found: list = []
        if before is not None:
            listed = profile.triggers(self.regimes().where("triggered_by is not null"))
            drift = profile.drift(profile.domain(self.spark), kept, current, listed)
            found = drift.collect()
            says = F.concat("slug", F.when(F.col("kind") == "regime-gone", " is no longer true").otherwise(" changed"))
            self.file(drift.select("ordinal", "kind", "severity", "affects", says.alias("summary")).drop("ordinal"), ["summary", "kind"], today)
        files.write_json(self.path("profile.snapshot.json"), {r["slug"]: json.loads(r["value"]) for r in current.collect() if r["slug"] in DIMENSIONS and r["value"] is not None})
        return {"changed": list(dict.fromkeys(r["slug"] for r in found)), "entries": len(found), "exit": 0}
