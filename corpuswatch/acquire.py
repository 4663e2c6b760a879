"""What a run reads of its sources: listings and pages fetched by the executors, and their state against what is stored.

All sources of a run are one plan. Pages are dealt by host, so that one task
has all of a host's pages and waits between them; what comes back is parsed,
converted and hashed where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .functions import html as hx
from .functions import text as tx
from .operators import freshness, manifest, validate
from .schema import CHANGED_SHOWN, LISTING_BYTES, LISTING_CHILDREN, LISTING_PAGES
from .sources import listings

ASKED = "source string, key string, url string, position long, lastmod string, title string"
FETCHED = f"{ASKED}, status int, type string, body string, error string"
#: Fixed value: how a consolidated text's header line names version, language and date.
HEADER = r"(?<!\d)(0\d{4}[A-Z]{1,2}\d{4}) — ([A-Z]{2}) — (\d{2})\.(\d{2})\.(\d{4})"


@dataclass(frozen=True)
class Adapter:
    """How a source is read. ``kind``: its rule of freshness; ``listing``: the kind of listing that its URL gives, if any; ``children``: whether that may be an index of others; ``hashed``: whether a page's content tells its change."""

    kind: str
    listing: str | None = None
    children: bool = False
    hashed: bool = False


ADAPTERS = {
    "sitemap": Adapter("sitemap", "sitemap", children=True),
    "feed": Adapter("feed", "feed"),
    "pagehash": Adapter("page-hash", hashed=True),
    "eurlex": Adapter("version"),
}


class Run:
    """``chosen``: the sources as dictionaries; ``make`` gives a client for one; ``hosts``: hosts that each may use besides its own."""

    def __init__(self, spark: SparkSession, chosen: list[dict], make: Callable, hosts: tuple[str, ...] = ()):
        self.spark, self.chosen, self.make, self.hosts, self.kept = spark, chosen, make, hosts, []
        self.notes = spark.createDataFrame([], "source string, note string")  # of listings that were cut at a cap

    def done(self) -> None:
        for df in self.kept:
            df.unpersist()

    def keep(self, df: DataFrame) -> DataFrame:
        """Requests are made once, though several results follow from them."""
        self.kept.append(df.persist())
        return self.kept[-1]

    def of(self, test: Callable[[Adapter], bool]) -> list[dict]:
        return [s for s in self.chosen if test(ADAPTERS[s["adapter"]])]

    def asked(self, rows: list[tuple[str, str]]) -> DataFrame:
        return self.spark.createDataFrame([(source, url, url, k, None, None) for k, (source, url) in enumerate(rows)], ASKED)

    def fetched(self, asked: DataFrame, budget: int | None = None, headers: dict[str, dict] | None = None) -> DataFrame:
        """``asked`` with status, content type and body, or an error, which is its row's alone."""
        own, make, more, headers = {s["id"]: s for s in self.chosen}, self.make, self.hosts, headers or {}
        schema = to_arrow_schema(StructType.fromDDL(FETCHED))

        def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clients, seen = {}, set()
            for batch in batches:
                rows = batch.select([f.name for f in schema][:6]).to_pylist()
                for r in rows:
                    source = own[r["source"]]
                    if source["id"] not in clients:
                        clients[source["id"]] = make(source)
                        clients[source["id"]].seen = seen  # one host's sources wait for each other
                    r |= {"status": None, "type": None, "body": None, "error": None}
                    try:
                        hosts = [*(source["allowed_hosts"] or []), *more]
                        r["status"], got, body, _ = clients[source["id"]].get(r["url"], hosts, headers.get(source["id"]), budget)
                        r["type"], r["body"] = got.get("Content-Type", ""), body.decode("utf-8", "replace")
                    except Exception as error:  # noqa: BLE001  a source that fails is unreachable, and the others go on
                        r["error"] = f"{type(error).__name__}: {error}"
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        dealt = asked.withColumn("host", tx.host(F.col("url"))).repartition("host").sortWithinPartitions("host", "source", "position")
        return self.keep(dealt.mapInArrow(get, FETCHED))

    # --- listings -------------------------------------------------------------

    def listed(self) -> tuple[DataFrame, DataFrame]:
        """What the chosen sitemaps and feeds list (``ASKED``), and (source, error) of listings that can't be read: those sources list nothing for sure."""
        sources = self.of(lambda a: a.listing is not None)
        rules = [(s["id"], ADAPTERS[s["adapter"]].listing, ADAPTERS[s["adapter"]].children, (s["config"] or {}).get("include") or []) for s in sources]
        if not rules:
            return self.asked([]), self.spark.createDataFrame([], "source string, error string")
        by = F.broadcast(self.spark.createDataFrame(rules, "source string, wants string, nests boolean, include array<string>"))  # a row a source
        first, lost = self._read(self.fetched(self.asked([(s["id"], s["url"]) for s in sources]), LISTING_BYTES))
        below = first.join(by, "source").where("nests and listing.kind = 'index'").select("source", F.posexplode(F.slice("listing.children", 1, LISTING_CHILDREN)).alias("position", "url"))
        none = F.lit(None).cast("string")
        below = below.select("source", F.col("url").alias("key"), "url", F.col("position").cast("long"), none.alias("lastmod"), none.alias("title"))
        second, lost_below = self._read(self.fetched(below, LISTING_BYTES))
        files = first.withColumn("part", F.lit(-1).cast("long")).unionByName(second.withColumn("part", F.col("position")))
        items = files.join(by, "source").where("listing.kind = wants").select("source", "include", "part", F.posexplode("listing.items").alias("at", "x"))
        items = items.where((F.size("include") == 0) | F.exists("include", lambda p: F.col("x.link").startswith(p)))
        items = listings.capped(items, "source", ["part", "at"])
        rows = items.select("source", F.col("x.id").alias("key"), F.col("x.link").alias("url"), (F.col("part") * (1 << 32) + F.col("at")).alias("position"), F.col("x.date").alias("lastmod"), F.col("x.title").alias("title"))
        self.notes = self._caps(first.join(by, "source"), items)
        once = rows.groupBy("source", "key").agg(F.min(F.struct("position", "url", "lastmod", "title")).alias("x")).select("source", "key", "x.url", "x.position", "x.lastmod", "x.title")
        return self.keep(once), lost.unionByName(lost_below)

    def _caps(self, first: DataFrame, items: DataFrame) -> DataFrame:
        n = F.size("listing.children")
        wide = first.where("nests and listing.kind = 'index'").where(n > LISTING_CHILDREN).select("source", F.concat(F.lit("index lists "), n.cast("string"), F.lit(f" sitemaps, capped at {LISTING_CHILDREN}")).alias("note"))
        long = items.where(F.col("listed") > LISTING_PAGES).groupBy("source").agg(F.lit(f"listing exceeds {LISTING_PAGES} pages, capped").alias("note"))
        return wide.unionByName(long)

    def _read(self, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
        files = self.keep(listings.parsed(fetched.where("status = 200").select("source", "position", "body")))
        why = F.coalesce("error", F.concat("url", F.lit(": HTTP "), F.col("status").cast("string")))
        lost = fetched.where("status is null or status <> 200").select("source", why.alias("error"))
        return files, lost.unionByName(files.where("listing.error is not null").select("source", F.col("listing.error").alias("error")))

    # --- pages ------------------------------------------------------------------

    def page_urls(self) -> DataFrame:
        """The pages of sources that are told by their content."""
        return self.asked([(s["id"], u) for s in self.of(lambda a: a.hashed) for u in (s["config"] or {}).get("urls") or [s["url"]]])

    def pages(self, asked: DataFrame) -> DataFrame:
        """``asked`` with markdown and hash, or why there is none."""
        got = self.fetched(asked)
        usable = (F.col("status") == 200) & tx.looks_like_html(F.col("body"))
        text = F.when(usable, hx.markdown_column(F.when(usable, F.col("body")), F.col("url")))
        found = got.select(*asked.columns, "status", text.alias("markdown"), "error")
        why = F.when(F.col("markdown").isNull(), F.concat("url", F.lit(": "), F.coalesce("error", F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"))), F.lit("not html"))))
        return self.keep(found.withColumn("error", why).withColumn("hash", tx.content_hash(F.col("markdown"))))

    # --- states -----------------------------------------------------------------

    def states(self, stored: DataFrame) -> dict[str, dict]:
        """Per source that isn't told by its version: freshness, detail, and the first changed keys. ``stored``: manifest rows (source, key, lastmod, hash)."""
        kinds = [(s["id"], ADAPTERS[s["adapter"]].kind) for s in self.of(lambda a: a.kind != "version")]
        if not kinds:
            return {}
        listed, lost = self.listed()
        pages = self.pages(self.page_urls())
        items = listed.select("source", "key", "lastmod", F.lit(None).cast("string").alias("hash")).unionByName(pages.where("error is null").select("source", "key", F.lit(None).cast("string").alias("lastmod"), "hash"))
        lost = lost.unionByName(pages.where("error is not null").select("source", "error"))
        sources = self.spark.createDataFrame(kinds, "source string, kind string")
        seen = manifest.compare(items, stored, ["source", "key"], "lastmod", "hash").join(F.broadcast(sources), "source")
        seen = self.keep(seen.withColumn("changed", F.when(F.col("kind") == "feed", ~F.col("known")).otherwise(F.col("changed"))))
        counts = seen.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"))
        shown = freshness.first_items(seen.where("changed"), "source", "key", CHANGED_SHOWN).select("source", F.col("shown").alias("changed"))
        why = freshness.first_items(lost, "source", "error", CHANGED_SHOWN).select("source", F.array_join("shown", "; ").alias("why"), F.col("total").alias("n_failed"))
        notes = self.notes.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("note")), "; ").alias("note"))  # two a source at most
        whole = sources.join(counts, "source", "left").join(shown, "source", "left").join(why, "source", "left").join(notes, "source", "left").fillna(0, ["n", "n_changed", "n_failed"])
        state = freshness.decide(F.col("kind"), F.col("n"), F.col("n_changed"), F.col("n_failed"))
        detail = F.concat(F.col("n_changed").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" changed"), F.coalesce(F.concat(F.lit(" ("), "note", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit("; unreachable: "), "why"), F.lit("")))
        rows = whole.select("source", state.alias("freshness"), detail.alias("detail"), F.coalesce("changed", F.array().cast("array<string>")).alias("changed"), "n_changed")
        return {r["source"]: r.asDict() for r in rows.collect()}  # a row a source

    def wanted(self, stored: DataFrame, force: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pages that differ from what is stored, with markdown; (source, skipped); (source, error)."""
        listed, lost = self.listed()
        feeds = [s["id"] for s in self.of(lambda a: a.kind == "feed")]
        seen = manifest.compare(listed, stored, ["source", "key"])
        stale = F.lit(force) | F.when(F.col("source").isin(feeds), ~F.col("known")).otherwise(F.col("changed"))
        seen = self.keep(seen.withColumn("stale", stale))
        got = self.pages(seen.where("stale").select(*listed.columns).unionByName(self.page_urls()))
        hashed = [s["id"] for s in self.of(lambda a: a.hashed)]
        fresh = manifest.compare(got.where("error is null"), stored, ["source", "key"], None, "hash")
        fresh = self.keep(fresh.withColumn("same", F.lit(not force) & F.col("source").isin(hashed) & ~F.col("changed")))
        skipped = seen.where("not stale").select("source").unionByName(fresh.where("same").select("source")).groupBy("source").agg(F.count(F.lit(1)).alias("skipped"))
        failed = got.where("error is not null").select("source", F.col("url").alias("error"))
        rows = fresh.where("not same").select("source", "key", "url", "lastmod", "title", "markdown", "hash", tx.page_path(F.col("key")).alias("path"))
        return rows, skipped, lost.unionByName(failed).unionByName(self.notes.select("source", F.concat(F.lit("listing: "), "note").alias("error")))

    def consolidated(self, current: dict[str, str], prefix: str) -> tuple[DataFrame, DataFrame]:
        """Articles (source, url, version, lang, number, markdown) of the versions in ``current`` by source, and (source, error) of pages that a guard refuses."""
        langs = {s["id"]: ((s["config"] or {}).get("language") or "EN").upper() for s in self.chosen if s["id"] in current}
        asked = self.asked([(k, f"{prefix}/{v}") for k, v in current.items()])
        headers = {k: {"Accept": "application/xhtml+xml", "Accept-Language": lang.lower()} for k, lang in langs.items()}
        known = self.spark.createDataFrame([(k, v, langs[k]) for k, v in current.items()], "source string, version string, lang string")
        got = self.fetched(asked, headers=headers).join(F.broadcast(known), "source")
        guard = F.coalesce("error", article_guard(F.col("status"), F.col("type"), F.col("body"), F.col("version"), F.col("lang")))
        got = self.keep(got.withColumn("guard", guard))
        parts = got.where("guard is null").select("source", "url", "version", "lang", F.explode(hx.articles_column(F.col("body"))).alias("a"))
        return parts.select("source", "url", "version", "lang", "a.number", "a.markdown"), got.where("guard is not null").select("source", F.col("guard").alias("error"))


def article_guard(status: Column, kind: Column, html: Column, current: Column, lang: Column) -> Column:
    """The first of five structural checks that a consolidated page fails, null if none."""
    part = lambda k: F.regexp_extract(html, HEADER, k)
    version, day = F.split_part(current, F.lit("-"), F.lit(1)), F.split_part(current, F.lit("-"), F.lit(2))
    numbers = F.transform(F.regexp_extract_all(html, F.lit(r'id="art_(\d+)"'), F.lit(1)), lambda n: n.cast("int"))
    rising = F.forall(F.sequence(F.lit(1), F.size(numbers) - 1), lambda k: F.get(numbers, k - 1) < F.get(numbers, k))
    return validate.first_failure(
        [
            ((status == 200) & kind.rlike(r"^(text/html|application/xhtml\+xml)"), "G1: the answer is no HTML page"),
            (html.contains('class="disclaimer"'), "G2: there is no disclaimer block"),
            (F.size(numbers) > 0, "G3: no article is marked"),
            ((part(1) == version) & (part(2) == lang) & (F.concat(part(5), part(4), part(3)) == day), "G4: the header names another text, language or date"),
            ((F.size(numbers) == 1) | rising, "G5: article numbers repeat or fall"),
        ]
    )


def host_of(url: str) -> tuple[str, ...]:
    return (host,) if (host := urlsplit(url).hostname) else ()
