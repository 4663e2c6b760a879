"""Types and fixed domains of the register."""

from __future__ import annotations

# Fixed values.
TIERS = ("api", "sitemap", "feed", "page-hash", "refuse")
SOURCE_KINDS = ("legislation", "gazette", "regulator", "contract", "standard")
SOURCE_STATUSES = ("proposed", "confirmed", "unresolved")
FRESHNESS = ("fresh", "unreachable", "moved")
ADAPTERS = ("eurlex", "sitemap", "feed", "pagehash")
ADAPTER_OF_TIER = {"sitemap": "sitemap", "feed": "feed", "page-hash": "pagehash"}
REGIME_STATUSES = ("binds", "ruled-out", "undetermined", "no-longer-applies")
WATCHED = ("binds", "undetermined")
REGIME_REQUIRED = ("id", "title", "status", "jurisdiction", "sources", "confirmed_by", "confirmed_at")
OBLIGATION_KEYS = ("When", "You must", "How often", "It says", "You'd know by", "Note")
ANSWER_STATUSES = ("unanswered", "proposed", "confirmed")
LOG_KINDS = ("source-moved", "source-unreachable", "source-next", "regime-new", "regime-gone", "date-passed", "profile-stale")
SEVERITIES = ("major", "minor", "info")
ACTIONS = ("applied", "dismissed", "deferred")
DIMENSIONS = (
    "establishment", "directed_activity", "users", "legal_form", "size", "sector", "licences", "exchanged", "money_flow", "personal_data",
    "third_parties", "third_party_content", "role", "automation_ai", "time_change",
)
STOP_WORDS = tuple(
    "a an the of to in for on and or is are be was were it its this that with as at by from how do i my we our you your can could what"
    " when where which not no if then than there here about into over under".split()
)
LANGUAGES = {
    "BG": "BUL", "CS": "CES", "DA": "DAN", "DE": "DEU", "EL": "ELL", "EN": "ENG", "ES": "SPA", "ET": "EST", "FI": "FIN", "FR": "FRA", "GA": "GLE", "HR": "HRV",
    "HU": "HUN", "IT": "ITA", "LT": "LIT", "LV": "LAV", "MT": "MLT", "NL": "NLD", "PL": "POL", "PT": "POR", "RO": "RON", "SK": "SLK", "SL": "SLV", "SV": "SWE",
}
LISTING_PAGES, LISTING_CHILDREN = 2000, 50
LISTING_BYTES, BODY_BYTES, ROBOTS_BYTES = 5_000_000, 20_000_000, 200_000
LOOKUP_BATCH, CHANGED_SHOWN = 100, 20
K1, B, MIN_TERM = 1.5, 0.75, 2
SNIPPET_BEFORE, SNIPPET = 60, 160

SOURCE = (
    "id string, jurisdiction string, kind string, url string, covers string, tier string, adapter string,"
    " config struct<celex:string, language:string, urls:array<string>, include:array<string>>, change_signal string,"
    " licence struct<name:string, redistribute:boolean, attribution:string>, allowed_hosts array<string>, headers map<string,string>,"
    " delay_seconds int, status string, last_checked string, last_status string, last_version string, next_version string,"
    " last_fetched string, evidence array<string>"
)
PENDING = (
    "id string, detected string, kind string, severity string, source string, affects array<string>, summary string, status string,"
    " `from` string, `to` string, changed array<string>, changed_total int, effective string"
)
RESOLUTION = "id string, resolved string, `by` string, action string, note string"
MANIFEST = "source_id string, key string, fetched string, lastmod string, hash string, path string, version string"
LISTING = "loc string, lastmod string"
FEED = "id string, title string, published string, link string"
VERSIONS = "base string, version string, date string"
ROBOTS = "host string, agent string, allow boolean, pattern string"
ROUTE = "route string, is_prefix boolean, status int, headers map<string,string>, body binary"
