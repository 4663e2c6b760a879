"""Scalar text functions as column expressions; the character classes are defined here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MIN_TERM, SNIPPET, SNIPPET_BEFORE, STOP_WORDS

#: Word characters and white space as Unicode has them, spelled out, as engines disagree on \w and \s.
WORD = r"[\p{L}\p{N}_]+"
SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
HTML_START = r"^(<!doctype html|<html|<head)"
PROLOG = r"^\x{FEFF}*\s*(?:<!--[\s\S]*?-->\s*)*(?:<\?xml[\s\S]*?\?>\s*(?:<!--[\s\S]*?-->\s*)*)?"


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss; other foldings beyond lower case are not made."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0))


def tokenize(text: Column) -> Column:
    """Folded words of two or more characters that are no stop words; the same for queries and documents."""
    return F.filter(words(F.coalesce(text, F.lit(""))), lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(*STOP_WORDS))  # a hash set


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def page_path(key: Column) -> Column:
    return F.concat(F.substring(F.sha1(key), 1, 16), F.lit(".md"))


def kind_of(path: Column) -> Column:
    """Kind of a document by its path in the register."""
    top = F.split_part(path, F.lit("/"), F.lit(1))
    return (
        F.when(path == "profile.md", "profile")
        .when((top == "regimes") & path.contains("/"), "regime")
        .when((top == "mirror") & path.contains("/"), "mirror")
        .otherwise("other")
    )


def snippet(text: Column, terms: Column) -> Column:
    """160 characters from up to 60 before the earliest of ``terms`` (from the start if there is none), white space collapsed."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - SNIPPET_BEFORE, F.lit(1))
    return collapse(F.substr(text, start, F.lit(SNIPPET)))


def looks_like_html(text: Column) -> Column:
    """Whether a body opens as an HTML document after a byte order mark, white space, comments and an XML declaration."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), PROLOG, "")
    return F.lower(F.substring(body, 1, 200)).rlike(HTML_START)


def main_region(html: Column) -> Column:
    """The first article's content, else the first main's, if not blank; else all."""
    pick = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}\s*>", 1)
    filled = lambda x: F.when(F.regexp_replace(x, SPACE, "") != "", x)
    return F.coalesce(filled(pick("article")), filled(pick("main")), html)


def age_days(iso: Column, today: str) -> Column:
    """Days from the date in the first ten characters to ``today``; null if there is none."""
    return F.datediff(F.lit(today).cast("date"), F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd"))


def iso_date(digits: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD."""
    return F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))


def product_token(agent: Column) -> Column:
    return F.lower(F.trim(F.split_part(agent, F.lit("/"), F.lit(1))))


def robots_regex(pattern: Column) -> Column:
    """An anchored regular expression of a robots pattern: * is anything, a $ at the end is the end."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|?+()\[\]{}*])", r"\\$1")
    anchored = F.regexp_replace(F.regexp_replace(quoted, r"\\\*", ".*"), r"\\\$$", "\\$")
    return F.concat(F.lit("^"), anchored)


def trigger_slug(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit(":"), F.lit(1)))


def log_id(n: Column) -> Column:
    return F.format_string("chg-%04d", n)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def host_allowed(url: Column, hosts: Column) -> Column:
    """Whether the URL's host is one of ``hosts``, an array; a URL without a host, or null, is not."""
    return F.coalesce((host(url) != "") & F.array_contains(hosts, host(url)), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path_and_query(url: Column) -> Column:
    """What robots rules are held against: path (/ if empty) and query."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def longest_run(text: Column, char: str = "`") -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"{char}+"), F.lit(0)), F.length)), F.lit(0))


def fence(body: Column) -> Column:
    """The shortest fence of backticks that the body can't close."""
    return F.repeat(F.lit("`"), F.greatest(longest_run(body) + 1, F.lit(3)))


def falsy(value: Column) -> Column:
    """Whether a JSON text is null, false, or empty; zero is not."""
    return F.coalesce(value.isin("null", "false", "[]", "{}", '""'), F.lit(True))


def header_case(headers: Column) -> Column:
    return F.transform_keys(headers, lambda k, _: F.array_join(F.transform(F.split(k, "-"), F.initcap), "-"))
