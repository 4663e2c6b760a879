"""Literals and SQL fragments that several registered queries share."""

from __future__ import annotations

from ..schema import STOP_WORDS

TODAY = "1999-06-30"
QUERY = "ouble eaux lich thea"
WORD = r"[\p{L}\p{N}_]+"
#: White space of the driver's texts, which hold none beyond ASCII.
BLANK = r"[\x09-\x0d\x1c-\x20]+"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tok(text: str) -> str:
    words = f"regexp_extract_all(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '{WORD}')"
    return f"list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w))"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANK}', ' ', 'g'))"


def hashed(text: str) -> str:
    return f"sha256({collapsed(text)})"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
