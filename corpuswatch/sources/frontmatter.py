"""Markdown files with a YAML frontmatter block."""

from __future__ import annotations

import datetime as dt
import json
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FENCE = "---"


class FrontmatterError(ValueError):
    """A block that isn't closed, isn't YAML, or is no mapping."""


def split(text: str) -> tuple[str, str]:
    """(block, body) of a text; the block is empty where the text doesn't open with a fence."""
    if not text.startswith("---\n"):
        return "", text
    close = text.find("\n---\n", 3)
    if close >= 0:
        block, body = text[4:close], text[close + 5 :]
    elif (trimmed := text.rstrip("\n")).endswith("\n---"):
        block, body = text[4 : len(trimmed) - 4], ""
    else:
        raise FrontmatterError("frontmatter block is not terminated")
    return block, body.removeprefix("\n")


def _plain(value):
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def parse(text: str) -> tuple[dict, str]:
    """(meta, body); dates become ISO strings, once and for all."""
    import yaml

    block, body = split(text)
    try:
        meta = yaml.safe_load(block) or {}
    except yaml.YAMLError as error:
        raise FrontmatterError(f"invalid YAML in frontmatter: {error}") from error
    if not isinstance(meta, dict):
        raise FrontmatterError("frontmatter must be a mapping")
    return _plain(meta), body


def dump(meta: dict, body: str) -> str:
    import yaml

    return f"{FENCE}\n{yaml.safe_dump(meta, sort_keys=False, allow_unicode=True)}{FENCE}\n\n{body}"


def _row(text: str | None) -> dict:
    try:
        meta, body = parse(text or "")
        return {"meta": json.dumps(meta, ensure_ascii=False), "body": body, "error": None}
    except (FrontmatterError, ValueError, RecursionError) as error:
        return {"meta": None, "body": None, "error": f"unreadable: {error}"}


def parsed(text: Column) -> Column:
    """struct<meta (JSON), body, error>: one bad text is a row with an error, never a failed job."""

    def batch(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(t) for t in s], columns=["meta", "body", "error"])

    batch.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, "meta string, body string, error string")(text)


def list_files(root: str, suffix: str = ".md") -> list[str]:
    """Files below ``root`` in order, but for those whose own name starts with a dot; directories that do are entered."""
    return sorted(str(p) for p in Path(root).rglob(f"*{suffix}") if p.is_file() and not p.name.startswith("."))


def read(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path (relative), text, meta (variant), body, error of markdown files under ``root``.

    Files are listed first, as directory reads pass over hidden directories.
    """
    files = list_files(root) if recursive else sorted(str(p) for p in Path(root).glob("*.md"))
    if not files:
        return spark.createDataFrame([], "path string, text string, meta variant, body string, error string")
    base = os.path.abspath(root).rstrip("/") + "/"
    texts = spark.read.text([os.path.abspath(f) for f in files], wholetext=True)
    name = F.expr("url_decode(regexp_replace(_metadata.file_path, '^file:/*', '/'))")
    rows = texts.select(F.substring(name, len(base) + 1, 4096).alias("path"), F.col("value").alias("text"), parsed(F.col("value")).alias("p"))
    return rows.select("path", "text", F.try_parse_json("p.meta").alias("meta"), "p.body", "p.error")


def save(path: str, meta: dict, body: str) -> None:
    """One file, written beside its place and renamed into it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    try:
        staged.write_text(dump(meta, body), encoding="utf-8")
        os.replace(staged, target)
    finally:
        staged.unlink(missing_ok=True)
