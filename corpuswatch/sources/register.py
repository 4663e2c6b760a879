"""The register's own files: source records, snapshots, manifests, staged overwrites."""

from __future__ import annotations

import json
import os
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.validate import with_defaults
from ..schema import SOURCE

SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


class RegisterError(ValueError):
    """A file that can't be read for what it should be."""


class UnsafePath(ValueError):
    """A name or path that could leave its folder."""


def safe_component(name: str) -> str:
    if not SAFE.fullmatch(name):
        raise UnsafePath(f"unsafe name: {name!r}")
    return name


def contained(base: str, target: str) -> str:
    root, path = Path(base).resolve(), (Path(base) / target).resolve()
    if path != root and root not in path.parents:
        raise UnsafePath(f"{target} resolves outside {base}")
    return str(path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source records of a register file, defaults filled in; a missing file has none, a malformed one is an error by name. Unknown fields are dropped by the schema."""
    if not os.path.isfile(path):
        return spark.createDataFrame([], SOURCE)
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as error:
        raise RegisterError(f"{path}: invalid JSON: {error}") from error
    rows = data.get("sources", []) if isinstance(data, dict) else None
    if not isinstance(rows, list) or not all(isinstance(r, dict) and all(isinstance(r.get(k), str) for k in ("id", "jurisdiction", "kind", "url")) for r in rows):
        raise RegisterError(f"{path}: must be an object with a list of sources")
    usual = {"tier": "page-hash", "status": "proposed", "delay_seconds": 10, "covers": "", "change_signal": "", "licence": {"redistribute": False}}
    full = [usual | r | ({"allowed_hosts": [r["allowed_hosts"]]} if isinstance(r.get("allowed_hosts"), str) else {}) for r in rows]
    text = spark.createDataFrame([(json.dumps(r),) for r in full], "value string")
    from pyspark.sql import functions as F

    return with_defaults(text.select(F.from_json("value", SOURCE).alias("s")).select("s.*"))


def read_snapshot(path: str) -> dict | None:
    """The stored answers, None if there are none yet; a corrupt file is refused by name and never reset."""
    if not os.path.isfile(path):
        return None
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(found, dict):
            raise ValueError("not a mapping")
    except (OSError, ValueError) as error:
        raise RegisterError(f"{path} is unreadable: {error}") from error
    return found


def write_json(path: str, value) -> None:
    """Staged and renamed, so a reader sees the old file or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    staged.write_text(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(staged, target)


def replace_table(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrites a table that ``df`` may itself read: written beside it, then moved into its place by the file system's rename."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged, old = (jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}.{x}") for x in ("staged", "old"))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(staged.toString())
    fs.delete(old, True)
    if fs.exists(path):
        fs.rename(path, old)
    fs.rename(staged, path)
    fs.delete(old, True)


def write_pages(pages: DataFrame, folder: str) -> None:
    """Mirror pages by visibility, jurisdiction and source, so that a source's pages are pruned to."""
    pages.write.mode("append").partitionBy("visibility", "jurisdiction", "source").parquet(folder)


def ensure_line(path: str, line: str) -> None:
    """``line`` in a text file, once."""
    target = Path(path)
    there = target.read_text(encoding="utf-8") if target.is_file() else ""
    if line not in there.splitlines():
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(there + ("\n" if there and not there.endswith("\n") else "") + line + "\n", encoding="utf-8")


def scaffold(folder: str) -> None:
    """The folders and ignore lines of a new register."""
    for name in ("regimes", "mirror"):
        os.makedirs(os.path.join(folder, name), exist_ok=True)
    ensure_line(os.path.join(folder, "mirror", ".gitignore"), "private/")
    ensure_line(os.path.join(folder, ".gitignore"), "search-index/")


def remove_table(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)
