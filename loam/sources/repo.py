"""Repositories as tables: a walk on the driver finds the paths, executors read the contents.

Spark's own binary source leaves out names that begin with an underscore or a dot, so the paths become rows
and one Arrow stage reads the bytes of those that are still wanted; filters before it cost no reading.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.gitignore import IgnoreFile, ignored, include_matcher

BUILT_IN = (".git", "target", "__pycache__")


def encode_path(raw: bytes) -> str:
    """Path bytes as text, lossless: percent, backslash and bytes that are no UTF-8 become %XX."""
    out = ""
    for piece in raw.decode("utf-8", "surrogateescape"):
        if piece in "%\\":
            out += f"%{ord(piece):02X}"
        elif 0xDC80 <= ord(piece) <= 0xDCFF:
            out += f"%{ord(piece) - 0xDC00:02X}"
        else:
            out += piece
    return out


def walk(root: str, include: list[str] | None = None, exact: bool = False) -> list[tuple[str, str, str]]:
    """(path, entry, state) of a repository, sorted by components.

    entry is file, directory or builtin_directory; state is standard, included (ignored but let back in),
    ignored, or unreadable for folders that can't be entered.  Hidden files count, symbolic links are not followed.  Ignored directories are named but not
    entered, unless ``exact`` or include patterns ask for their contents.
    """
    wanted = include_matcher(include or [])
    out: list[tuple[str, str, str]] = []

    todo: list[tuple[str, str, list[IgnoreFile], bool]] = [(root, "", [], False)]

    def visit(directory: str, rel: str, rules: list[IgnoreFile], hidden: bool) -> None:
        try:
            with os.scandir(directory) as it:
                entries = sorted(it, key=lambda e: os.fsencode(e.name))
        except PermissionError:
            if not rel:
                raise
            out.append((rel, "directory", "unreadable"))
            return
        own = next((e for e in entries if e.name == ".gitignore" and e.is_file(follow_symlinks=False)), None)
        if own is not None and not hidden:
            rules = [*rules, IgnoreFile(Path(own.path).read_text("utf-8", "replace"), rel)]
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name in BUILT_IN:
                    out.append((path, "builtin_directory", "ignored"))
                    continue
                under = hidden or ignored(path, True, rules)
                if under and not hidden or under and exact:
                    out.append((path, "directory", "ignored"))
                if not under or exact or wanted is not None:
                    todo.append((e.path, path, rules, under))
            elif e.is_file(follow_symlinks=False):
                if hidden or ignored(path, False, rules):
                    if wanted is not None and wanted.match(path):
                        out.append((path, "file", "included"))
                    elif exact or not hidden:
                        out.append((path, "file", "ignored"))
                else:
                    out.append((path, "file", "standard"))

    while todo:
        visit(*todo.pop())
    return sorted(out, key=lambda r: r[0].split("/"))


def inventory(spark: SparkSession, root: str, include: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Entries as (root, raw, path, entry, state): raw are the path's bytes, path their lossless text."""
    if not Path(root).is_dir():
        raise NotADirectoryError(root)
    rows = [(root, os.fsencode(p), encode_path(os.fsencode(p)), e, s) for p, e, s in walk(root, include, exact)]
    return spark.createDataFrame(rows, "root string, raw binary, path string, entry string, state string")


def single(spark: SparkSession, path: str) -> DataFrame:
    """One file as the inventory of its folder, which must not be a built-in one."""
    file = Path(path)
    if file.resolve().parent.name in BUILT_IN:
        raise ValueError(f"{path} lies in a folder that is never analyzed")
    raw = os.fsencode(file.name)
    return spark.createDataFrame([(str(file.parent), raw, encode_path(raw), "file", "standard")], "root string, raw binary, path string, entry string, state string")


def states(listing: DataFrame, rules: list[tuple[str, str]], include: list[str] | None = None, exact: bool = False, path: str = "path") -> DataFrame:
    """(path, entry, state) of a listing of files, as ``walk`` has them of a folder, each entry once.

    For listings that come as a table, such as an object store's.  ``rules`` are the (folder, text) of its
    ignore files, a table of the configuration's size; the files may be any number.
    """
    files = sorted(((d, IgnoreFile(t, d)) for d, t in rules), key=lambda x: x[0].count("/") + (x[0] != ""))
    wanted = include_matcher(include or [])

    def of(name: str) -> Iterator[tuple[str, str, str]]:
        parts, hidden = name.split("/"), False
        for k in range(1, len(parts)):
            at = "/".join(parts[:k])
            if parts[k - 1] in BUILT_IN:
                yield at, "builtin_directory", "ignored"
                return
            above = [f for d, f in files if d == "" or at.startswith(d + "/")]
            under = hidden or ignored(at, True, above)
            if under and not hidden or under and exact:
                yield at, "directory", "ignored"
            if under and not exact and wanted is None:
                return
            hidden = under
        above = [f for d, f in files if d == "" or name.startswith(d + "/")]
        if not hidden and not ignored(name, False, above):
            yield name, "file", "standard"
        elif wanted is not None and wanted.match(name):
            yield name, "file", "included"
        elif exact or not hidden:
            yield name, "file", "ignored"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {r for name in batch.column(0).to_pylist() if name for r in of(name)}
            yield pa.record_batch([pa.array(list(x), pa.string()) for x in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["path", "entry", "state"])

    return listing.select(path).mapInArrow(run, "path string, entry string, state string").distinct()


def files_of(entries: DataFrame) -> DataFrame:
    return entries.where("entry = 'file' and state <> 'ignored'").withColumn("included_ignored", F.col("state") == "included")


def with_bytes(files: DataFrame) -> DataFrame:
    """(path, bytes) of the files, read by the executors from the folder that all of them mount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, raw, path in zip(*(c.to_pylist() for c in batch.columns)):
                with open(os.path.join(os.fsencode(root), raw), "rb") as f:
                    yield pa.record_batch([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "bytes"])

    return files.select("root", "raw", "path").mapInArrow(run, "path string, bytes binary")
