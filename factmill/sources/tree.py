"""Trees of source folders, listed by tasks: a frontier of folders, one job for each level.

Folders are on a file system that executors mount; stores that only Hadoop
reads are listed by projects.source_files(). The driver holds paths of roots only.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixpoint import cut
from .projects import LEFT_OUT, MAX_BYTES

#: Levels below a root that are walked (fixed value).
DEEPEST = 50
#: Name of the manifest that makes a folder a project (fixed value).
MANIFEST = "composer.json"


def _mapped(rows: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in b.to_pylist() for x in f(row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k.split(" ")[1]]) for c, k in zip(zip(*out), schema.split(", "))], names)

    return rows.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_ENTRY = "root string, path string, real string, what string, message string"


def _listed(row: dict) -> Iterator[tuple]:
    """Entries of one folder: sources, folders, and a warning if it can't be read; links count as what they lead to."""
    root, folder = row["root"], row["path"]
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_dir():
                        yield root, e.path, os.path.realpath(e.path), "folder", None
                    elif e.is_file() and e.name.endswith(".php") and not e.name.endswith(LEFT_OUT):
                        yield root, e.path, None, "file", None
                except OSError as x:
                    yield root, e.path, None, "warning", x.strerror
    except FileNotFoundError:
        return
    except OSError as x:
        yield root, folder, None, "warning", x.strerror or str(x)


def walk(roots: DataFrame, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(files(root, file_path), warnings(root, path, message)) below roots(root), links followed.

    A folder is known by its real path and entered once from each root, by the
    least of the paths that lead there first; so links may form cycles. Folders
    more than deepest levels down aren't entered. A missing root has no files; a
    folder that can't be read gives a warning row and the rest goes on.
    """
    start = roots.select("root").where("root IS NOT NULL").distinct()
    frontier = cut(_mapped(start, lambda r: iter([(r["root"], r["root"].rstrip("/") or "/", os.path.realpath(r["root"]))]), "root string, path string, real string"))
    seen, found = frontier.select("root", "real"), []
    for _ in range(deepest + 1):
        entries = cut(_mapped(frontier.select("root", "path").repartition("path"), _listed, _ENTRY))
        found.append(entries)
        folders = entries.where("what = 'folder'").groupBy("root", "real").agg(F.min("path").alias("path")).join(seen, ["root", "real"], "left_anti")
        frontier = cut(folders.select("root", "path", "real"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier.select("root", "real")))
    every = reduce(DataFrame.unionByName, found)
    return every.where("what = 'file'").select("root", F.col("path").alias("file_path")), every.where("what = 'warning'").select("root", "path", "message")


def contents(files: DataFrame) -> DataFrame:
    """(root, file_path, content) of files(root, file_path), read by tasks; what is larger than MAX_BYTES or can't be read is left out."""

    def read(row: dict) -> Iterator[tuple]:
        try:
            if os.path.getsize(row["file_path"]) <= MAX_BYTES:
                with open(row["file_path"], "rb") as f:
                    yield row["root"], row["file_path"], f.read().decode("utf-8", "replace")
        except OSError:
            return

    return _mapped(files.select("root", "file_path"), read, "root string, file_path string, content string")


def _text(path: str) -> str:
    with open(path, "rb") as f:
        return f.read(MAX_BYTES).decode("utf-8", "replace")


def monorepo(spark: SparkSession, settings_file: str) -> tuple[DataFrame, DataFrame]:
    """(projects(root, content), warnings(root, path, message)) of a settings file with scan_paths.

    Each folder, or link to one, right below a scanned path that has a manifest
    is a project. Relative paths start at the settings file's folder. The file, which
    must name scan_paths, is read by a task, and so are folders; a manifest that
    isn't a JSON object, a scanned path that can't be read or isn't text gives a
    warning row instead.
    """

    def scanned(row: dict) -> Iterator[tuple]:
        file = row["path"]
        try:
            doc = json.loads(_text(file))
        except (OSError, ValueError) as x:
            yield file, None, f"settings can't be read: {x}"
            return
        paths = doc.get("scan_paths") if isinstance(doc, dict) else None
        if not isinstance(paths, list):
            yield file, None, "scan_paths is missing"
            return
        for p in paths:
            if isinstance(p, str):
                yield file, os.path.join(os.path.dirname(os.path.abspath(file)), p), None
            else:
                yield file, None, f"no path: {json.dumps(p)}"

    def children(row: dict) -> Iterator[tuple]:
        path = row["path"]
        try:
            names = sorted(os.listdir(path))
        except OSError as x:
            yield None, path, None, f"can't be read: {x.strerror}"
            return
        for name in names:
            child = os.path.join(path, name)
            manifest = os.path.join(child, MANIFEST)
            if os.path.isdir(child) and os.path.isfile(manifest):
                try:
                    text = _text(manifest)
                    if not isinstance(json.loads(text), dict):
                        raise ValueError("no object")
                    yield os.path.normpath(child), manifest, text, None
                except (OSError, ValueError) as x:
                    yield os.path.normpath(child), manifest, None, f"manifest is skipped: {x}"

    scans = cut(_mapped(spark.createDataFrame([(settings_file,)], "path string"), scanned, "file string, path string, message string"))
    rows = cut(_mapped(scans.where("path IS NOT NULL").select("path").distinct().repartition("path"), children, "root string, path string, content string, message string"))
    warnings = scans.where("message IS NOT NULL").select(F.lit(None).cast("string").alias("root"), F.col("file").alias("path"), "message")
    return rows.where("content IS NOT NULL").select("root", "content"), warnings.unionByName(rows.where("message IS NOT NULL").select("root", "path", "message"))
