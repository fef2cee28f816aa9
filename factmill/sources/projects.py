"""Manifests, settings and source files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
#: File names that are no sources (fixed values).
LEFT_OUT = (".unit.php", ".integration.php")


def autoload(manifests: DataFrame) -> DataFrame:
    """(root, kind, namespace, path) from manifests(root, content): psr-4, psr-0, classmap, files of autoload and autoload-dev.

    Values may be a string or a list; what isn't is skipped. autoload-dev's
    classmap and files take the place of autoload's.
    """
    def entries(root: str, text: str) -> list[tuple[str, str, str, str]]:
        out: list[tuple[str, str, str, str]] = []
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            return out
        lists: dict[str, list] = {}
        for section in ("autoload", "autoload-dev"):
            part = doc.get(section) if isinstance(doc, dict) else None
            if not isinstance(part, dict):
                continue
            for kind in ("psr-4", "psr-0"):
                for ns, paths in (part.get(kind) or {}).items() if isinstance(part.get(kind), dict) else ():
                    out += [(root, kind, ns, f"{root}/{p}".rstrip("/")) for p in ([paths] if isinstance(paths, str) else paths) if isinstance(p, str)]
            for kind in ("classmap", "files"):
                if isinstance(part.get(kind), list):
                    lists[kind] = [p for p in part[kind] if isinstance(p, str)]
        return out + [(root, kind, "", f"{root}/{p}".rstrip("/")) for kind, paths in lists.items() for p in paths]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for root, text in zip(b.column("root").to_pylist(), b.column("content").to_pylist(), strict=True) for r in entries(root, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["root", "kind", "namespace", "path"])

    return manifests.select("root", "content").mapInArrow(run, "root string, kind string, namespace string, path string")


def discover(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(root, kind, file_path): the sources among files that each row of autoload() names, as often as rows name them.

    Folders of psr-4, psr-0 and classmap are taken with all below them, single
    files of classmap and files by their path. Every folder above a file is a
    key, so that the join is on equal paths.
    """
    path = F.col("file_path")
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n < F.size(parts)).alias("below")))
    keys = files.select("file_path").distinct().where(path.endswith(".php")).select("file_path", F.explode(above).alias("x")).select("file_path", "x.path", "x.below")
    met = keys.join(entries.select("root", "kind", "path"), "path")
    folder = F.col("below") & (F.col("kind") != "files") & wanted(path)
    single = ~F.col("below") & F.col("kind").isin("classmap", "files")
    return met.where(folder | single).select("root", "kind", "file_path")


def project_info(manifests: DataFrame) -> DataFrame:
    """(root, name, description, language): what manifests(root, content) say; null where they don't, or aren't JSON."""
    get = lambda key: F.get_json_object("content", f"$.{key}")
    return manifests.select("root", get("name").alias("name"), get("description").alias("description"), get("require.php").alias("language"))


def manifests(spark: SparkSession, scan_paths: list[str]) -> DataFrame:
    """(root, content) of composer.json one level below each scanned folder."""
    read = spark.read.option("wholetext", True).option("ignoreMissingFiles", True)
    found = read.text([f"{p.rstrip('/')}/*/composer.json" for p in scan_paths])
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    return found.select(F.regexp_replace(path, "/composer\\.json$", "").alias("root"), F.col("value").alias("content"))


def settings(text: str) -> dict:
    """Tool settings with their types checked; what has another type is left at its default."""
    out = {"checks": [], "strict": False, "min_confidence": 0.0, "called_before": [], "plugins": [], "exclude": []}
    try:
        doc = json.loads(text)
    except ValueError:
        return out
    for key, name in (("checks", "checks"), ("plugins", "plugins"), ("exclude", "exclude")):
        if isinstance(doc.get(key), list):
            out[name] = [x for x in doc[key] if isinstance(x, str)]
    if isinstance(doc.get("strict"), bool):
        out["strict"] = doc["strict"]
    if isinstance(doc.get("min-confidence"), (int, float)) and not isinstance(doc.get("min-confidence"), bool):
        out["min_confidence"] = float(doc["min-confidence"])
    if isinstance(doc.get("called-before"), list):
        out["called_before"] = [(x["before"], x["after"]) for x in doc["called-before"] if isinstance(x, dict) and isinstance(x.get("before"), str) and isinstance(x.get("after"), str)]
    return out


def wanted(path: Column) -> Column:
    out = path.endswith(".php")
    for end in LEFT_OUT:
        out = out & ~path.endswith(end)
    return out


def source_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, content) of all PHP files below paths; larger ones than MAX_BYTES and unreadable ones are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.php").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    found = read.load(paths).where(F.col("length") <= MAX_BYTES)
    return found.select(F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), F.decode("content", "UTF-8").alias("content")).where(wanted(F.col("file_path")))


def expected_fqn(file_path: Column, namespace: Column, directory: Column) -> Column:
    """The class that a psr-4 entry promises for a file."""
    rest = F.regexp_replace(F.substring(file_path, F.length(directory) + 2, F.length(file_path)), "\\.php$", "")
    return F.concat(namespace, F.translate(rest, "/", "\\"))
