"""Listings and whole files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import paths
from rillwork.functions.urls import unquote

# Glob of the time in a file name, 2021-02-18T03_00_00.
STAMP = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]T[0-9][0-9]_[0-9][0-9]_[0-9][0-9]"


def _glob_text(glob: str) -> str:
    """A glob without ``**`` as regular expression; wildcards and classes (``[a-z]``, ``[!a-z]``) stay inside one folder
    level, and a ``[`` without its ``]`` is a plain character."""
    out = []
    for token in re.findall(r"\[!?\]?[^\]/]*\]|.", glob, re.DOTALL):
        if len(token) > 1:
            inner = token[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&").replace("^", "\\^")
            out.append(f"(?!/)[{'^' + inner[1:] if inner.startswith('!') else inner}]")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(token, f"\\Q{token}\\E"))
    return "".join(out)


def matching(spark: SparkSession, base: str, pattern: str = "**/*") -> DataFrame:
    """Files below a folder whose relative path matches a glob, as ``binaryFile`` rows.

    ``*`` and ``?`` stay inside one folder level and ``**/`` stands for any number of levels, so
    ``*.csv`` finds files of the folder itself and ``**/*.csv`` all below it. The test is on the file
    metadata, which Spark applies to the listing: files that do not match are not opened.
    """
    base = base.rstrip("/")
    *folders, file = pattern.strip("/").split("/")
    wanted = "".join("([^/]+/)*" if f == "**" else f"{_glob_text(f)}/" for f in folders) + _glob_text(file)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    listed = paths.as_format(unquote("_metadata.file_path"), base, "relative")
    return found.filter(listed.rlike(f"^{wanted}$"))


def list_files(
    spark: SparkSession,
    base: str,
    pattern: str = "**/*",
    exclude_dirs: Sequence[str] = (),
    path_format: str = "relative",
) -> DataFrame:
    """Path, name, size and modification time of the files that match a glob.

    Contents are pruned from the scan and never read. ``exclude_dirs`` holds globs of folder names;
    files in or below a matching folder are left out.
    """
    found = matching(spark, base, pattern)
    folders = F.regexp_replace(paths.as_format("path", base, "relative"), "[^/]*$", "")
    for glob in exclude_dirs:
        found = found.filter(~folders.rlike(f"(^|/){_glob_text(glob)}/"))
    name = paths.name("path")
    return found.select(
        paths.as_format("path", base, path_format).alias("path"),
        name.alias("name"),
        paths.stem(name).alias("stem"),
        paths.suffix(name).alias("suffix"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def list_directory(spark: SparkSession, base: str, path_format: str = "relative") -> DataFrame:
    """Paths of what one folder holds: its files, and the folders below it that hold files at any depth."""
    relative, full = (paths.as_format("path", base, how) for how in ("relative", path_format))
    above = F.substr(full, F.lit(1), F.length(full) - F.length(relative))
    return matching(spark, base).select(F.concat(above, F.substring_index(relative, "/", 1)).alias("path")).distinct()


def read_blobs(spark: SparkSession, base: str, pattern: str = "**/*") -> DataFrame:
    """One row per file with its whole bytes and its path, name, size and modification time."""
    return matching(spark, base, pattern).select(
        F.col("content").alias("data"),
        "path",
        paths.name("path").alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
