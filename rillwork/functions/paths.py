"""Parts of paths and names built for paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwork.functions.urls import quote

# Characters that are not allowed in an identifier.
IDENTIFIER_PUNCTUATION = " $'\",-\\/&#%@.<>|*?!"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name(path: Column | str) -> Column:
    """Last part of a path; trailing slashes and ``/.`` do not count."""
    trimmed = F.regexp_replace(_col(path), r"(/+\.?)+$", "")
    return F.substring_index(trimmed, "/", -1)


def _hidden(file_name: Column) -> Column:
    return F.startswith(file_name, F.lit("."))


def stem(file_name: Column | str) -> Column:
    """A file name minus all its suffixes; a hidden file keeps its name."""
    file_name = _col(file_name)
    return F.when(_hidden(file_name), file_name).otherwise(F.substring_index(file_name, ".", 1))


def suffixes(file_name: Column | str) -> Column:
    """All suffixes with their dots."""
    file_name = _col(file_name)
    pieces = F.split(file_name, r"\.")
    plain = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.concat(F.lit("."), p))
    return F.when(_hidden(file_name) & (F.size(pieces) == 2), F.array().cast("array<string>")).otherwise(plain)


def suffix(file_name: Column | str) -> Column:
    """Last suffix with its dot, or an empty string."""
    file_name = _col(file_name)
    last = F.substring_index(file_name, ".", -1)
    whole = (F.length(last) == F.length(file_name)) | (_hidden(file_name) & (F.instr(F.substr(file_name, F.lit(2)), ".") == 0))
    return F.when(whole, F.lit("")).otherwise(F.concat(F.lit("."), last))


def table_from_path(path: Column | str) -> Column:
    """Table in ``data_<table>_<YYYY-MM-DDTHH_MM_SS>.csv``; null where the name has another form."""
    found = F.regexp_extract(name(path), r"^data_(.*)_\d{4}-\d\d-\d\dT\d\d_\d\d_\d\d.*\.", 1)
    return F.nullif(found, F.lit(""))


def clean_filename(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "[^-a-zA-Z0-9]", "_")


def clean_identifier(text: Column | str) -> Column:
    return F.translate(_col(text), IDENTIFIER_PUNCTUATION, "_" * len(IDENTIFIER_PUNCTUATION))


def lake_path(system: Column, date: Column, part: Column, extension: Column) -> Column:
    return F.format_string("/data/%s/%s/part%s.%s", system, date, part.cast("string"), extension)


def part_name(table: Column | str, number: Column | str) -> Column:
    return F.format_string("%s_part%03d.json.gz", _col(table), _col(number).cast("long"))


def stage_path(table: Column | str, ts: Column | str) -> Column:
    day = _col(ts).cast("date").cast("string")
    return F.concat(F.lit("@staging/"), quote(table), F.lit("/"), day, F.lit("/"))


def as_format(path: Column | str, base: str, how: str = "relative") -> Column:
    """A file URI as path relative to a base folder, as absolute path, or unchanged as URL."""
    path = _col(path)
    if how == "url":
        return path
    absolute = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    if how == "absolute":
        return absolute
    if how != "relative":
        raise ValueError(f"path format must be relative, absolute or url, found {how!r}")
    root = F.regexp_replace(F.lit(base.rstrip("/")), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.substr(absolute, F.length(root) + F.lit(2))
