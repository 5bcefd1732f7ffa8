"""Text columns: paths, ids, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """Last path part without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent_folder(path: Column) -> Column:
    """First part of a relative path."""
    return F.split(path, "/")[0]


def quoted_path(rel: Column) -> Column:
    """Percent-encoded path that keeps the slashes; a plus sign becomes %2B, a space %20."""
    parts = F.transform(
        F.split(F.regexp_replace(rel, "^/+", ""), "/"),
        lambda p: F.replace(
            F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")),
            F.lit("*"),
            F.lit("%2A"),
        ),
    )
    return F.array_join(parts, "/")


def strip_edf(name: Column) -> Column:
    """File name without a trailing .edf in any case."""
    return F.regexp_replace(name, r"(?i)\.edf$", "")


def number_or_null(text: Column) -> Column:
    """A number written in text, with blanks around it allowed; null if it is none."""
    return F.trim(text).try_cast("double")
