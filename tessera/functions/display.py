"""What pages show: percentages, addresses of media, stored paths, titles and short lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t


def percent(score: Column) -> Column:
    """A score of 0 to 1 as whole percent, half to even."""
    return F.rint(score * 100).cast("int")


def media_url(path: Column, prefix: str = "/media/") -> Column:
    """Address of a stored file, or an empty text without one."""
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.concat(F.lit(prefix), path))


def relative_path(path: Column, root: str) -> Column:
    """A path below the data folder, relative to it and with slashes; null for a path elsewhere."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(plain, F.lit(root.rstrip("/") + "/")), F.substring(plain, len(root.rstrip("/")) + 2, F.length(plain)))


def absolute_path(stored: Column, root: str) -> Column:
    """A stored path back below the data folder; null without one."""
    return F.when(F.coalesce(stored, F.lit("")) != "", F.concat(F.lit(root.rstrip("/") + "/"), stored))


def title_or(title: Column, default: str) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(default))


def first_of(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def page_label(label: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return t.blank_to_null(label)
