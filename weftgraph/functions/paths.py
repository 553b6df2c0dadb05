"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_path(path: Column) -> Column:
    """One spelling for a path: ``/`` as separator, no repeated separators, no ``.`` segments.  Null stays null."""
    slashes = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    return F.array_join(F.filter(F.split(slashes, "/"), lambda s: s != "."), "/")


def base_name(path: Column) -> Column:
    """Last segment of a path with either separator; empty for a path that ends in one."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)\z", 1))
