"""Names and paths as readers see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def readable(name: Column) -> Column:
    """`LongParameterList` as "Long Parameter List"."""
    return F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " ")


def slug(name: Column) -> Column:
    """In lower case, with one hyphen for each run of anything but letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")


def artifact_uri(path: Column, root: str) -> Column:
    """The path with slashes, relative to `root` if it lies within; else as it is."""
    path, top = F.translate(path, "\\", "/"), root if root.endswith("/") else root + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substr(path, F.lit(len(top) + 1))).otherwise(path)


def source_root(path: Column, package: Column) -> Column:
    """The folder that a file's package hangs from: its own, less one folder for each segment of the package."""
    folders = F.split(path, "/")
    up = 1 + F.when(F.coalesce(package, F.lit("")) == "", 0).otherwise(F.size(F.split(package, "\\.")))
    return F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - up, F.lit(0))), "/")
