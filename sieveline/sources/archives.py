"""Repositories named by links, and the Java files of their archives."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hosts, names that are usable, and limits in megabytes and files.
HOSTS = ("github.com", "www.github.com")
NAME = "^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"
REF = "^[A-Za-z0-9][A-Za-z0-9._/-]{0,199}$"
ARCHIVE_MB, FILE_MB, FILES, EXTRACTED_MB, UNPACKED_MB = 400, 4, 20_000, 500, 4_000


def repository(link: Column) -> Column:
    """owner, name, ref (HEAD if none is named) of a link, or `refused`: why it isn't one."""
    text = F.trim(link)
    ssh = text.rlike("^git@[^:]+:.+$")
    plain = F.when(ssh, F.regexp_replace(text, "^git@([^:]+):", "https://$1/")).when(text.contains("://"), text).otherwise(F.concat(F.lit("https://github.com/"), F.regexp_replace(text, "^/+", "")))
    scheme, authority = F.lower(F.regexp_extract(plain, "^([^:]+)://", 1)), F.regexp_extract(plain, "^[^:]+://([^/?#]*)", 1)
    path, fragment = F.regexp_extract(plain, "^[^:]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(plain, "#(.*)$", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    owner, name = F.get(parts, 0), F.regexp_replace(F.get(parts, 1), "\\.git$", "")
    named = (F.size(parts) > 3) & F.get(parts, 2).isin("tree", "commit")
    ref = F.when(named, F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "/")).otherwise("HEAD")
    refused = (
        F.when(F.coalesce(text, F.lit("")) == "", "link_empty").when(~ssh & ~scheme.isin("http", "https"), "bad_scheme").when(~ssh & authority.contains("@"), "credentials_in_link")
        .when(~F.lower(F.regexp_replace(authority, ":[0-9]*$", "")).isin(*HOSTS), "not_github").when(F.size(parts) < 2, "no_repository").when(~owner.rlike(NAME) | ~name.rlike(NAME), "bad_repository")
        .when(named & ((fragment != "") | ~ref.rlike(REF) | ref.contains("..")), "bad_ref")
    )
    ok = refused.isNull()
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, name).alias("name"), F.when(ok, ref).alias("ref"), refused.alias("refused"))


def java_members(data: bytes, file_mb: float = FILE_MB, files: int = FILES, extracted_mb: float = EXTRACTED_MB, unpacked_mb: float = UNPACKED_MB) -> Iterator[tuple[str, bytes]]:
    """Path (without the archive's own folder) and content of the Java files of a tar archive, within the limits.

    Links, and paths that leave the archive's folder, are passed over; over a limit in all the archive is refused.
    """
    n = held = walked = 0
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as archive:
        for member in archive:
            walked += member.size
            if walked > unpacked_mb * 1e6:
                raise ValueError("archive_too_large")
            path = posixpath.normpath(member.name)
            if not member.isfile() or not path.endswith(".java") or path.startswith(("/", "..")) or member.size > file_mb * 1e6:
                continue
            n, held = n + 1, held + member.size
            if n > files or held > extracted_mb * 1e6:
                raise ValueError("too_much_source")
            yield path.partition("/")[2] or path, archive.extractfile(member).read()


def java_files(spark: SparkSession, path: str) -> DataFrame:
    """archive, file, content, refused of the archives under `path`; a refused or broken one gives one row that says so."""
    read = spark.read.format("binaryFile").load(path)
    names = ["archive", "file", "content", "refused"]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, size, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    if size > ARCHIVE_MB * 1e6:
                        raise ValueError("archive_too_large")
                    rows = [(archive, f, c, None) for f, c in java_members(data)]
                except (ValueError, tarfile.TarError, EOFError, OSError) as e:
                    rows = [(archive, None, None, str(e) if isinstance(e, ValueError) else "not_an_archive")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], names)

    return read.select("path", "length", "content").mapInArrow(unpacked, "archive string, file string, content binary, refused string")


#: Metrics and what they say, for reports in plain words.
GLOSSARY = {
    "WMC": "sum of the complexities of a class's methods", "AMW": "mean complexity of a method", "MAXCC": "greatest complexity of a method", "TCC": "share of method pairs that share a field",
    "LCOM": "method pairs that share no field, less those that do", "LCOM3": "how little of a class's fields its methods touch", "ATFD": "data of other classes that is read", "FDP": "classes whose data is read",
    "LAA": "share of the data read that is the class's own", "NOAV": "variables that a method touches", "CINT": "calls that a method makes", "CBO": "types that a class depends on", "RFC": "methods of a class and calls it makes",
    "NOM": "methods", "NOF": "fields", "NOPA": "public fields", "NOAM": "accessors", "WOC": "share of a class's public members that do something", "DIT": "ancestors of a class", "NOC": "direct subclasses",
    "CLOC": "lines of a class", "MLOC": "lines of a method", "CC": "independent paths through a method", "MAXNESTING": "levels of nesting", "NP": "parameters",
}


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(GLOSSARY.items()), "metric string, meaning string")
