"""WARC archives: written with revisit records for equal payloads, read back by verified boundary chains.

**Writing.** Pages become WARC/1.0 records through Spark's text writer, whose commit protocol survives lost executors
and whose paths may be in any store. Of equal payloads the smallest page_id is a response and the others revisit it.

**Reading.** Archives are read in byte ranges, cut at every occurrence of the magic `WARC/1.0\\r\\n`, so that a task
holds a piece of a file and nothing else. Each cut is a candidate record; its header's Content-Length gives the offset
of its successor. A range doesn't know where it starts in the file in terms of cuts, so offsets are counted from its
first cut, and the ranges of a file are added up afterwards. Then pointer jumping from offset 0 (reached nodes mark
their jump's target, jumps are composed with themselves, in a logarithmic number of rounds) keeps the candidates on
the chain: magic inside a payload starts a candidate that nothing on the chain points to. Only headers and offsets are
gathered by file, never payloads. A record whose payload holds magic is cut into several; those cuts are put together
afterwards, from a second read of the archives, which happens only if there are any.

Null html is an empty payload, null url an empty address; a null page_id is written as such and refers to the smallest
id of its payload; rows that repeat the smallest page_id of a payload are all responses; payloads under `min_bytes` are
all responses; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import checkpointed, shared_path, written

MAGIC = b"WARC/1.0\r\n"
BREAK = "\r\n"
#: What Spark puts between records: the end of a record.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE = "urn:x-page:"
DATE = "2020-01-01T00:00:00Z"
#: Rows (of some 50 bytes) up to which a side is broadcast.
BROADCAST_ROWS = 200_000
SALTS = 16


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1: 160 bits are four groups of 40, each ten hex digits and eight of base 32."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """`pages` (page_id, url, html) with the payload's size and digest and, in `first`, the smallest page_id of an equal payload held more than once."""
    data = F.col("html").cast("binary")
    sized = pages.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("payload_bytes"), base32_sha1(data).alias("digest"))
    shared = sized.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = checkpointed(shared)
    if shared.count() <= BROADCAST_ROWS:
        return sized.join(F.broadcast(shared), "digest", "left")
    # A payload may be that of most rows: its rows are spread over salts, and the (short) list of first ids is repeated for each.
    spread = shared.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return sized.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left").drop("salt")


def write(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> str:
    """Writes a record per row of `pages` (page_id, url, html) and returns the archives' folder."""
    path = shared_path(pages.sparkSession, "warc") if path is None else path
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    first = with_first(narrow, min_bytes)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{BREAK}WARC-Record-ID: "), name("page_id"), F.lit(f"{BREAK}WARC-Date: {DATE}{BREAK}WARC-Target-URI: "),
        F.regexp_replace("url", "[\\x00-\\x20\\x7f]+", "%20"), F.lit(f"{BREAK}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{BREAK}WARC-Profile: {PROFILE}{BREAK}WARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit(f"{BREAK}Content-Type: application/http; msgtype=response{BREAK}Content-Length: "), block_bytes.cast("string"), F.lit(BREAK * 2),
    )
    first.select(F.concat(header, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", END).text(path)
    return path


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at magic, in order within each byte range: file, size, block (the range's start), value."""
    cut = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def parse_header(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields, size of the header and Content-Length of a piece that follows magic; None if it isn't a header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    return (fields, end + 4, int(length)) if length.isascii() and length.isdigit() else None


def parse_block(fields: dict[str, str], block: bytes) -> dict:
    """What a record says, and the digest of its payload as read. A digest is tested where one is given as SHA-1."""
    http = fields.get("content-type", "").lower().startswith("application/http")
    at = block.find(b"\r\n\r\n") if http else -1
    head, payload = (block[:at], block[at + 4 :]) if at >= 0 else (b"", block)
    label, _, said = fields.get("warc-payload-digest", "").partition(":")
    said = said.upper() if label.lower() == "sha1" else ""
    ident, refers = fields.get("warc-record-id", ""), fields.get("warc-refers-to")
    number = lambda x: y if (x or "").startswith(f"<{PAGE}") and (y := x.removeprefix(f"<{PAGE}").removesuffix(">")).lstrip("-").isdigit() else None  # noqa: E731  text, as pandas would make floats of numbers beside nulls
    if fields.get("warc-type") == "revisit":
        sizes = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest = (int(sizes[0]) if sizes and sizes[0].isdigit() else None), said
    else:
        data = hashlib.sha1(payload)
        size, digest = len(payload), b32encode(data.digest()).decode()
        if said == data.hexdigest().upper():  # some writers use base 16
            said = digest
    return {"page_id": number(ident), "payload_bytes": size, "payload_digest": digest, "record_type": fields.get("warc-type"), "refers_to": number(refers), "record_id": ident, "refers_to_id": refers, "sound": not said or digest == said}


_CANDIDATE = "file string, size long, block long, ordinal long, at long, bytes long, span long, whole boolean, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, refers_to_id string, sound boolean"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_FIELDS = [x.split() for x in _CANDIDATE.split(", ")]


def candidates(cut: DataFrame) -> DataFrame:
    """A row per piece: where its magic starts, counted from the range's first cut (`at`), its bytes, and the record's span."""
    names = [n for n, _ in _FIELDS]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, ordinal = None, 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in _FIELDS]
            for file, size, block, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (file, block) != key:
                    key, at, ordinal = (file, block), 0, 0
                row = dict.fromkeys(names) | {"file": file, "size": size, "block": block, "ordinal": ordinal, "at": at - len(MAGIC), "bytes": len(piece)}
                if (header := parse_header(piece)) is not None:
                    fields, head, length = header
                    row |= {"span": len(MAGIC) + head + length + len(END), "whole": len(piece) >= head + length}
                    if row["whole"]:
                        try:
                            row |= parse_block(fields, piece[head : head + length])
                        except ValueError:  # not one of ours, so not on the chain, or refused below
                            row["sound"] = False
                for column, n in zip(out, names, strict=True):
                    column.append(row[n])
                at, ordinal = at + len(piece) + len(MAGIC), ordinal + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, _KINDS[t]) for x, (_, t) in zip(out, _FIELDS, strict=True)], names)

    return cut.mapInArrow(found, _CANDIDATE)


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the candidates (by ascending offset) a chain from offset 0 reaches, by pointer jumping."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    jump = np.append(np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n), n)
    reached = np.append(offset == 0, False)
    for _ in range(max(1, n).bit_length() + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def chained(found: DataFrame) -> DataFrame:
    """The candidates on the chains, and the cuts that belong to a record in pieces: `owner` is the record's offset, `span` its size, `parted` tells them."""

    def of_file(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "ordinal"], kind="stable").reset_index(drop=True)
        ends = (rows["at"] + rows["bytes"] + 2 * len(MAGIC)).groupby(rows["block"]).max()
        starts = (ends.cumsum() - ends).reindex(rows["block"]).to_numpy()
        offset = rows["at"].to_numpy() + starts
        real = np.flatnonzero(offset >= 0)
        span = rows["span"].fillna(-1).to_numpy().astype(np.int64)
        kept = np.zeros(len(rows), bool)
        if len(real):
            kept[real] = reachable(offset[real], np.where(span[real] < 0, -1, offset[real] + span[real]))
        chain = np.flatnonzero(kept)
        size = int(rows["size"].iloc[0])
        if size and rows["file"].iloc[0].lower().endswith(".gz"):  # that is the compressed size; Spark's reader has joined the members
            size = int(offset[-1] + len(MAGIC) + rows["bytes"].iloc[-1])
        if size and (not len(chain) or offset[chain[-1]] + span[chain[-1]] != size):
            raise ValueError(f"{rows['file'].iloc[0]}: the chain of records breaks off before the end, after offset {offset[chain[-1]] if len(chain) else 0}")
        before = np.searchsorted(chain, np.arange(len(rows)), side="right") - 1
        owner = chain[np.maximum(before, 0)] if len(chain) else np.zeros(len(rows), np.int64)
        whole = rows["whole"].eq(True).to_numpy(bool)
        rows = rows.assign(chain=kept, owner=offset[owner], span=span[owner], parted=(before >= 0) & ~whole[owner])
        return rows[kept | rows["parted"].to_numpy()]

    return found.groupBy("file").applyInPandas(of_file, f"{_CANDIDATE}, chain boolean, owner long, parted boolean")


def assembled(spark: SparkSession, path: str, cuts: DataFrame) -> DataFrame:
    """The records in pieces, from a second read: cuts are numbered as before, and those of a record are put together."""
    few = cuts.count() <= BROADCAST_ROWS

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ordinal = None, 0
        for batch in batches:
            numbers = []
            for k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key, ordinal = k, (ordinal + 1 if k == key else 0)
                numbers.append(ordinal)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(numbers, pa.int64()), batch.column(3)], ["file", "block", "ordinal", "value"])

    again = pieces(spark, path).mapInArrow(numbered, "file string, block long, ordinal long, value binary")
    keys = cuts.select("file", "block", "ordinal", "owner", "span")
    held = again.join(F.broadcast(keys) if few else keys, ["file", "block", "ordinal"])
    grouped = held.groupBy("file", "owner").agg(F.first("span").alias("span"), F.sort_array(F.collect_list(F.struct("block", "ordinal", "value"))).alias("parts"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x for x in _FIELDS if x[0] in _RESULT]
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for span, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                piece = MAGIC.join(p["value"] for p in parts)[: span - len(MAGIC) - len(END)]
                header, head, _ = parse_header(piece)
                row = parse_block(header, piece[head:])
                for column, (n, _) in zip(out, fields, strict=True):
                    column.append(row[n])
            yield pa.RecordBatch.from_arrays([pa.array(x, _KINDS[t]) for x, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])

    return grouped.select("span", "parts").mapInArrow(read, ", ".join(f"{n} {t}" for n, t in _FIELDS if n in _RESULT))


_RESULT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "sound")


def read(spark: SparkSession, path: str) -> DataFrame:
    """`records` without the ids' texts."""
    return records(spark, path).drop("record_id", "refers_to_id")


def records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives in `path`: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id.

    Archives of other writers are read too, plain or gzipped (`.gz`, any members): ids are text, page_id and refers_to are
    null where an id isn't one of ours, records of all types are rows, and a record without a SHA-1 has none to test.
    Raises if a chain breaks off before a file's end or a payload has another digest than its header says.
    """
    found = written(chained(candidates(pieces(spark, path))), "records")
    broken = found.where("parted")
    whole = found.where("chain and not parted").select(*_RESULT)
    if not broken.isEmpty():
        whole = whole.unionByName(assembled(spark, path, broken))
    tested = F.when(F.coalesce("sound", F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("the payload's digest is another: "), F.coalesce("record_id", F.lit("null")))))
    return whole.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", tested.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "record_id", "refers_to_id")
