import hashlib
from base64 import b32encode

import numpy as np
import pytest

from sieveline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long, salt int"
TRAP = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n\r\n\r\n"
HTML = [None, "", "a", "a", "é漢\r\n\r\n", TRAP, TRAP, TRAP + "end" * 400, "WARC/1.0\r\n", "\r\nWARC/1.0\r\nContent-Length: 99999999\r\n\r\n", "z" * 70_000, *[f"page {i}" * i for i in range(40)], *["same"] * 9]


def expected(rows, min_bytes=0):
    first = {}
    for page, html in rows:
        data = (html or "").encode()
        if page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= min_bytes and sum((h or "").encode() == data for _, h in rows) > 1 and data in first and first[data] != page
        out.append((page, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "700"])
@pytest.mark.parametrize("min_bytes", [0, 2])
def test_round_trip(spark, split, min_bytes):
    rows = [(i if i != 7 else None, h) for i, h in enumerate(HTML)] + [(2, "a"), (2**62 + 1, "big"), (2**62 + 3, "big")]
    pages = spark.createDataFrame([(i, "http://x/ \n%d" % (i or 0) if i != 1 else None, h, "d", 1, 2) for i, h in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(map(tuple, warc.read(spark, warc.write(pages, min_bytes)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected(rows, min_bytes)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = list(enumerate(HTML))
    pages = spark.createDataFrame([(i, "u", h, "d", 1, 2) for i, h in rows], SCHEMA)
    assert sorted(map(tuple, warc.read(spark, warc.write(pages)).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_cut_archive_is_refused(spark, tmp_path):
    path = warc.write(spark.createDataFrame([(1, "u", "abc", "", 0, 0)], SCHEMA).coalesce(1))
    from glob import glob

    data = b"".join(open(f, "rb").read() for f in sorted(glob(path.removeprefix("file:").replace("//", "/", 1) + "/part-*")))
    (tmp_path / "cut").write_bytes(data[:-6])
    with pytest.raises(Exception, match="breaks off"):
        warc.read(spark, f"file://{tmp_path}/cut").collect()


def test_pointer_jumping_equals_walking():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 1000):
        offset = np.unique(np.append(0, rng.integers(1, 10 * n, n)))
        successor = np.where(rng.random(len(offset)) < 0.9, rng.choice(offset, len(offset)), -1)
        successor = np.where(successor > offset, successor, 10 * n + 1)
        want, at = np.zeros(len(offset), bool), 0
        while at in set(offset.tolist()):
            i = int(np.searchsorted(offset, at))
            want[i], at = True, int(successor[i])
        assert (warc.reachable(offset, successor) == want).all()


def test_archives_of_other_writers(spark, tmp_path):
    import gzip
    from base64 import b32encode
    from hashlib import sha1

    def record(kind, ident, block, content="application/http; msgtype=response", **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{ident}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": content, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    body = b"<p>WARC/1.0\r\nWARC-Type: response\r\n\r\n</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"
    records = [
        record("warcinfo", "a", b"software: x\r\n\r\nmore", "application/warc-fields"), record("request", "b", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request"),
        record("response", "c", http + body, WARC_Payload_Digest="sha1:" + b32encode(sha1(body).digest()).decode()), record("response", "d", http + b"plain"),
        record("response", "e", http + b"hex", WARC_Payload_Digest="sha1:" + sha1(b"hex").hexdigest()), record("metadata", "f", b"", "text/plain", WARC_Payload_Digest="sha256:00"),
        record("revisit", "g", http, WARC_Refers_To="<urn:uuid:c>", WARC_Payload_Digest="sha1:ABC"),
    ]
    (tmp_path / "plain").mkdir()
    (tmp_path / "gz").mkdir()
    (tmp_path / "plain/x.warc").write_bytes(b"".join(records))
    (tmp_path / "gz/x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    want = {"a": ("warcinfo", 19), "b": ("request", 0), "c": ("response", len(body)), "d": ("response", 5), "e": ("response", 3), "f": ("metadata", 0), "g": ("revisit", 9)}
    for folder in ("plain", "gz"):
        got = warc.records(spark, str(tmp_path / folder)).collect()
        assert {r.record_id[10:-1]: (r.record_type, r.payload_bytes) for r in got} == want and len(got) == 7
        assert all(r.page_id is None and r.refers_to is None for r in got) and {r.refers_to_id for r in got} == {None, "<urn:uuid:c>"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.warc").write_bytes(record("response", "h", http + b"x", WARC_Payload_Digest="sha1:" + "A" * 32))
    with pytest.raises(Exception, match="digest is another"):
        warc.records(spark, str(tmp_path / "bad")).collect()
