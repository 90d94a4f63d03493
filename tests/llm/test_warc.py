"""Archives: what is read back, also from chunks of a few bytes."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from conftest import rows_of
from llm_data import prose, workers  # noqa: F401

from sensorcast.llm import warc
from sensorcast.llm.queries import ORACLES, op12_warc

COPY = prose(1, 300)
LONG = "é中🙂 " * 40_000 + "\r\n\r\nWARC/1.0\r\n\r\n" + "x" * 3_000_000
ROWS = [
    (1, "http://a.example/1", COPY),
    (2, "http://a.example/2", COPY),
    (7, "http://a.example/7", COPY),
    (3, None, "short"),
    (4, "", "short"),  # too short to be shared
    (5, "http://a.example/ 5\r\nWARC-Type: x", None),
    (6, "http://é.example/", ""),
    (8, "http://b.example", LONG),
    (9, "http://b.example", LONG),
    (10, "c", "ends in a line\r\n"),
    (11, "c", "ends in an empty line\r\n\r\n"),
    (12, "c", "\r\n\r\n\r\n\r"),
    (13, "c", "\r"),
    (14, "c", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 30),
    (15, "c", "a" * 999),
    (16, "c", "a" * 999),
    (17, "c", "b" * 1000),
    (18, "c", "b" * 1000),
    (20, "twice", "c" * 2000),
    (20, "twice", "c" * 2000),
    (21, "twice", "other text"),
    (21, "twice", "another text"),
    (None, "none", "d" * 1500),
    (22, "none", "d" * 1500),
    (None, "none", "no id"),
]
SCHEMA = "page_id long, url string, html string, record int, chunk int"


def payload(html):
    return (html or "").encode()


def want(rows):
    """By page: the response of equal long payloads is the row of the largest page."""
    out = []
    last = {}
    for n, (page, _, html) in enumerate(rows):
        body = payload(html)
        if len(body) >= 1000:
            last[body] = max(last.get(body, (-1, -1)), (-1 if page is None else page, n))
    for n, (page, _, html) in enumerate(rows):
        body = payload(html)
        origin = last.get(body, (page, n))
        kind = ("response", None) if origin[1] == n else ("revisit", origin[0])
        out.append((page, kind[0], len(body), hashlib.sha1(body).hexdigest(), kind[1]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(workers):
    return workers.createDataFrame([(*r, 0, 0) for r in ROWS], SCHEMA)


@pytest.mark.parametrize("chunk_bytes", [warc.CHUNK_BYTES, 40_000, 4])
def test_round_trip(workers, pages, tmp_path, chunk_bytes):
    rows = ROWS if chunk_bytes > 4 else [r for r in ROWS if r[2] != LONG and len(payload(r[2])) < 5_000]
    frame = pages if chunk_bytes > 4 else pages.filter("html is null or length(html) < 5000")
    got = [tuple(r) for r in warc.archive(frame, f"{tmp_path}/w", chunk_bytes=chunk_bytes).collect()]
    assert sorted(got, key=str) == want(rows)


def test_payloads_come_back(workers, pages, tmp_path):
    warc.write_archives(warc.chunk_table(pages, 50_000), f"{tmp_path}/w")
    parts = warc.read_archives(workers, f"{tmp_path}/w", chunk_bytes=20_000).collect()
    assert max(len(r["data"]) for r in parts) <= 20_000
    content = {}
    for r in sorted(parts, key=lambda r: (r["record_id"], r["segment"], r["part"])):
        content.setdefault(r["record_id"], []).append(r)
    assert len(content) == len(ROWS)
    bodies = [b"".join(r["data"] for r in rs) for rs in content.values() if rs[0]["record_type"] == "response"]
    shared = {payload(h) for _, _, h in ROWS if len(payload(h)) >= 1000}
    assert sorted(bodies) == sorted([*shared, *(payload(h) for _, _, h in ROWS if len(payload(h)) < 1000)])


def test_files_are_archives(workers, tmp_path):
    rows = [(1, "http://a.example/\r\nx", "one", 0, 0), (2, "http://a.example/2", "z" * 1200, 0, 0), (3, None, "z" * 1200, 0, 0)]
    frame = workers.createDataFrame(rows, SCHEMA)
    warc.write_archives(warc.chunk_table(frame, 500), f"{tmp_path}/w", date="2024-05-06T07:08:09Z")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in Path(f"{tmp_path}/w").glob("*.gz"))
    records = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        assert first == "WARC/1.0" and fields["WARC-Date"] == "2024-05-06T07:08:09Z" and rest[size : size + 4] == b"\r\n\r\n"
        records.append((fields, rest[:size]))
        data = rest[size + 4 :]
    assert sorted(f["WARC-Type"] for f, _ in records) == ["continuation"] * 2 + ["response"] * 2 + ["revisit"]
    by = {(f["WARC-Type"], f.get("WARC-Segment-Number", "1")): (f, b) for f, b in records if f.get("WARC-Segment-Number") or f["WARC-Type"] == "revisit"}
    block = b"".join(by[k][1] for k in [("response", "1"), ("continuation", "2"), ("continuation", "3")])
    assert block.endswith(b"\r\n\r\n" + b"z" * 1200) and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert int(by["continuation", "3"][0]["WARC-Segment-Total-Length"]) == len(block)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"z" * 1200).digest()).decode()
    origin, copy = by["response", "1"][0], by["revisit", "1"][0]
    assert origin["WARC-Payload-Digest"] == copy["WARC-Payload-Digest"] == digest
    assert copy["WARC-Refers-To"] == origin["WARC-Record-ID"]


def test_damage_is_an_error(workers, pages, tmp_path):
    warc.write_archives(warc.chunk_table(pages.filter("page_id = 15")), f"{tmp_path}/w")
    file = next(f for f in Path(f"{tmp_path}/w").glob("*.gz") if b"aaaa" in gzip.decompress(f.read_bytes()))
    whole = gzip.decompress(file.read_bytes())
    for n, bad in enumerate((whole.replace(b"aaaa", b"aaab", 1), whole[:-8], whole.replace(b"aaaa", b"aaa", 1))):
        Path(f"{tmp_path}/{n}").mkdir()
        Path(f"{tmp_path}/{n}/part.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="damaged payload|within a record|as long as its header"):
            warc.page_records(workers, f"{tmp_path}/{n}").collect()


def test_archives_of_others(workers, tmp_path):
    """One long record without segments, and a record that is no answer to a request."""
    body = b"<p>" + b"y" * 300_000
    answer = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:1>\r\ncontent-type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:2:2>\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    (tmp_path / "a.gz").write_bytes(gzip.compress(one % (len(answer), answer) + two))
    got = warc.whole_records(warc.read_archives(workers, str(tmp_path), chunk_bytes=1000)).collect()
    sha = {r["record_id"]: (r["n_bytes"], base64.b32decode(r["digest"])) for r in got}
    assert sha == {
        "urn:page:1:1": (len(body), hashlib.sha1(body).digest()),
        "urn:page:2:2": (4, hashlib.sha1(b"\r\n\r\n").digest()),
    }


def test_nothing(pages, tmp_path):
    assert warc.archive(pages.limit(0), f"{tmp_path}/w").count() == 0


def test_hot_payloads(workers, tmp_path, monkeypatch):
    """Copies that meet by broadcast and by shuffle give the same."""
    rows = [(n, "u", ("k" if n % 3 else f"k{n % 7}") * 1000) for n in range(300)]
    frame = workers.createDataFrame(rows, "page_id long, url string, html string")
    for hot in (1, 5, 1000):
        monkeypatch.setattr(warc, "HOT", hot)
        got = [tuple(r) for r in warc.archive(frame, f"{tmp_path}/{hot}").collect()]
        assert sorted(got, key=str) == want(rows)


def test_query_has_its_sql(workers, tmp_path):
    import duckdb

    rows = [r for r in ROWS if r[0] is not None and r[0] not in (20, 21)]
    workers.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op12_warc(workers, str(tmp_path))
    sql = ORACLES["op12_warc"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of(got) == sorted(duckdb.sql(sql).fetchall(), key=lambda r: tuple((x is None, str(x)) for x in r))
