"""Folders of ARC files, written by hand, become WARC files that resolve."""

from __future__ import annotations

import gzip
import io
from collections import Counter

import pytest

from timeloom.llm import warc

HTML = b"<html>\xff caf\xc3\xa9\n\n1 2 3\n</html>"


def http(payload: bytes, status: str = "200 OK") -> bytes:
    return f"HTTP/1.0 {status}\r\nServer: x\r\n\r\n".encode() + payload


ONE = [
    b"http://a.org/ 10.0.0.1 19970101000000 text/html %d\n%s\n",
    b"http://b.org/with blank 10.0.0.2 19980203 text/html %d\n%s\n",
    b"dns:a.org 10.0.0.3 19970101000000 text/dns %d\n%s\n",
]


def version_1() -> bytes:
    body = b"1 0 Old Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    blocks = (http(HTML), http(HTML, "404 Gone"), b"a.org. 3600 IN A 10.0.0.3")
    return b"filedesc://one.arc 0.0.0.0 19970101000000 text/plain %d\n%s\n" % (len(body), body) + b"".join(line % (len(x), x) for line, x in zip(ONE, blocks, strict=True))


def version_2() -> bytes:
    body = b"2 0 Newer Crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    tail = b"200 abc - 0 two.arc"
    out = b"filedesc://two.arc 0.0.0.0 19960101000000 text/plain 200 - - 0 two.arc %d\n%s\n" % (len(body), body)
    for url, payload in ((b"http://a.org/", HTML), (b"filedesc://no.version/", b"2 0 fake"), (b"http://c.org/", b"")):
        block = http(payload)
        out += b"%s 10.0.0.4 19960505 text/html %s %d\n%s\n\n" % (url, tail, len(block), block)
    return out


def members(data: bytes) -> bytes:
    """A gzip member for each record, as crawlers wrote them."""
    offsets = [at for at, _ in warc.arc_records(io.BytesIO(data))] + [len(data)]
    return b"".join(gzip.compress(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False))


def test_a_folder_is_converted(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "one.arc").write_bytes(version_1())
    (tmp_path / "in" / "sub" / "two.arc.gz").write_bytes(members(version_2()))
    (tmp_path / "in" / "again.arc.gz").write_bytes(gzip.compress(version_1()))
    (tmp_path / "in" / "empty.arc").write_bytes(b"")
    found = warc.read_arc_files(spark, str(tmp_path / "in")).collect()
    assert Counter((r.version, r.first) for r in found) == {(1, True): 2, (2, True): 1, (1, False): 6, (2, False): 3}
    assert {bytes(r.block) for r in found if r.header["URL"] == "dns:a.org"} == {b"a.org. 3600 IN A 10.0.0.3"}
    assert {r.header["URL"] for r in found} >= {"http://b.org/with blank", "filedesc://no.version/"}
    for to in ("out", "twice"):
        warc.convert_folder(spark, str(tmp_path / "in"), str(tmp_path / to))
    rows, twice = ([(dict(r.headers), bytes(r.block)) for r in warc.read_warc_files(spark, str(tmp_path / to)).collect()] for to in ("out", "twice"))
    ids = Counter(h["WARC-Record-ID"] for h, _ in rows)
    assert ids == Counter(h["WARC-Record-ID"] for h, _ in twice) and len(rows) == len(found)
    assert Counter(h["WARC-Type"] for h, _ in rows) == {"warcinfo": 3, "resource": 2, "response": 3, "revisit": 4}
    responses = {h["WARC-Record-ID"]: (h, b) for h, b in rows if h["WARC-Type"] == "response"}
    for h, block in rows:
        assert h["WARC-Block-Digest"] == f"sha1:{warc.base32_sha1(block)}"
        if h["WARC-Type"] == "revisit":
            of, held = responses[h["WARC-Refers-To"]]
            assert (of["WARC-Target-URI"], of["WARC-Date"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]) == ("http://a.org/", "1996-05-05T00:00:00Z")
            assert of["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(HTML)}" and held.endswith(HTML) and block.endswith(b"\r\n\r\n")
    assert {h["WARC-Date"] for h, _ in rows} == {"1997-01-01T00:00:00Z", "1998-02-03T00:00:00Z", "1996-05-05T00:00:00Z", "1996-01-01T00:00:00Z"}


def test_small_payloads_stay_whole(spark, tmp_path):
    (tmp_path / "one.arc").write_bytes(version_1())
    warc.convert_folder(spark, str(tmp_path / "one.arc"), str(tmp_path / "out"), min_bytes=len(HTML) + 1)
    assert not [r for r in warc.read_warc_files(spark, str(tmp_path / "out")).collect() if r.headers["WARC-Type"] == "revisit"]


@pytest.mark.parametrize(("content", "what"), [(version_1()[:-20], "shorter"), (b"no arc at all\n", "length"), (b"filedesc://x 0 0 text/plain 5\n9 0 x\n", "version"), (gzip.compress(version_1())[:-30], "x.arc"), (b"filedesc://x 0 0 text/plain 9", "end")])
def test_broken_files_are_named(spark, tmp_path, content, what):
    (tmp_path / "x.arc").write_bytes(content)
    with pytest.raises(Exception, match=what) as e:
        warc.read_arc_files(spark, str(tmp_path / "x.arc")).collect()
    assert "x.arc" in str(e.value)
