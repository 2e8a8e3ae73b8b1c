"""Stored ARC files of both versions, plain and of gzip members, through the converter and read again."""

import glob
import gzip

import pytest

from edgeprobe.llm import arc, warc

JPEG = b"HTTP/1.0 200 OK\r\nContent-Type: image/jpeg\r\n\r\n\xff\xd8\xff\xe0 \r\n\r\n WARC/1.1 \x00\xfe"


def stored(records, version):
    return warc.arc_file(records, version)


def test_conversion(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"
    same = b"HTTP/1.1 200 OK\r\nServer: other\r\n\r\n<p>hello</p>"
    one = [("http://a.example/", "192.0.2.1", "19970103120000", "text/html", page), ("http://a.example/x.jpg", "192.0.2.1", "199805", "image/jpeg", JPEG), ("http://a.example/none", "192.0.2.2", "2001", "text/html", b"HTTP/1.1 204 No\r\n\r\n")]
    two = [("http://b.example/ä b", "198.51.100.7", "19960229235959", "text/html", same), ("dns:b.example", "198.51.100.7", "20020101", "text/dns", b"b.example. 60 IN A 198.51.100.7"), ("http://b.example/e", "0.0.0.0", "2003123123", "text/html", b"HTTP/1.1 204 No\r\n\r\n")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.arc").write_bytes(stored(one, 1))
    whole = stored(two, 2)
    cuts = [0, whole.index(b"http://b.example"), whole.index(b"dns:"), len(whole)]
    (tmp_path / "in" / "two.arc.gz").write_bytes(b"".join(gzip.compress(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))
    (tmp_path / "in" / "empty.arc").write_bytes(stored([], 1))
    arc.convert(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    found = {}
    for f in glob.glob(f"{tmp_path}/out/part-*"):
        with open(f, "rb") as file:
            for fields, block in warc.warc_records(file.read()):
                found[fields["warc-target-uri"]] = fields, bytes(block)
    assert len(found) == 6
    dates = {u: f["warc-date"] for u, (f, _) in found.items()}
    assert dates["http://a.example/"] == "1997-01-03T12:00:00Z" and dates["http://a.example/x.jpg"] == "1998-05-01T00:00:00Z" and dates["http://a.example/none"] == "2001-01-01T00:00:00Z"
    assert dates["dns:b.example"] == "2002-01-01T00:00:00Z" and dates["http://b.example/e"] == "2003-12-31T23:00:00Z"
    first, block = found["http://b.example/ä b"]
    assert first["warc-type"] == "response" and block == same and first["warc-ip-address"] == "198.51.100.7"
    again, block = found["http://a.example/"]  # the later of equal payloads, in another file of another version
    assert again["warc-type"] == "revisit" and again["warc-refers-to"] == first["warc-record-id"] and block == page.split(b"<p>")[0]
    assert again["warc-payload-digest"] == first["warc-payload-digest"] == f"sha1:{warc.base32(b'<p>hello</p>')}"
    fields, block = found["http://a.example/x.jpg"]
    assert block == JPEG and fields["warc-block-digest"] == f"sha1:{warc.base32(JPEG)}" and fields["content-type"].startswith("application/http")
    assert found["dns:b.example"][0]["content-type"] == "text/dns"
    assert {found[u][0]["warc-type"] for u in ("http://a.example/none", "http://b.example/e")} == {"response"}
    assert len({f["warc-record-id"] for f, _ in found.values()}) == 6


def test_dates_and_damage():
    assert [arc.full_date(x) for x in ("1996", "199612", "19961231", "1996123123", "19961231235958")] == ["19960101000000", "19961201000000", "19961231000000", "19961231230000", "19961231235958"]
    for bad in ("", "96", "1996-01-01"):
        with pytest.raises(ValueError):
            arc.full_date(bad)
    with pytest.raises(ValueError):
        arc.unpacked(gzip.compress(b"x" * 100)[:-4])
    with pytest.raises(ValueError):
        list(arc._records(stored([("u", "1.1.1.1", "1996", "t", b"abc")], 1)[:-3]))
