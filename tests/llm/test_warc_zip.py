from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile

import pytest

from kavram.llm import warc_zip as Z

PAGES = "page_id long, url string, html string, status string, error int"


def test_round_trip(spark):
    rows = [
        (1, "http://a.example/x", "<p>é\r\n\r\nx</p>", "s", 1),
        (1, "http://a.example/x", "<p>é\r\n\r\nx</p>", "s", 1),
        (2, "http://b.example/a b\n", "", None, None),
        (3, None, "y" * 3_000_000, None, None),
        (None, "not an url [", None, None, None),
        (None, None, None, None, None),
    ]
    got = Z.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    want = [(p, Z._safe(u) if u is not None else None, 204 if h is None else 200, "text/html", h, None) for p, u, h, _, _ in rows]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_empty(spark):
    assert Z.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def package(path, members, **options):
    with zipfile.ZipFile(path, "w") as z:
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, method)
        z.comment = options.get("comment", b"")
    return path


def archive(n, gz=True):
    data, lines, at = b"", [], 0
    for i in range(n):
        part = Z._record(i, f"http://h{i}.example/", f"page {i}")
        part = gzip.compress(part) if gz else part
        lines.append(f"key{i} 2024 " + json.dumps({"offset": str(at), "length": len(part), "filename": "a.warc.gz"}))
        data += part
        at += len(part)
    return data, "\n".join(["!meta {}", *lines, "broken line"]).encode()


def read(spark, *paths, **options):
    return [tuple(r) for r in Z.read(spark.createDataFrame([(f"file://{p}",) for p in paths], "package string"), **options).collect()]


def test_members_with_and_without_index(spark, tmp_path):
    data, index = archive(5)
    want = sorted((i, f"http://h{i}.example/", 200, "text/html", f"page {i}", None) for i in range(5))
    stored, packed = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
    a = package(tmp_path / "a.wacz", [("archive/a.warc.gz", data, stored), ("indexes/index.cdxj", index, packed)], comment=b"PK\x05\x06" + b"x" * 40)
    b = package(tmp_path / "b.wacz", [("archive/a.warc.gz", data, stored), ("indexes/index.cdx.gz", gzip.compress(index), stored)])
    c = package(tmp_path / "c.wacz", [("x/y", b"", stored), ("archive/a.warc.gz", data, stored)])
    d = package(tmp_path / "d.wacz", [("archive/a.warc", archive(5, False)[0], stored)])
    for p in (a, b, c, d):
        assert sorted(read(spark, p)) == want
        assert sorted(read(spark, p, split_bytes=1)) == want


def test_what_cannot_be_read(spark, tmp_path):
    data, index = archive(2)
    packed = package(tmp_path / "p.wacz", [("archive/a.warc.gz", data, zipfile.ZIP_DEFLATED)])
    (tmp_path / "n.wacz").write_bytes(b"no zip at all")
    cut = package(tmp_path / "c.wacz", [("archive/a.warc.gz", data[:-40], zipfile.ZIP_STORED)])
    far = package(tmp_path / "f.wacz", [("archive/a.warc.gz", data[:10], zipfile.ZIP_STORED), ("indexes/i.cdx", index, zipfile.ZIP_STORED)])
    for p, good in ((packed, 0), (tmp_path / "n.wacz", 0), (cut, 1), (far, 0), (tmp_path / "absent.wacz", 0)):
        got = read(spark, p)
        assert sum(r[5] is None for r in got) == good and any(r[5] for r in got), p


def test_zip64_directory():
    """A package whose end record is all ones, as one over 4 GB or 65,535 members is."""
    out = io.BytesIO()
    Z.write_package(Z._Sink(out), iter([(1, "http://a.example/", "x")]))
    data = out.getvalue()
    plain = list(Z.members(lambda a, n: data[a : a + n], len(data)))
    end = data.rfind(b"PK\x05\x06")
    count, size, offset = struct.unpack_from("<HII", data, end + 10)
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    big = data[:end] + record + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert list(Z.members(lambda a, n: big[a : a + n], len(big))) == plain
    broken = data[:end] + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    with pytest.raises(Z.BrokenPackage):
        list(Z.members(lambda a, n: broken[a : a + n], len(broken)))


def test_zip64_fields_of_a_member():
    extra = struct.pack("<HHQQQ", 1, 24, 5_000_000_000, 5_000_000_000, 6_000_000_000)
    head = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    directory = head + b"m" + extra
    data = directory + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, len(directory), 0, 0)
    assert list(Z.members(lambda a, n: data[a : a + n], len(data))) == [Z.Member("m", 0, 5_000_000_000, 5_000_000_000, 6_000_000_000)]


def test_only_the_ranges_are_read(tmp_path):
    """Besides its directories, a package is read where its records are."""
    out = io.BytesIO()
    Z.write_package(Z._Sink(out), ((i, f"http://h{i}.example/", "z" * 50_000 + str(i)) for i in range(40)), level=0)
    data, asked = out.getvalue(), []

    def read_at(a, n):
        asked.append(n)
        return data[a : a + n]

    splits = list(Z.splits_of(read_at, len(data), 120_000))
    assert sum(asked) < len(data) / 5 and len(splits) >= 15
    assert sum(len(s[2]) for s in splits) == 40


def test_damaged_indexes_lose_nothing(spark, tmp_path):
    """An error row for the damaged part; every record of the archive beside it is read."""
    data, index = archive(5)
    want = sorted((i, f"http://h{i}.example/", 200, "text/html", f"page {i}", None) for i in range(5))
    lines = index.decode().split("\n")
    bad = lambda i, text: "\n".join([*lines[:i], text, *lines[i + 1 :]]).encode()
    stored = zipfile.ZIP_STORED
    cases = [
        ("a", "indexes/i.cdxj", bad(2, 'key 2024 {"offset": null, "length": 5, "filename": "a.warc.gz"}')),
        ("b", "indexes/i.cdxj", bad(3, 'key 2024 {"offset": "7", "length')),
        ("c", "indexes/i.cdxj", bad(3, 'key 2024 {"offset": Infinity, "length": 3}')),
        ("d", "indexes/i.cdx.gz", gzip.compress(index)[:-30]),
        ("e", "indexes/i.cdxj", bad(3, "key 2024 " + '{"a":' * 100_000)),
    ]
    for name, member, raw in cases:
        got = read(spark, package(tmp_path / name, [("archive/a.warc.gz", data, stored), (member, raw, stored)]))
        assert sorted(r for r in got if r[5] is None) == want and sum(r[5] is not None for r in got) == 1, name


def test_damaged_members_leave_the_others(spark, tmp_path):
    data, index = archive(3)
    good = package(tmp_path / "g", [("archive/a.warc.gz", data, zipfile.ZIP_STORED), ("archive/b.warc.gz", data, zipfile.ZIP_STORED), ("indexes/i.cdxj", index, zipfile.ZIP_STORED)])
    raw = good.read_bytes()
    second = raw.index(b"PK\x03\x04", 4)
    header, directory = tmp_path / "h", tmp_path / "d"
    header.write_bytes(raw[:second] + b"XXXX" + raw[second + 4 :])
    last = raw.rindex(b"PK\x01\x02")
    directory.write_bytes(raw[:last] + b"XXXX" + raw[last + 4 :])
    got = read(spark, header)
    assert sum(r[5] is None for r in got) == 3 and sum(r[5] is not None for r in got) == 1
    got = read(spark, directory)  # the index is behind the cut: both archives are walked
    assert sum(r[5] is None for r in got) == 6 and sum(r[5] is not None for r in got) == 1


@pytest.mark.parametrize("extra", [struct.pack("<HHQ", 1, 8, 5_000_000_000), struct.pack("<HH", 1, 24), b"\x01\x00\x10"])
def test_short_zip64_field(extra):
    head = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 16, len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    directory = head + b"archive/a.warc.x"[:16] + extra
    data = directory + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, len(directory), 0, 0)
    found = list(Z.members(lambda a, n: data[a : a + n], len(data)))
    assert len(found) == 1 and found[0].fault


def test_odd_headers(spark, tmp_path):
    parts = []
    for page, status in ((str(1 << 70), "200"), ("one", "99999999999"), ("-4", "\u00b2\u00b2\u00b2")):
        block = f"HTTP/1.1 {status} x\r\nContent-Type: text/html\r\n\r\nbody".encode()
        parts.append(f"WARC/1.1\r\nWARC-Type: response\r\nPage-Id: {page}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    negative = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: -5\r\n\r\nbody"
    p = package(tmp_path / "o", [("archive/a.warc", b"".join(parts) + negative, zipfile.ZIP_STORED)])
    got = read(spark, p)
    assert sorted([(r[0], r[2], r[4]) for r in got if r[5] is None], key=str) == sorted([(None, 200, "body"), (None, None, "body"), (-4, None, "body")], key=str)
    assert sum(r[5] is not None for r in got) == 1


def test_ids_that_are_words(spark):
    rows = spark.createDataFrame([("7", "http://a.example/", "x"), ("seven", "http://b.example/", "y")], "page_id string, url string, html string")
    assert {(r.page_id, r.html) for r in Z.round_trip(rows).collect()} == {(7, "x"), (None, "y")}
