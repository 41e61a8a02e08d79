import base64
import gzip
import hashlib

import pytest

from sparkloom.llm import arc


def record_lines(version):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>a\n\nURL like http://x 1 2 3</p>"
    bodies = [("http://a.example/", http), ("http://b.example/with blank", b"plain\n"), ("http://c.example/", b""), ("dns:d.example", b"20200101\nd 1.2.3.4")]
    data = arc.version_block("t.arc", "20200102030405", version)
    for url, body in bodies:
        start = f"\n{url} 1.2.3.4 20200102030405 text/html " + ("200 abc - 17 t.arc " if version == 2 else "") + f"{len(body)}\n"
        data += start.encode() + body
    return data, bodies


@pytest.mark.parametrize("version", [1, 2])
def test_parse_both_versions(version):
    data, bodies = record_lines(version)
    for packed in (data, gzip.compress(data), gzip.compress(data[:300]) + gzip.compress(data[300:])):
        block, *found = arc.parse_arc(packed)
        assert block.is_version_block and block.body.startswith(b"%d 0 " % version)
        assert {tuple(r.fields.items()) for r in found} == {(("Result-code", "200"), ("Checksum", "abc"), ("Offset", "17"), ("Filename", "t.arc")) if version == 2 else ()}
        assert [(r.url.decode(), r.body, r.truncated) for r in found] == [(u, b, False) for u, b in bodies]
        assert {r.ip for r in found} == {b"1.2.3.4"} and {r.date for r in found} == {b"20200102030405"}


def test_torn_and_odd_files():
    data, bodies = record_lines(1)
    *_, last = arc.parse_arc(data[:-5])
    assert last.truncated and last.body == bodies[-1][1][:-5]
    assert list(arc.parse_arc(b"")) == [] and list(arc.parse_arc(b"\n\n")) == []
    for odd in (b"no header", b"no length here\nx\n", b"x 1.2.3.4 2020 text/html x1\nabc"):
        assert all(r.damage for r in arc.parse_arc(odd)) and b"".join(r.body for r in arc.parse_arc(odd)) == odd
    torn = list(arc.parse_arc(gzip.compress(data)[:-30]))
    assert [r.body for r in torn[1:-1]] == [b for _, b in bodies[: len(torn) - 2]] and (torn[-1].truncated or torn[-1].damage)


def members(seed=0):
    """A version block and 30 records, each a gzip member of its own, and the records' bodies."""
    import random

    rng = random.Random(seed)
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n" + rng.randbytes(rng.randrange(40, 4000)) for _ in range(30)]
    parts = [arc.version_block("m.arc", "20200101000000")] + [arc.arc_record(f"http://x/{k}", "1.2.3.4", "20200101000000", "text/html", b) for k, b in enumerate(bodies)]
    return [gzip.compress(p) for p in parts], bodies


@pytest.mark.parametrize("seed", range(12))
def test_records_after_a_damaged_member_are_found(seed):
    import random

    packed, bodies = members(seed)
    rng = random.Random(seed)
    k = rng.randrange(1, 30)
    bad = bytearray(packed[k])
    at = rng.randrange(12, len(bad))
    bad[at : at + 4] = bytes(b ^ 0x5A for b in bad[at : at + 4])
    if seed % 3 == 0:
        bad = bad[: len(bad) // 2]
    data = b"".join([*packed[:k], bytes(bad), *packed[k + 1 :]])
    found = list(arc.parse_arc(data))
    whole = [r.body for r in found if not r.damage and not r.truncated and not r.is_version_block]
    sound = bodies[: k - 1] + bodies[k:]
    assert [b for b in whole if b in sound] == sound and len(whole) <= 30
    torn = [r for r in found if r.truncated or r.damage]
    assert torn or len(whole) == 30  # damage leaves a mark, unless it is in the check sum alone


def test_a_header_line_without_a_length_loses_its_own_record_only():
    data, bodies = record_lines(1)
    wrong = data.replace(b"http://b.example/with blank 1.2.3.4 20200102030405 text/html 6", b"http://b.example/with blank 1.2.3.4 20200102030405 text/html")
    assert wrong != data
    found = [r for r in arc.parse_arc(wrong) if not r.is_version_block]
    assert [r.body for r in found if not r.damage] == [bodies[k][1] for k in (0, 2, 3)]
    assert [r.damage for r in found if r.damage] == ["a header line without its fields"] and b"plain" in next(r.body for r in found if r.damage)


def test_only_the_first_record_is_a_version_block(spark):
    pages = [(1, "filedesc://not-a-block", "one"), (2, "http://x", "two")]
    found = arc.archived_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in found) == [1, 2]


@pytest.mark.parametrize(("date", "want"), [(b"20200102030405", "2020-01-02T03:04:05Z"), (b"199612", "1996-12-01T00:00:00Z"), (b"1997", "1997-01-01T00:00:00Z"), (b"19970000000000", "1997-01-01T00:00:00Z"), (b"x", "1970-01-01T00:00:00Z")])
def test_dates(date, want):
    assert arc.iso_date(date) == want


def test_conversion():
    data, _ = record_lines(1)
    rows = [arc.converted(r) for r in arc.parse_arc(data)]
    assert rows.pop(0)["record_type"] == "warcinfo" and [r["record_type"] for r in rows] == ["response", "resource", "resource", "resource"]
    assert rows[0]["payload"].startswith(b"<p>") and rows[0]["http_header"].endswith(b"\r\n\r\n") and rows[0]["date"] == "2020-01-02T03:04:05Z"
    assert rows[0]["payload_digest"] == base64.b32encode(hashlib.sha1(rows[0]["payload"]).digest()).decode()
    assert len({r["record_id"] for r in rows}) == 4 and rows == [arc.converted(r) for r in arc.parse_arc(data)][1:]


PAGES = [(5, "http://a", "same"), (3, "http://b c", "same"), (9, None, "same"), (4, "http://d", "WARC/1.1\r\n\r\nother\r\n\r\n"), (8, "http://e", None), (7, "http://f", ""), (None, "http://g", "same"), (6, "http://é", "É" * 100_000), (2, "http://h", "twice"), (2, "http://h", "twice")]


def expected(rows, min_bytes):
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        first[b] = min(first.get(b, i if i is not None else 1 << 60), i if i is not None else 1 << 60)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = len(b) >= min_bytes and first[b] != i and first[b] != 1 << 60
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("min_bytes", [0, 1, 5])
@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_pages_through_archives(spark, clashing, monkeypatch, min_bytes, broadcast):
    monkeypatch.setattr(arc, "BROADCAST_PAYLOADS", broadcast)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", *clashing)
    found = arc.archived_pages(pages, min_bytes).collect()
    assert sorted(map(repr, map(tuple, found))) == expected(PAGES, min_bytes)


def test_segments_hold_both_versions_and_files_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    segments = [bytes(r[0]) for r in arc.pages_to_arc(pages, 10).collect()]
    assert {s.split(b"\n")[1][:1] for s in segments} == {b"1", b"2"} and sum(len(list(arc.parse_arc(s))) - 1 for s in segments) == len(PAGES)
    records = arc.mark_revisits(arc.arc_to_warc(arc.pages_to_arc(pages, 10)), arc.page_id(arc.F.col("http_header")))
    arc.write_warc(records, f"file://{tmp_path}/warc")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").rglob("*.gz"))
    at = n = 0
    while at < len(data):  # every record ends in two blank lines, right where its length says
        end = data.index(b"\r\n\r\n", at)
        size = int(dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])[b"Content-Length"])
        at = end + 4 + size
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(PAGES) + len(segments)
    read = arc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    info = {r["record_id"]: r["payload"] for r in read if r["record_type"] == "warcinfo"}
    assert len({bytes(x) for x in info.values()}) == 2
    for r in read:
        if r["record_type"] != "warcinfo":
            second = bytes(info[r["fields"]["WARC-Warcinfo-ID"]]).startswith(b"2")
            assert (r["fields"].get("X-Arc-Result-code"), r["fields"].get("X-Arc-Offset")) == (("200", "0") if second else (None, None))


def test_damage_reaches_the_warc(spark, tmp_path):
    packed, _ = members()
    data = b"".join([*packed[:5], packed[5][: len(packed[5]) // 2], *packed[6:]]) + gzip.compress(b"rubbish at the end")
    records = arc.arc_to_warc(spark.createDataFrame([(data,), (None,), (b"",)], "content binary")).withColumn("refers_to", arc.F.lit(None).cast("string"))
    arc.write_warc(records, f"file://{tmp_path}/warc")
    read = arc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    kinds = [r["record_type"] for r in read]
    assert kinds.count("warcinfo") == 1 and kinds.count("response") == 30
    assert [bytes(r["payload"]) for r in read if r["fields"].get("X-Damage")] == [b"rubbish at the end"]
    assert sum("WARC-Truncated" in r["fields"] for r in read) == 1


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(arc, "FILE_RECORDS", 20)
    pages = [(k, f"http://x/{k}", f"{k} " + "y" * (9000 if k % 4 == 0 else 100)) for k in range(60)] + [(99, "http://long", "z" * 300_000)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    records = arc.written(arc.arc_to_warc(arc.pages_to_arc(pages)), "t").withColumn("refers_to", arc.F.lit(None).cast("string"))
    arc.write_warc(records, f"file://{tmp_path}/warc")
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "warc").rglob("*.gz")]
    assert sum(s > 60_000 for s in sizes) == 1 and len(sizes) < 30
    assert arc.read_warc(spark, f"file://{tmp_path}/warc").count() == 62


def test_a_wrong_digest_is_an_error():
    text = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(arc.parse_warc(text))
    for torn in (text[:-30], b"nothing"):
        with pytest.raises((ValueError, KeyError)):
            list(arc.parse_warc(torn))


def test_empty_table(spark):
    assert arc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
