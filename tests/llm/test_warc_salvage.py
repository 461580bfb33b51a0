"""The salvage reader on archives of other writers and on damaged members."""

import gzip
import io
import random

import pytest

from plinth.llm import warc


def plain(name, payload):
    return warc.encode_record("response", name, None, payload, compress=False)


def found(raw):
    out = list(warc.salvage(io.BytesIO(raw)))
    return [r.headers["X-Page-Id"] for r in out if isinstance(r, warc.Record)], [(g.start, g.end, g.reason) for g in out if isinstance(g, warc.Gap)]


def foreign(name, body, crlf=b"\r\n"):
    head = [b"WARC/1.0", b"warc-type:resource", b"CONTENT-LENGTH:%d" % len(body), b"x-page-id:  " + name.encode(), b"Note: first", b"  second"]
    return crlf.join(head) + crlf * 2 + body + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
@pytest.mark.parametrize("crlf", [b"\r\n", b"\n"])
def test_fields_of_any_case_and_spacing(pack, crlf):
    raw = pack(foreign("a", b"one", crlf)) + pack(foreign("b", b"", crlf))
    assert found(raw) == (["a", "b"], [])
    first = next(warc.salvage(io.BytesIO(raw)))
    assert first.block == b"one" and first.headers["NOTE"] == "first second" and first.headers.get("none") is None


def test_members_of_several_records():
    members = [gzip.compress(plain("a", b"1") + plain("b", b"2") + plain("c", b"")), gzip.compress(plain("d", b"4"))]
    assert found(b"".join(members)) == (["a", "b", "c", "d"], [])


def test_a_cut_off_member_gives_what_stands_before_the_cut():
    r = random.Random(3)
    whole = gzip.compress(b"".join(plain(str(k), r.randbytes(3000)) for k in range(6)))
    names, gaps = found(whole[: len(whole) * 2 // 3])
    assert names == ["0", "1", "2"] and gaps == [(0, len(whole) * 2 // 3, "gzip member is cut off")]
    # and the records behind it are found
    tail = gzip.compress(plain("t", b"x"))
    cut = whole[: len(whole) // 2]
    names, gaps = found(cut + tail)
    assert names[-1] == "t" and names[:-1] == ["0", "1"] and [g[:2] for g in gaps] == [(0, len(cut))]


def test_a_bad_record_within_a_member_is_a_gap():
    bad = plain("b", b"22222").replace(b"22222", b"23222")
    member = gzip.compress(plain("a", b"1") + bad + plain("c", b"3"))
    names, gaps = found(member + gzip.compress(plain("d", b"4")))
    assert names == ["a", "c", "d"] and gaps == [(0, len(member), "block digest differs")]


def test_flipped_bits_anywhere_lose_at_most_their_members():
    r = random.Random(7)
    members = [gzip.compress(plain(str(k), r.randbytes(r.randint(0, 900)))) for k in range(12)]
    raw = b"".join(members)
    for _ in range(150):
        spoiled = bytearray(raw)
        at = r.randrange(len(raw))
        spoiled[at] ^= 1 << r.randrange(8)
        names, _ = found(bytes(spoiled))
        assert len(set(map(str, range(12))) - set(names)) <= 1 and len(names) == len(set(names))


@pytest.mark.parametrize("raw", [b"", b"WARC/1.0", b"WARC/1.0\r\n\r\n", b"\x1f\x8b\x08", b"\x1f\x8b\x08" * 50, b"x" * 3_000_000])
def test_what_holds_no_record(raw):
    names, gaps = found(raw)
    assert names == [] and ([g[:2] for g in gaps] == [(0, len(raw))] if raw else gaps == [])


def test_a_payload_larger_than_a_read():
    big = random.Random(1).randbytes(5 << 20)
    for compress in (True, False):
        raw = warc.encode_record("response", "big", None, big, compress=compress) + warc.encode_record("response", "z", None, b"", compress=compress)
        out = list(warc.salvage(io.BytesIO(raw)))
        assert [x.headers["X-Page-Id"] for x in out] == ["big", "z"] and out[0].http[1] == big


@pytest.mark.parametrize("html", ["text", None])
def test_pages_of_null_and_repeated_ids(spark, html):
    rows = [(1, None, html), (1, None, html), (2, None, html), (None, "http://x", "other"), (None, None, "other"), (3, "u\r\nv", "é" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({}).selectExpr("*", "'x' as digest", "1 as payload", "2 as refers_to")
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "response", None), (None, "response", None), (3, "response", None)], key=str)


@pytest.mark.parametrize("version", ["0.17", "0.18", "1.0", "1.1", "2.0"])
def test_records_behind_damage_in_any_version(version):
    import io

    record = lambda k: f"WARC/{version}\r\nWARC-Type: resource\r\nX-Page-Id: {k}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    for damage in (b"\x00" * 8, b"WARC/", b"WARC/9", b"\x1f\x8b\x08 WARC/x"):
        found = list(warc.salvage(io.BytesIO(record(1) + damage + record(2) + record(3) + damage)))
        assert [x.headers["X-Page-Id"] for x in found if isinstance(x, warc.Record)] == ["1", "2", "3"]
        assert [x.end - x.start for x in found if isinstance(x, warc.Gap)] == [len(damage)] * 2
