import base64
import hashlib

import pytest

from vekspar.llm import warc


def sha(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"", b"HTTP/1.1 200 OK\r\n\r\nhi", b"WARC/1.1\r\n\r\n\n\nhttp://x 0.0.0.0 1 text/html 4\n", bytes(range(256)) * 3]
    rows = [(f"http://h/{i} é", warc.DATE, "text/html", x) for i, x in enumerate(bodies)]
    got = list(warc.read_arc(warc.arc_file("a.arc", version, rows)))
    assert [b for _, b in got] == bodies and all(int(h["Archive-length"]) == len(b) for h, b in got)


def test_short_and_unknown_archives_are_errors():
    data = warc.arc_file("a.arc", 1, [("http://h/", warc.DATE, "text/html", b"x" * 50)])
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-20]))
    with pytest.raises(ValueError):
        list(warc.read_arc(data.replace(b"1 0 -", b"7 0 -")))


def test_conversion_is_stable_and_complete():
    arc = warc.arc_file("a.arc", 2, [("http://h/1", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 1\r\n\r\nbody")])
    a, b = warc.convert(arc, {}), warc.convert(arc, {})
    (info, about), (head, block) = warc.read_warc(a)
    assert info["WARC-Type"] == "warcinfo" and info["WARC-Filename"] == "a.warc.gz" and b"format: WARC File Format 1.1" in about and head["WARC-Warcinfo-ID"] == info["WARC-Record-ID"]
    assert a == b and head["WARC-Date"] == "2020-01-02T03:04:05Z" and head["WARC-Type"] == "response"
    assert head["WARC-Payload-Digest"] == f"sha1:{sha(b'body')}" and block.endswith(b"body")


def test_pages(spark):
    html = ["a", "b", "a", None, "", "HTTP/1.1 200 OK\r\n\r\nx", "é\r\n\r\nWARC/1.1", "a", "x" * 100_000]
    rows = [(i * 3, f"http://h/{i} ü" if i else None, h, 1) for i, h in enumerate(html)] + [(6, "http://again", "a", 1), (None, None, "a", 1), (None, None, "only", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.read_archives(warc.write_archives(warc.record_types(pages))).collect()
    want = []
    first = {}
    for p, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        x = (h or "").encode()
        of = first.setdefault(x, p)
        new = (x, 0) not in first
        first[x, 0] = 1
        want.append((p, len(x), sha(x), "response" if new else "revisit", None if new else of))
    key = lambda r: tuple(map(str, r))
    mine = [(None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.record_types(none))).count() == 0


def test_every_revisit_refers_to_a_response(spark, tmp_path):
    import gzip

    rows = [(i % 40, f"http://h/{i % 3}", "same" if i % 2 else f"p{i % 5}" * 2000) for i in range(200)] + [(None, None, "same")] * 3
    for parts in (1, 7):
        made = warc.write_archives(warc.record_types(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)))
        got = warc.read_archives(made).collect()
        ids = {r.record_id: r for r in got}
        assert len(ids) == len(got) == len(rows)
        for r in got:
            if r.record_type == "revisit":
                of = ids[r.refers_to_id]
                assert of.record_type == "response" and of.payload_digest == r.payload_digest and of.page_id == r.refers_to
        responses = {(r.page_id, r.record_id) for r in got if r.record_type == "response"}
        assert parts == 1 or responses == before
        before = responses
    files = warc.save_archives(made, str(tmp_path / "out")).collect()
    read = [h["WARC-Record-ID"] for f in files for h, _ in warc.read_warc(open(f.path, "rb").read(), 100) if h["WARC-Type"] != "warcinfo"]
    assert sorted(read) == sorted(ids) and all(gzip.open(f.path).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in files)


def test_very_long_payload(spark):
    page = spark.createDataFrame([(1, "http://h/", "<p>é</p>" * 1_500_000)], "page_id long, url string, html string")
    r = warc.read_archives(warc.write_archives(warc.record_types(page))).first()
    assert r.payload_bytes == 9 * 1_500_000 and r.record_type == "response"
