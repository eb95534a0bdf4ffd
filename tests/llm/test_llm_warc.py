import pytest

from fleetgauge.llm import warc
from fleetgauge.session import new_folder

ODD = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhéllo\r\n\r\nWARC/1.1\r\n\r\n"
PAGES = [
    (1, "http://a.org/", "same"), (2, "http://b.org/", "same"), (9, None, "same"),
    (9, None, "same"), (3, "x\r\ny", None), (4, "http://c.org/", ""), (5, "u", ODD),
    (None, "n", "same"), (None, "n", "only"), (None, "n", "only"), (6, "long", "ab" * 900_000),
]
SCHEMA = "page_id bigint, url string, html string"


def plain(rows, min_bytes=0):
    out = []
    for page, _, html in rows:
        code = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(ids) if len(code) >= min_bytes and ids else page
        kind = "response" if first == page else "revisit"
        out.append((page, len(code), warc.digest(code), kind, first if first != page else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 1, 5])
def test_archives_read_back(spark, frame, min_bytes):
    found = warc.archived(frame(PAGES, SCHEMA), min_bytes)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(PAGES, min_bytes)


def test_payloads_survive_and_index_points_at_records(spark, frame):
    folder = new_folder(spark, "warc-test")
    warc.write_archives(frame(PAGES, SCHEMA).coalesce(1), folder)
    index = warc.build_index(spark, folder)
    rows = {r.page_id: r for r in index.filter("page_id IN (5, 6)").collect()}
    with warc._opened(rows[5].path) as file:
        file.seek(rows[5].offset)
        record = file.read(rows[5].length)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and record.endswith(b"\r\n\r\n")
    payloads = {r.page_id: r.payload for r in warc.read_records(index).collect()}
    assert bytes(payloads[5]) == ODD.encode()
    assert bytes(payloads[6]) == b"ab" * 900_000
    assert payloads[1] is None
    some = warc.read_records(index.filter("page_id IN (4, 9)")).collect()
    assert {r.page_id for r in some} == {4, 9}


def test_empty_table(spark, frame):
    assert warc.archived(frame([], SCHEMA)).collect() == []
