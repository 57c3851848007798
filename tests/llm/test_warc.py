import base64
import hashlib
import io

import pytest
import zstandard

from lexloom.llm import warc as A
from lexloom.llm.common import fresh_dir, open_fs

PAGES = "page_id long, url string, html string, digest string, first long"


def rows():
    big = "<p>x</p>" * 200_000
    out = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (1, "http://b/ \n", None), (2, "u", ""), (7, "http://é.com/x", "käse\r\n\r\n漢"), (8, "x", "a"), (8, "x", "a"), (20, "x", "a"), (None, "n", "a"), (None, "n", "alone"), (11, "big", big), (12, "big", big), (4, "ends", "\r\n\r\nWARC/1.1\r\n\r\n")]
    return [(*r, "d", 1) for r in out] + [(100 + i, "hot", "hot", "d", 1) for i in range(300)]


def want(min_bytes=0):
    first = {}
    given = rows()
    for k, _, h, *_ in given:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    out = []
    for k, _, h, *_ in given:
        payload = (h or "").encode()
        again = first.get(h or "") is not None and k != first[h or ""] and len(payload) >= min_bytes
        out.append(str((k, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 2, 10_000])
def test_read_back(spark, least):
    pages = spark.createDataFrame(rows(), PAGES)
    assert sorted(str(tuple(r)) for r in A.write_and_read(pages, least).collect()) == want(least)


def test_no_pages(spark):
    assert A.write_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_index_fetches_each_record(spark):
    pages = spark.createDataFrame([r for r in rows() if r[0] != 8], PAGES)
    index = A.write_archives(pages, fresh_dir(spark, "test")).collect()
    assert len(index) == pages.count()
    html = {r[0]: r[2] for r in rows()}
    for e in index:
        one = A.fetch(e["path"], e["frame"], e["offset"], e["length"])
        assert one["page_id"] == e["page_id"]
        if one["record_type"] == "response" and e["page_id"] is not None:
            assert one["payload"] == (html[e["page_id"]] or "").encode()


def test_frames_are_plain_zstandard_and_checked(spark):
    index = A.write_archives(spark.createDataFrame(rows(), PAGES), fresh_dir(spark, "test")).collect()
    filesystem, local = open_fs(index[0]["path"])
    with filesystem.open_input_file(local) as f:
        data = f.read()
    table = A.seek_table(io.BytesIO(data), len(data))
    plain = zstandard.ZstdDecompressor().decompress(data[table[0][0] : table[0][0] + table[0][1]])
    assert plain.startswith(b"WARC/1.1\r\n") and plain == A.read_frame(io.BytesIO(data), table[0])
    assert sum(r[1] for r in table) + 8 + 12 * len(table) + 9 == len(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken = bytearray(data)
        broken[table[0][1] // 2] ^= 255
        A.read_frame(io.BytesIO(bytes(broken)), table[0])


def test_archives_are_closed_after_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 30_000)
    pages = spark.createDataFrame(rows(), PAGES)
    index = A.write_archives(pages, fresh_dir(spark, "test"))
    paths = sorted(r[0] for r in index.select("path").distinct().collect())
    assert len(paths) > 4  # more than one a task
    assert sorted(str(tuple(r)) for r in A.read_archives(spark, paths).collect()) == want()
