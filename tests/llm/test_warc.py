import gzip
import hashlib

import pytest

from lumenrel.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, start int")


ROWS = [
    (1, "http://a/é b", "x" * 999, "clash", 1),
    (2, None, "x" * 999, None, 1),
    (3, "http://b/", "é" * 500, None, None),
    (4, "http://b/", "é" * 500, None, 1),
    (9, "http://c/", "é" * 500, None, 1),
    (5, "http://d/\r\nX: y", None, None, 1),
    (6, "", "", None, 1),
    (7, "http://e/", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 100, None, 1),
    (8, "http://long/", "".join(chr(33 + (i * i) % 90) for i in range(400_000)), None, 1),
    (9, "http://c/", "é" * 500, None, 1),
]


def expected(rows):
    keep = {}
    for page_id, _, html, *_ in rows:
        keep[html or ""] = max(keep.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and keep[html or ""] != page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keep[html or ""] if again else None))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("split", [64, 1000, 8 << 20])
def test_round_trip_over_any_split(spark, split):
    from lumenrel.llm._common import scratch

    manifest = warc.write_archives(warc.plan_revisits(pages(spark, ROWS).coalesce(2)), scratch(spark, "warc"))
    back = warc.read_archives(manifest, split_bytes=split).cache()
    assert digest(back) == expected(ROWS)
    texts = {r["page_id"]: r["payload"] for r in back.collect() if r["payload"] is not None}
    assert texts[7].decode() == ROWS[7][2] and texts[8].decode() == ROWS[8][2]
    store, path = warc.open_store(manifest.first()["path"])
    with store.open_input_stream(path, compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


def record(page_id, payload, level=None):
    member = warc.encode_record(page_id, "u", payload, hashlib.sha1(payload).hexdigest(), None, "2024-01-01T00:00:00Z")
    return member if level is None else gzip.compress(gzip.decompress(member), compresslevel=level)


def manifest(spark, file, data, records=None):
    file.write_bytes(data)
    return spark.createDataFrame([(f"file://{file}", len(data), records)], "path string, bytes long, records long")


@pytest.mark.parametrize("split", [97, 700, 8 << 20])
def test_stored_members_inside_a_payload_are_no_records(spark, tmp_path, split):
    inner = record(777, b"inner", 0) + record(778, b"second", 9) + record(779, b"cut off" * 20)[:60] + b"\x1f\x8b\x08"
    outer = [record(1, b"before" + inner * 3 + b"after", 0), record(2, b"x" * 3000), record(3, inner, 0), record(4, b"y")]
    found = warc.read_archives(manifest(spark, tmp_path / "x.warc.gz", b"".join(outer), 4), split_bytes=split).collect()
    assert sorted(r["page_id"] for r in found) == [1, 2, 3, 4]
    assert {r["page_id"]: r["payload"] for r in found}[3] == inner


@pytest.mark.parametrize("split", [100, 8 << 20])
def test_broken_archives_are_no_silent_loss(spark, tmp_path, split):
    good = [record(k, bytes(f"page {k} " * 40, "ascii")) for k in range(3)]
    wrong_trailer = good[1][:-6] + bytes([good[1][-6] ^ 1]) + good[1][-5:]
    lost_magic = b"\0" + good[1][1:]
    for data in (good[0] + wrong_trailer + good[2], good[0] + good[1] + good[2][:-20], good[0] + lost_magic + good[2]):
        m = manifest(spark, tmp_path / "x.warc.gz", data)
        with pytest.raises(ValueError, match="x.warc.gz"):
            warc.read_archives(m, split_bytes=split)
        found = warc.read_archives(m, split_bytes=split, errors="rows").collect()
        assert len([r for r in found if r["error"] is None]) == 2 and any(r["error"] for r in found)
    with pytest.raises(ValueError, match="of 4 records"):
        warc.read_archives(manifest(spark, tmp_path / "x.warc.gz", b"".join(good), 4), split_bytes=split)


def test_foreign_records(spark, tmp_path):
    info = b"software: x\r\n"
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:4f-1>\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info)
    (got,) = warc.read_archives(manifest(spark, tmp_path / "x.warc.gz", gzip.compress(raw))).collect()
    assert (got["page_id"], got["url"], got["record_type"], got["payload"]) == (None, None, "warcinfo", info)


def test_empty_table(spark):
    assert digest(warc.round_trip(pages(spark, []))) == []
