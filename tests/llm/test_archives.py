"""Archives: an exact round trip, and each frame on its own."""

import hashlib
import random
import struct

import pytest
import zstandard

from paralex.llm import archives


def pages_of(rng, n):
    body = ["<p>" + "".join(rng.choice("abc é\U0001f600") for _ in range(rng.randrange(2500))) + "</p>" for _ in range(n // 3)]
    rows = [(k, f"http://host{k % 5}/ä {k}\r\nX: y", f"<html><head><title>page</title></head>{rng.choice(body)}</html>") for k in range(n)]
    return rows + [(n, None, None), (n + 1, "", ""), (n + 2, "u", "x" * 999), (n + 3, "u", "x" * 999), (n + 4, "u", "x" * 1000), (n + 5, "u", "x" * 1000), (n + 5, "u", "x" * 1000), (None, "u", "x" * 1000), (None, "v", "only nulls" * 200), (None, "w", "only nulls" * 200), (n + 6, "long", "lorem ipsum " * 40_000)]


def brute(rows):
    last: dict = {}
    for i, _, html in rows:
        if i is not None:
            last[html] = max(i, last.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = last.get(html) if len(raw) >= 1000 and last.get(html) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return out


@pytest.mark.parametrize("size", [1, 20_000, 32 << 20])
def test_round_trip(spark, tmp_path, size):
    rows = pages_of(random.Random(5), 120)
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, refers_to int, last string").repartition(5)
    folder = archives.write_archives(pages, str(tmp_path / "a"), archive_bytes=size)
    got = archives.read_archives(spark, folder)
    assert sorted(repr(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == sorted(map(repr, brute(rows)))
    assert {r["url"] for r in got.collect() if r["page_id"] == 7} == {"http://host2/ä%207%0D%0AX:%20y"}
    ids = {r["record_id"]: r["page_id"] for r in got.collect() if r["record_type"] == "response"}
    referring = [f for p in (tmp_path / "a").glob("*.zst") for f, _ in archives.unpack(p.read_bytes()) if f["warc-type"] == "revisit"]
    assert referring and all(str(ids[f["warc-refers-to"][1:-1]]) == f["warc-refers-to-page-id"] for f in referring)
    names = [p.name for p in (tmp_path / "a").iterdir() if p.name[0] not in "._"]
    assert all(n.endswith(".warc.zst") for n in names) and (len(names) == len(rows) if size == 1 else len(names) >= 1)


def frames(data):
    """A standard reader's view: (magic number, content) of each frame, found without this library."""
    at, shared = 0, None
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == archives.DICTIONARY:
                shared = zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size])
            yield magic, data[at + 8 : at + 8 + size]
            at += 8 + size
        else:
            one = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
            out = one.decompress(data[at:])
            yield magic, out
            at = len(data) - len(one.unused_data)


def test_each_record_is_a_frame_behind_the_dictionary(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, f"http://h/{k}", f"<html><head><meta charset='utf-8'><title>{rng.random()}</title></head><body class='main'>{rng.random()}</body></html>") for k in range(500)]
    folder = archives.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    (name,) = (p for p in (tmp_path / "a").iterdir() if p.name.endswith(".warc.zst"))
    data = name.read_bytes()
    found = list(frames(data))
    assert found[0][0] == archives.DICTIONARY and len(found[0][1]) > 1000 and found[-1] == (0x184D2A50, b"")
    records = [x for magic, x in found if magic == 0xFD2FB528]
    assert len(records) == 500 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    # the dictionary pays: without it, the same frames are longer
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) < 0.8 * plain
    assert list(archives.unpack(data))[3][0]["warc-target-uri"] == "http://h/3"
    assert folder == str(tmp_path / "a")


def test_no_pages_and_damage(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.read_archives(spark, archives.write_archives(empty, str(tmp_path / "none"))).count() == 0
    record = archives.warc_record(1, "u", b"payload", None, None, "2000-01-01T00:00:00Z")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc.zst").write_bytes(archives.pack([record.replace(b"payload", b"pAyload")]))
    with pytest.raises(Exception, match="damaged"):
        archives.read_records(spark, str(tmp_path / "bad"))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.zst").write_bytes(archives.pack([record[:-9]]))
    with pytest.raises(Exception, match="cut off"):
        archives.read_records(spark, str(tmp_path / "cut"))
