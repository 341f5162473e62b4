"""WARC archives of single Zstandard frames that share a dictionary.

An archive begins with a skippable frame that holds its dictionary, built from records of that archive, and goes on with
one frame a record, so that a record can be read on its own and small records are still compressed well.  A payload
that several pages share is kept once: the others become revisit records that refer to it.

Plan: payloads are told apart by SHA-1, length and a second hash; those that occur again are counted on narrow rows, and
the few that do are joined to the pages (broadcast while Spark finds them small, else by hash, dealt by salt too, so that
a payload of a third of all pages is no single task's).  Each task then packs its pages into archives of bounded size,
one row each, and Spark's text writer makes a file of each row, under its commit protocol: a lost executor leaves no
half-written archive, on any store.  The writer ends a file with a line separator, for which an empty skippable frame
stands.  Readers take one archive at a time and stream its records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.llm.common import give_back, shared_dir, small_batches, stash

# fixed values: the format's magic number of a frame that holds a dictionary, and of any frame to be skipped
DICTIONARY = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Raw bytes of records that an archive takes, about; a longer record is an archive of its own.
ARCHIVE_BYTES = 32 << 20
#: A dictionary's size, and the bytes of records that it is built from: at most so many of each, evenly chosen.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 64 << 10, 256, 8 << 10
#: Payloads shorter than this are written again.
LEAST_REVISIT = 1000
SALTS = 64
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, archive string, position int"


def _escaped(url: str) -> str:
    """A URL as a header can hold it: white space and control characters by percent."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """A response record, or a revisit record (refers_to given) whose block has the HTTP head alone."""
    digest = hashlib.sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(page_id, url, digest.hexdigest())}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _escaped(url)))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest.digest()).decode()}"))
    fields.append(("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))  # the format allows other fields
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, refers_url, digest.hexdigest())}>"), ("WARC-Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _escaped(refers_url)))
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from records that stand at even distances; none where they are too few or too short."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:SAMPLES]]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        return None


def pack(records: list[bytes], level: int = 3) -> bytes:
    """An archive: the dictionary in a skippable frame, if there is one, and a frame a record."""
    shared = dictionary(records)
    out = []
    if shared is not None:
        raw = shared.as_bytes()
        out.append(struct.pack("<II", DICTIONARY, len(raw)) + raw)
        shared.precompute_compress(level=level)
    press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, in order."""
    shared = None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY:
        size = struct.unpack_from("<I", archive, 4)[0]
        shared = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=shared).stream_reader(io.BytesIO(archive), read_across_frames=True), 1 << 16)
    while version := stream.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {version[:20]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record's head is cut off")
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with refers_to and refers_url: the largest page_id among pages of the same payload,
    where that is another page's and the payload has `least` bytes or more, and its url."""
    same = {"__sha1": F.sha1(_payload()), "__hash": F.xxhash64(_payload()), "__size": F.octet_length(_payload())}
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    keyed = pages.select("page_id", "url", "html", *(v.alias(k) for k, v in same.items()), salt.alias("__salt"))
    keys = list(same)
    # a payload's pages meet by salt first, so that one of a third of all pages costs a row a salt
    narrow = keyed.where(F.col("__size") >= least).groupBy(*keys, "__salt").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n"))
    narrow = stash(narrow, "payloads")
    again = narrow.groupBy(keys).agg(F.max("last").alias("last"), F.sum("n").alias("n")).where("n > 1").drop("n")
    again = stash(narrow.select(*keys, "__salt").join(again, keys), "revisits")  # its size tells Spark whether to broadcast it
    out = keyed.join(again, [*keys, "__salt"], "left")
    other = F.col("last.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    refers = (F.when(other, F.col(f"last.{c}")).alias(name) for c, name in (("page_id", "refers_to"), ("url", "refers_url")))
    return out.select("page_id", "url", "html", *refers)


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 3, least_revisit: int = LEAST_REVISIT) -> str:
    """Writes pages (page_id, url, html) to a new folder of *.warc.zst files and returns the folder.

    Of pages with equal payloads (html in UTF-8; null: empty) of least_revisit bytes or more, that with the largest
    page_id becomes a response and the others revisit it; shorter ones are all responses.  Rows that share a page_id and
    a payload become records of one kind each; a null page_id is less than all others, and where a payload has no other
    page, its pages are all responses.  A null url gives a record without a target.  Other columns are not carried.
    A table without rows gives a folder without archives.  date is every record's, so that reruns agree.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = 0

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([pack(records, level)], pa.binary())], ["content"])
            records.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(n) for n in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                page_id, url, html, *refers = (x.as_py() for x in row)
                record = warc_record(page_id, url, (html or "").encode(), *refers, date)
                if records and held + len(record) > archive_bytes:
                    yield done()
                    held = 0
                records.append(record)
                held += len(record)
        if records:
            yield done()
        give_back()

    rows = with_revisits(pages, least_revisit).mapInArrow(archives, "content binary")
    options = {"lineSep": EMPTY_FRAME, "maxRecordsPerFile": 1, "compression": "none"}
    rows.select(F.col("content").cast("string").alias("value")).write.options(**options).text(folder)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    where = jvm(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(where):  # names alone; Spark calls what its text writer writes *.txt
        name = status.getPath().getName()
        if name.endswith(".txt"):
            if status.getLen() <= len(EMPTY_FRAME):
                files.delete(status.getPath(), False)  # a partition without pages
            else:
                files.rename(status.getPath(), jvm(f"{folder}/{name[:-4]}.warc.zst"))
    return folder


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """RECORD of every response and revisit record below folder, by archive and position; a payload whose digest is not
    what its record says is an error.  payload_bytes is null for revisits, whose payload stands elsewhere."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, RECORD.split(", "), strict=True)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for k, (fields, block) in enumerate(unpack(content.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}, record {k}: the payload is damaged")
                    number = lambda n: int(fields[n]) if n in fields else None
                    size = len(payload) if kind == "response" else None
                    rows.append((number("warc-page-id"), fields.get("warc-target-uri"), size, digest, kind, number("warc-refers-to-page-id"), fields["warc-record-id"][1:-1], path, k))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            give_back()

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.zst").load(folder)
    with small_batches(spark, 1):  # an archive at a time
        return stash(files.select("path", "content").mapInArrow(scan, RECORD), "records")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """read_records(), with the size of a revisit's payload from the response that it refers to."""
    records = read_records(spark, folder)
    told = records.where("record_type = 'revisit'").groupBy("payload_digest", "refers_to").agg(F.count("*").alias("n"))
    response = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size"))
    # one row for each response that anything refers to
    sizes = told.drop("n").join(response, ["payload_digest", "refers_to"]).groupBy("payload_digest", "refers_to").agg(F.max("size").alias("size"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sizes = stash(sizes.select("payload_digest", "refers_to", "size", salts.alias("__salt")), "sizes")
    salted = records.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(sizes, ["payload_digest", "refers_to", "__salt"], "left")
    out = out.withColumn("payload_bytes", F.coalesce("payload_bytes", "size"))
    return out.select(*(c.split()[0] for c in RECORD.split(", ")))
