"""WARC archives: written from captures, read back, and put together by transaction.

A capture becomes three records: the request, the response (or, for a payload that another capture holds, a revisit) and
metadata, the other two pointing at the response by WARC-Concurrent-To. Of captures with equal payloads the one with
the largest page id is the response; a revisit names that page in its metadata, and its record where only one can be
meant. Archives are gzip files of about PART_BYTES before compression in the folder that the cluster shares, written and
listed by Spark alone; a reader walks each file by its records' Content-Length, so payloads may hold anything. Assembly
groups the records of a transaction, which are three, by the id that they point at.

Record ids are UUIDs (version 8). A transaction has a number of its own, which its row gets where it is written; the one
response of a payload has an id made of the payload's digest instead, so that revisits can refer to it without a join.

Edge cases: every row is a capture of its own, whatever its page id. A null page id is written as none and read as null;
it is less than any other, and where all of a payload's ids are null each of its rows is a response. Rows that share a
payload and its largest page id are responses all. A null html is an empty payload; a null url is written as
``about:blank``; an empty table writes no archive and gives no rows; other columns are not read. A payload of any length
is one record; an archive holds one record at least and ends after PART_BYTES.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequery.llm._support import checkpointed, deleted, shared_dir

ROLES = ("response", "request", "metadata")
#: Bytes of records after which a task begins another file, and the smallest payload of which repeats become revisits.
PART_BYTES, LEAST_REVISIT = 64 << 20, 0
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _uuid(value: int) -> str:
    """The version 8 UUID that holds the lower 122 bits of ``value``."""
    value &= (1 << 122) - 1
    raw = value >> 74 << 80 | 8 << 76 | (value >> 62 & 0xFFF) << 64 | 2 << 62 | value & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=raw)}>"


def record_id(number: int, role: int) -> str:
    """The id of a transaction's record: its number, and its role in the lowest two bits."""
    return _uuid((number & (1 << 64) - 1) << 2 | role)


def response_id(digest: str) -> str:
    """The id of a payload's one response; role 3 keeps it apart from the numbered ones."""
    return _uuid(int.from_bytes(base64.b32decode(digest)[:15], "big") << 2 | 3)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, own: str, uri: str, block: str, more: dict[str, str], mime: str) -> str:
    """A record without the two line ends after it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": uri, **more}
    head |= {"Content-Type": mime, "Content-Length": str(len(block.encode()))}
    return "WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in head.items()) + END + block


def capture(number: int, page_id: int | None, url: str | None, payload: str, refers_to: int | None, shared: bool) -> list[str]:
    """The three records of a capture; ``refers_to`` is the page it revisits, ``shared`` whether its payload has one response."""
    uri = "".join(c if c.isprintable() and c != " " else "%" + format(ord(c) & 255, "02X") for c in url or "about:blank")
    raw = payload.encode()
    digest = digest_of(raw)
    main = response_id(digest) if shared and refers_to is None else record_id(number, 0)
    more = {"WARC-Payload-Digest": f"sha1:{digest}"}
    host, _, path = uri.split("//", 1)[-1].partition("/")
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(raw)}{END}{END}"
    if refers_to is None:
        first = record("response", main, uri, http + payload, more, "application/http; msgtype=response")
    else:
        more |= {"WARC-Refers-To": response_id(digest)} if shared else {}
        more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        first = record("revisit", main, uri, http, more, "application/http; msgtype=response")
    tied = {"WARC-Concurrent-To": main}
    request = f"GET /{path} HTTP/1.1{END}Host: {host}{END}{END}"
    asked = record("request", record_id(number, 1), uri, request, tied, "application/http; msgtype=request")
    facts = {"page-id": page_id, "payload-length": len(raw), "refers-to-page": refers_to}
    lines = "".join(f"{k}: {v}{END}" for k, v in facts.items() if v is not None)
    return [asked, first, record("metadata", record_id(number, 2), uri, lines, tied, "application/warc-fields")]


def read(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of an archive."""
    held = bytearray()

    def more() -> bool:
        for c in chunks:
            held.extend(c)
            return True
        return False

    while True:
        while held[:2] == b"\r\n" or len(held) < 2:
            if held[:2] == b"\r\n":
                del held[:2]
            elif not more():
                return
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header does not end")
        first, *lines = held[:at].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        while len(held) < at + 4 + size:
            if not more():
                raise ValueError("a record is cut off")
        yield fields, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size]


def unzipped(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, or of a plain file."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    left = raw
    while left:
        member = zlib.decompressobj(31)
        out = member.decompress(left, step)
        while out or not member.eof:
            yield out
            if member.eof:
                break
            out = member.decompress(member.unconsumed_tail, step)
            if not out and not member.unconsumed_tail and not member.eof:
                return
        left = member.unused_data


def with_targets(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``, the page that holds an equal payload, null for responses, and
    ``shared``, whether one row alone is the response of the payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    held = rows.where(F.octet_length("html") >= least).groupBy("_digest", "page_id").agg(F.count("*").alias("_same"))
    held = held.groupBy("_digest").agg(
        F.max("page_id").alias("_last"), F.sum("_same").alias("_n"),
        F.coalesce(F.max_by("_same", "page_id"), F.lit(2)).alias("_tied"),
    )
    held = held.where("_n > 1").select(F.col("_digest").alias("_d"), "_last", "_tied")
    # Few payloads repeat: the rows of the others find nothing to meet, and a common one's rows may be split.
    out = rows.join(held, F.col("_digest") == F.col("_d"), "left")
    revisit = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", F.when(revisit, F.col("_last")).alias("refers_to"), (F.coalesce("_tied", F.lit(0)) == 1).alias("shared"))


def written(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, most: int = PART_BYTES) -> None:
    """Archives of ``pages`` in ``folder``, which end after ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = part = 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                values, parts = [], []
                for number, page_id, url, html, refers_to, shared in zip(*b.slice(i, 64).to_pydict().values(), strict=True):
                    part, held = (part + 1, 0) if held >= most else (part, held)
                    values += capture(number, page_id, url, html, refers_to, shared)
                    parts += [part] * 3
                    held += sum(map(len, values[-3:]))
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(parts, pa.int32())], ["value", "part"])

    rows = with_targets(pages, least).select(F.monotonically_increasing_id().alias("number"), "*")
    # Every record ends with two line ends, which Spark's writer puts as its line separator.
    out = rows.mapInArrow(run, "value string, part int").write.partitionBy("part")
    out.option("lineSep", END + END).option("compression", "gzip").text(folder)


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    """A record as a row; the payload of a response is held against its digest."""
    payload, own, kind = block, [], fields["warc-type"]
    if fields["content-type"].startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif fields["content-type"] == "application/warc-fields":
        own = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split(END) if x)]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest != digest_of(payload):
        raise ValueError(f"the payload of {fields['warc-record-id']} was damaged")
    return {
        "record_id": fields["warc-record-id"], "type": kind, "concurrent_to": fields.get("warc-concurrent-to"),
        "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload_digest": digest,
        "content_length": len(payload), "fields": own, "payload": payload if payloads else None,
    }


def records(spark, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``folder``, with or without their payloads."""
    text, number = pa.string(), pa.int64()
    kinds = (text, text, text, text, text, text, number, pa.map_(text, text), pa.binary())
    schema = pa.schema(list(zip(RECORD.names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows, size = [], 0
                for fields, block in read(unzipped(raw.as_py())):
                    rows.append(_row(fields, block, payloads))
                    size += len(block) * payloads + 400
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").option("recursiveFileLookup", "true")
    return files.load(folder).select("content").mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """(capture_id, request, response, metadata): one nested row for each transaction, joined by what is concurrent to what."""
    own = F.struct(*(f.name for f in RECORD.fields))
    keyed = found.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).withColumn("_r", own)
    pick = lambda name, *kinds: F.first(F.when(F.col("type").isin(*kinds), F.col("_r")), ignorenulls=True).alias(name)
    return keyed.groupBy("capture_id").agg(pick("request", "request"), pick("response", "response", "revisit"), pick("metadata", "metadata"))


def report(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """What reading the archives of ``pages`` back tells of every capture; the archives are deleted afterwards."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written(pages, folder, least)
    told = F.col("metadata.fields")
    out = captures(records(spark, folder, payloads=False)).select(
        told["page-id"].cast("long").alias("page_id"),
        told["payload-length"].cast("long").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        told["refers-to-page"].cast("long").alias("refers_to"),
    )
    out = checkpointed(out)
    deleted(spark, folder)
    return out

