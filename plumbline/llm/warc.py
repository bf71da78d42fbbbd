"""WARC archives written with their index first, and read back by coalesced byte ranges.

A task writes one archive: a gzip member per record, and for each member an index row with
offset, length, URL and digest. Archives carry names of their own per attempt and only the
index rows of successful attempts are kept, so a lost executor leaves at most a file that no
index row names. A reader takes any selection of the index, sorts it by place, joins
neighbouring members into ranges and fetches each range with one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Written, files, shuffle_parts
from plumbline.session import work_path

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = b"\r\n"
DATE = "2000-01-01T00:00:00Z"

GZIP = 31  # window bits of zlib for a gzip member
GAP = 1 << 16
RANGE_BYTES = 8 << 20


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in head), b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return pack.compress(LINE.join([*lines, b"", block, b"", b""])) + pack.flush()


def http_block(payload: bytes) -> bytes:
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=UTF-8", b"Content-Length: %d" % len(payload)]
    return LINE.join([*head, b"", payload])


def record(key: str | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record; a ``payload`` of None makes it a revisit of ``refers_to``."""
    kind = "response" if payload is not None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(size))]
    if key is not None:
        head.append(("X-Key", quote(key)))
    if payload is None:
        head += [("WARC-Profile", REVISIT), ("X-Refers-To-Key", quote(refers_to))]
        return member(head, b"")
    return member([*head, ("Content-Type", "application/http; msgtype=response")], http_block(payload))


def parse(data: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and payload of one member; a revisit has no payload."""
    raw = zlib.decompress(data, GZIP)
    head, _, rest = raw.partition(LINE + LINE)
    version, *lines = head.split(LINE)
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "revisit":
        return fields, None
    return fields, block.partition(LINE + LINE)[2]


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0) -> DataFrame:
    """Write a record per row of ``df`` below ``folder`` and return the written index:
    ``(path, offset, length, id, url, digest, payload_bytes, record_type, refers_to)``.

    The payload is the text in UTF-8, null as empty. Of rows with equal payloads of at least
    ``smallest`` bytes, those of the smallest id become responses and the others revisit that
    id; a null id comes after every id, and if all are null, all are responses. A repeated row
    of the smallest id is a response as well. A null URL gives a record without one.

    Payloads are told apart by length and SHA-1. Who revisits whom is decided on narrow rows;
    payloads are shuffled once, those of revisits not at all after that.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    narrow = Written(rows.drop("payload"), "warc-rows").df
    first = narrow.where(F.col("size") >= smallest).groupBy("sha1", "size").agg(F.min("id").alias("refers_to"))
    known = narrow.join(first, ["sha1", "size"], "left")
    other = F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))
    revisits = known.where(other).withColumn("payload", F.lit(None).cast("binary"))
    again = revisits.select(F.col("id").alias("_id"), F.col("sha1").alias("_sha1")).distinct()
    responses = rows.join(again, rows["id"].eqNullSafe(again["_id"]) & (rows["sha1"] == again["_sha1"]), "left_anti")
    columns = ["id", "url", "payload", "sha1", "size", "refers_to"]
    id_type = df.schema[id_col].dataType.simpleString()
    records = responses.withColumn("refers_to", F.lit(None).cast(id_type)).select(*columns).unionByName(revisits.select(*columns))
    fs, root = files(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        fs, name = files(where)
        for batch in batches:
            index: dict[str, list] = {c: [] for c in ("path", "offset", "length", "digest", "record_type")}
            table = batch.to_pydict()
            for key, url, payload, sha1, size, refers_to in zip(*(table[c] for c in columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(None if key is None else str(key), url, payload, digest, size, None if refers_to is None else str(refers_to))
                out = out or fs.open_output_stream(name, compression=None)
                out.write(data)
                for c, v in zip(index, (where, at, len(data), digest, "revisit" if payload is None else "response")):
                    index[c].append(v)
                at += len(data)
            rest = {c: batch.column(c) for c in ("id", "url", "size", "refers_to")}
            yield pa.RecordBatch.from_pydict({**{c: pa.array(v, pa.int64() if c in ("offset", "length") else pa.string()) for c, v in index.items()}, **rest})
        if out:
            out.close()

    schema = f"path string, offset bigint, length bigint, digest string, record_type string, id {id_type}, url string, size bigint, refers_to {id_type}"
    index = Written(records.mapInArrow(write, schema), "warc-index").df
    return index.withColumnRenamed("size", "payload_bytes")


def read_records(index: DataFrame, payloads: bool = False, gap: int = GAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records that the rows of ``index`` name, as read from their archives:
    ``(id, url, payload_bytes, payload_digest, record_type, refers_to)`` and, if asked for,
    ``payload`` (null for revisits). Every payload is checked against its digest.

    Members at most ``gap`` bytes apart are read together, in ranges of about ``range_bytes``.
    """
    place = Window.partitionBy("path").orderBy("offset")  # one archive: what one task wrote
    ended = F.lag(F.col("offset") + F.col("length")).over(place)
    parted = index.select("path", "offset", "length").withColumn("island", F.sum(F.when(F.col("offset") - ended <= gap, 0).otherwise(1)).over(place))
    # a range ends where the archive passes a multiple of range_bytes
    piece = F.floor(F.col("offset") / range_bytes)
    ranges = parted.groupBy("path", "island", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))
    ranges = ranges.repartition(shuffle_parts(index.sparkSession), "path", "island", "piece")
    id_type = index.schema["id"].dataType.simpleString()
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, members in zip(batch.column("path").to_pylist(), batch.column("members").to_pylist()):
                fs, name = files(path)
                start, end = members[0]["offset"], members[-1]["offset"] + members[-1]["length"]
                with fs.open_input_file(name) as file:
                    data = file.read_at(end - start, start)
                found = []
                for m in members:
                    at = m["offset"] - start
                    fields, payload = parse(data[at : at + m["length"]])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(fields["X-Payload-Bytes"])
                    if payload is not None and (len(payload) != size or sha1_base32(payload) != digest):
                        raise ValueError(f"{path} is damaged at {m['offset']}")
                    row = (fields.get("X-Key"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Key"), payload)
                    found.append(row[: len(names)])
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    schema = "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    keyed = [F.url_decode(c).cast(id_type).alias(c) for c in ("id", "refers_to")]
    return ranges.mapInArrow(read, schema).select(keyed[0], *names[1:5], keyed[1], *names[6:])


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0) -> DataFrame:
    """Archives of ``df`` in the shared folder, read back whole."""
    index = write_archives(df, work_path(df.sparkSession, "warc"), id_col, url_col, payload_col, smallest)
    return read_records(index).withColumnRenamed("id", id_col)
