"""WARC: archives written and read by Spark, transactions assembled through concurrent-to identifiers.

Every capture is three WARC/1.0 records: the response (or a revisit of an earlier payload), its request and its metadata; the
last two name the first in WARC-Concurrent-To (archives from elsewhere may connect them in any order). Archives are gzip text files whose row end is the record end CR LF CR LF, so
Spark's text writer makes them in any store, and its text reader streams them: a task holds one record, not one archive. Records are cut by
Content-Length, never by searching for separators, so payloads may hold any bytes. ``assemble`` joins the records again, one nested row a capture.

Of equal payloads of ``min_bytes`` at least, the capture with the largest id is the response; the rest are revisits that refer
to it. Smaller payloads are always responses. A null payload counts as empty, a null id or url is kept as null; of rows with
one id and one payload, one can be the response and the others revisit it. An empty table gives an empty result; other columns are not read.

Reading fails (ValueError, or the decompressor's error) where an archive is cut off, a record does not end where its Content-Length says, or a payload
has another SHA-1 than its header says. A block without an HTTP head is a payload as a whole. Header names are read in any case, with or without a
space after the colon.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, components

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string"
DATE = "2024-01-01T00:00:00Z"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five bits a character, taken from 20-bit pieces."""
    piece = lambda i: F.conv(F.substring(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda i: F.substring(F.lit(BASE32), F.floor(piece(i) / F.element_at(F.array(*map(F.lit, (32768, 1024, 32, 1))), (i % 4) + 1)).cast("int") % 32 + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"\r\n{k}: "), v)).otherwise("") for k, v in headers]
    return F.concat(F.lit("WARC/1.0"), *lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def plan_captures(pages: DataFrame, id: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, copy, keeper): keeper is the id whose response this one revisits, else null."""
    body = F.coalesce(F.col(payload), F.lit(""))
    key = F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("key")  # a plain key lets one shuffle serve window and join
    base = pages.select(key, F.col(id).alias("id"), F.col(url).alias("url"), body.alias("payload"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    slim = common.cut(base.select("key", "id", "digest", F.octet_length("payload").alias("bytes")))
    groups = common.cut(slim.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1"))
    chosen = slim.where(F.col("bytes") >= min_bytes).select("key", "digest").join(groups.select("digest", "keeper"), "digest").distinct()
    n = max(1, -(-(slim.agg(F.sum("bytes")).first()[0] or 0) // ARCHIVE_BYTES), common.parallelism(pages))
    spread = base.repartition(n, "key", "digest")
    copy = F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")) - 1
    out = spread.withColumn("copy", copy).join(chosen.hint("shuffle_hash"), ["key", "digest"], "left")
    keeper = F.when((F.col("copy") == 0) & F.col("id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper"))
    return out.select("id", "url", "payload", "digest", "copy", keeper.alias("keeper"))


#: Payload bytes an archive file gets on average before it is compressed.
ARCHIVE_BYTES = 32 << 20


def write(pages: DataFrame, path: str, **options) -> None:
    """Archives of pages under path: three records a page."""
    c = plan_captures(pages, **options)
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    revisit = F.col("keeper").isNotNull()
    urn = lambda i, copy, kind: F.concat(F.lit("<urn:capture:"), text(i), F.lit("."), copy.cast("string"), F.lit(f":{kind}>"))
    own, digest = urn(F.col("id"), F.col("copy"), "response"), F.concat(F.lit("sha1:"), base32(F.col("digest")))
    uri = F.when(F.col("url").isNotNull(), F.regexp_replace("url", r"[\r\n]", ""))
    common_headers = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    main = _record(
        [("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", own), *common_headers, ("WARC-Payload-Digest", digest),
         ("WARC-Refers-To", F.when(revisit, urn(F.col("keeper"), F.lit(0), "response"))), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))),
    )
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", urn(F.col("id"), F.col("copy"), "request")), *common_headers, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)))
    fields = F.concat(F.lit("page-id: "), text(F.col("id")), F.lit("\r\npayload-bytes: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", urn(F.col("id"), F.col("copy"), "metadata")), *common_headers, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    c.select(F.concat_ws(END, main, request, metadata).alias("value")).write.option("compression", "gzip").option("lineSep", END).text(path)


_END = END.encode()


def fragments(data: bytes):
    """Pieces of one archive's bytes, gzip or plain, between record ends."""
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(rest))
            if not d.eof:
                raise ValueError("a gzip archive is cut off")
            rest = d.unused_data.lstrip(b"\0")
        data = b"".join(parts)
    if not data:
        return
    if not data.endswith(_END):
        raise ValueError("an archive is cut off")
    at = 0
    while at < len(data):
        e = data.find(_END, at)  # -1: a block's own line end shifted the separators
        yield data[at:e] if e >= 0 else data[at:]
        at = e + 4 if e >= 0 else len(data)


def cut_records(pieces):
    """(head, block) of the records of one archive, from its bytes in pieces between record ends (which blocks may hold, too). Holds one record at a time."""
    pieces = iter(pieces)
    for head in pieces:
        while head is not None and head.strip(b"\r\n"):
            version, *lines = head.split(b"\r\n")
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {version[:40]!r}")
            h = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}
            if not h.get("content-length", "").isdigit():
                raise ValueError(f"record {h.get('warc-record-id')} has no Content-Length")
            need, held, size = int(h["content-length"]), [], -4
            while size < need or need < size < need + 4:  # up to the block's end, or beyond a record end that begins inside a piece
                piece = next(pieces, None)
                if piece is None:
                    break
                held.append(piece)
                size += len(piece) + 4
            whole = _END.join(held)
            if len(whole) < need or not held or len(whole) > need and whole[need : need + 4] != _END:
                raise ValueError(f"record {h.get('warc-record-id')} does not end where its Content-Length says")
            yield h, whole[:need]
            head = whole[need + 4 :] or None  # the next head, if the record end was not between pieces


def record(h: dict, block: bytes, keep_payload: bool = True) -> dict:
    r = {"record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "digest": h.get("warc-payload-digest"), "fields": None, "payload": None, "payload_bytes": None, "payload_digest": None}
    if r["type"] == "metadata":
        r["fields"] = {k.decode("utf-8", "replace").strip(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in block.split(b"\r\n") if x)}
    elif r["type"] in ("response", "request", "resource"):
        http = h.get("content-type", "application/http").startswith("application/http")
        end = block.find(_END) if http else -1
        body = block[end + 4 :] if end >= 0 else block
        own = base64.b32encode(hashlib.sha1(body).digest()).decode()
        named = (r["digest"] or "").partition("sha1:")[2]
        if len(named) == 32 and named.upper() != own:
            raise ValueError(f"the payload of {r['record_id']} has another digest than its header says")
        r |= {"payload": body if keep_payload else None, "payload_bytes": len(body), "payload_digest": own}
    return r


def parse(data: bytes, keep_payload: bool = True):
    """Records of one archive in memory as dictionaries."""
    return (record(h, block, keep_payload) for h, block in cut_records(fragments(data)))


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of the archives under path, streamed. Archives are gzip files (.gz), or plain ones of at most ``spark.sql.files.maxPartitionBytes``, which Spark does not split."""
    names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]

    def records(batches):
        import pyarrow as pa

        arrow = {"fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "payload_bytes": pa.int64()}
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([list(x[k].items()) if k == "fields" and x[k] is not None else x[k] for x in rows], arrow.get(k, pa.string())) for k in names], names)

        def rows_of(b):
            for value, file, start in zip(b["value"], b["file"].to_pylist(), b["start"].to_pylist()):
                if start:
                    raise ValueError(f"{file} is split: compress it, or raise spark.sql.files.maxPartitionBytes")
                yield file, value.as_py()

        flow = (x for b in batches for x in rows_of(b))
        rows, size = [], 0
        for _, pieces in groupby(flow, key=lambda x: x[0]):
            for h, block in cut_records(p for _, p in pieces):
                rows.append(record(h, block, keep_payload))
                size += len(rows[-1]["payload"] or b"")
                if size > 8 << 20 or len(rows) >= 5000:
                    yield pack(rows)
                    rows, size = [], 0
        if rows:
            yield pack(rows)

    text = spark.read.option("lineSep", END).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).mapInArrow(records, RECORD)


#: Types of the records that are a capture's own content; all others are about it.
MAIN = ["response", "revisit", "resource", "conversion"]


def captures_of(records: DataFrame) -> DataFrame:
    """records with the column ``capture``, the same for all records that concurrent-to identifiers connect, in either direction and over any number of steps.

    Where no record names another that names one itself, which is a join of ids to find out, the named record is the capture. Only archives with such chains
    take connected components over their links; ids are then compared by 64-bit hashes. A record without any id is a capture of its own.
    """
    alone = F.concat(F.lit("row:"), F.monotonically_increasing_id())
    links = records.where("concurrent_to IS NOT NULL").select("record_id", "concurrent_to")
    if links.join(links.select(F.col("record_id").alias("concurrent_to")), "concurrent_to", "left_semi").isEmpty():
        return records.withColumn("capture", F.coalesce("concurrent_to", "record_id", alone))
    roots = components.components(links.select(F.xxhash64("record_id").alias("a"), F.xxhash64("concurrent_to").alias("b")))
    nodes = records.withColumn("node", F.xxhash64(F.coalesce("record_id", "concurrent_to", alone)))
    root = F.coalesce("root", "node").cast("string")
    return nodes.join(roots, "node", "left").withColumn("capture", root).drop("node", "root")


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: ``response``, the record with its content, and arrays ``request``, ``metadata`` and ``others`` of the records about it, in the order of their ids.

    Every record is in a row: a capture with several records of content has a row for each, all with the same others, and one without any has
    a row without a response. Records about a capture are read without their payloads, so those of one capture fit a row.
    """
    names = [c for c in records.columns if c != "type"]
    parts = captures_of(records)
    main = F.col("type").isin(MAIN)
    own = parts.where(main).select("capture", F.struct("type", *names).alias("response"))
    small = F.struct("type", *[c for c in names if c not in ("payload", "fields")], F.map_entries("fields").alias("entries"))
    about = parts.where(~main | F.col("type").isNull()).select("capture", F.when(F.col("type").isin("request", "metadata"), F.col("type")).otherwise("others").alias("kind"), small.alias("r"))

    def of(kind: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("r"))))
        return F.transform(rows, lambda r: r.withField("fields", F.map_from_entries(r["entries"])).dropFields("entries")).alias(kind)

    grouped = about.groupBy("capture").agg(*[of(k) for k in ("request", "metadata", "others")])
    both = own.join(grouped, "capture", "left")
    lone = grouped.join(own.select("capture"), "capture", "left_anti").select("capture", F.lit(None).cast(own.schema["response"].dataType).alias("response"), "request", "metadata", "others")
    none = lambda c: F.coalesce(c, F.array().cast(grouped.schema[c].dataType)).alias(c)
    return both.unionByName(lone).select("capture", "response", *[none(c) for c in ("request", "metadata", "others")])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    captures = assemble(common.cut(read(spark, path, keep_payload=False)))
    common.remove(spark, path)  # its records are kept
    fields = F.get("metadata", 0)["fields"]
    return captures.select(
        fields["page-id"].try_cast("bigint").alias("page_id"),
        F.coalesce("response.payload_bytes", fields["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.coalesce(F.col("response.payload_digest"), F.regexp_replace("response.digest", "^sha1:", "")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.expr(r"try_cast(regexp_extract(response.refers_to, 'capture:(.*)\\.[0-9]+:', 1) AS bigint)").alias("refers_to"),
    )


QUERIES = {"op6_warc": op6_warc}
ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS s FROM p),
d AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS keeper, array_to_string(list_transform(range(32), lambda i:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM d"""
}
