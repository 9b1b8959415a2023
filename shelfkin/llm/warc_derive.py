"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

For each response record two records are made, both referring to it: ``metadata`` holds
its headers, digests, title and links as JSON and names the conversion record;
``conversion`` holds the visible text, one block per line.  Files are written and read by
Spark's text source: a WARC record ends with an empty line, which serves as the row
separator, so any file system that Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, texts
from .template_html import Page

# Version line and field names of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = (
    "key string, kind string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, block_digest string, content_length bigint, n_links bigint, header string, block string"
)
HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
HEAD = re.compile(r"</?(?:head|title)\b[^>]*>", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(name: str) -> str:
    """The same name always gives the same id."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def clean_uri(uri: str) -> str:
    """A URI, or another value, that fits in a header line: white space and control characters are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def visible_text(source: str) -> str:
    """All text blocks of a page, one per line, without scripts, styles and other unseen parts."""
    return "\n".join(t for _, t in Page(source).blocks)


def derive_one(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload = response["payload"]
    source_digest = digest(payload.encode())
    refers_to = clean_uri(response["record_id"])
    uri, date = clean_uri(response["target_uri"]), clean_uri(response["date"])
    conversion_id, metadata_id = record_id(f"conversion {refers_to}"), record_id(f"metadata {refers_to}")
    links = [html.unescape(a or b or c) for a, b, c in HREF.findall(payload)]
    title = TITLE.search(payload)
    http = [line.partition(":") for line in response["http_header"].split("\r\n")[1:] if ":" in line]
    facts = {
        "warc": {"record_id": refers_to, "target_uri": uri, "date": date, "payload_digest": source_digest},
        "http": {"status": response["http_header"].split("\r\n")[0], "headers": [[k.strip(), v.strip()] for k, _, v in http]},
        "html": {"title": " ".join(html.unescape(title[1]).split()) if title else None, "links": links},
        "conversion": conversion_id,
    }
    made = [
        ("metadata", metadata_id, "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True), len(links)),
        ("conversion", conversion_id, "text/plain; charset=utf-8", visible_text(payload), 0),
    ]
    out = []
    for kind, own_id, content_type, block, n_links in made:
        data = block.encode()
        fields = [
            ("WARC-Type", kind), ("X-Source-Key", clean_uri(response["key"])), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to),
            ("WARC-Source-Payload-Digest", source_digest), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type), ("Content-Length", str(len(data))),
        ]
        header = "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in fields]])
        out.append({
            "key": response["key"], "kind": kind, "record_id": own_id, "refers_to": refers_to, "target_uri": uri, "date": date, "content_type": content_type,
            "payload_digest": source_digest, "block_digest": digest(data), "content_length": len(data), "n_links": n_links, "header": header, "block": block,
        })
    return out


def responses_of_pages(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records (key, record_id, target_uri, date, http_header, payload) of fetched pages.

    Null urls and sources count as empty.  Rows that are equal get equal ids.
    """
    key = F.coalesce(F.col(f"`{page}`").cast("string"), F.lit(""))
    uri, body = F.coalesce(F.col(f"`{url}`"), F.lit("")), F.coalesce(F.col(f"`{source}`"), F.lit(""))
    h = F.sha1(F.concat_ws("\n", key, uri, body))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    own = F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-a"), parts[3], F.lit("-"), parts[4], F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return pages.select(key.alias("key"), own.alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), http.alias("http_header"), body.alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Two records for every response, in one pass; columns other than the six of a response are not read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "record_id", "target_uri", "date", "http_header", "payload"]
        kinds = {c.split()[0]: pa.int64() if c.endswith("bigint") else pa.string() for c in RECORD.split(", ")}
        for batch in batches:
            for part in pieces(batch):
                rows = zip(*[texts(part, n) for n in names], strict=True)
                made = [r for row in rows for r in derive_one(dict(zip(names, row, strict=True)))]
                yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], k) for n, k in kinds.items()], names=list(kinds))

    return responses.select("key", "record_id", "target_uri", "date", "http_header", "payload").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write header and block of each record; every part file is a WARC file of its own."""
    whole = F.concat(F.col("header"), F.lit(END), F.col("block"))
    records.select(whole.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def read_derivatives(spark: SparkSession, path: str) -> DataFrame:
    """(header, block, and the header's fields) of files written by ``write_warc``.

    Records are found by their version line, which cannot occur within these blocks: they
    hold no carriage return.
    """
    rows = spark.read.option("lineSep", VERSION + "\r\n").text(path).where(F.length("value") > 0)
    header = F.substring_index("value", END, 1)
    rest = F.substring("value", F.length(header) + 5, F.length("value"))
    rows = rows.select(header.alias("header"), F.substring(rest, F.lit(1), F.length(rest) - 4).alias("block"))
    pairs = F.transform(F.split("header", "\r\n"), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.regexp_replace(x, "^[^:]*: ", "").alias("v")))
    fields = F.map_from_entries(pairs)
    named = {"key": "X-Source-Key", "kind": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest"}
    return rows.withColumn("fields", fields).select(
        *[F.col("fields")[v].alias(k) for k, v in named.items()], F.col("fields")["Content-Length"].cast("bigint").alias("content_length"), "block"
    )
