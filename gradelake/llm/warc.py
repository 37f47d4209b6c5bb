"""Web archives: records written by Spark's own writers, read back in streams, and revisits resolved by payload digest.

An archive is a folder of gzip files of WARC 1.1 records. The records are text columns that Spark's text writer ends with the two line breaks of the format, so
files appear whole or not at all, wherever Hadoop can write. Reading takes the lines of each gzip file in order (one task a file, which is not split) and puts
records together by their Content-Length, so memory follows one record and payloads may hold anything.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import bloom_filter, lookup, new_path, stored

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "Gradelake-Page-ID"
#: Bytes of payload in an Arrow batch of records that the reader gives on.
OUT_BYTES = 1 << 21


def repeated(pages: DataFrame) -> DataFrame:
    """digest, payload_bytes, first_id, first_url, copies of each payload that several rows of `pages` (page_id, url, digest, payload_bytes) hold.

    first_id is the least page_id, first_url the least url of it. Headers alone are grouped, with partial minima in every task.
    """
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    g = pages.groupBy("digest").agg(F.min(known).alias("first"), F.max("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("copies"))
    return g.filter("copies > 1").select("digest", "payload_bytes", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "copies")


def with_first(rows: DataFrame, groups: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`rows` (digest, ...) with `columns` of its digest's row in `groups` (digest, copies, ...; null where there is none).

    A Bloom filter of fixed size names the rows that may have one; only these are shuffled, and those with a hot digest are not.
    """
    key = F.xxhash64("digest")
    may_have = bloom_filter(groups.select(key.alias("key")))
    tried = rows.withColumns({"_key": key}).withColumn("_may", may_have(F.col("_key")))
    # digests that share a key stand in one row and are told apart after the join
    table = groups.withColumn("_key", key).groupBy("_key").agg(F.sum("copies").alias("_copies"), F.collect_list(F.struct("digest", *columns)).alias("_groups"))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    found = lookup(tried.filter("_may").drop("_may"), table, "_key", "_copies", total)
    own = F.try_element_at(F.filter("_groups", lambda g: g["digest"] == F.col("digest")), F.lit(1))
    found = found.select(*rows.columns, *[own.getField(c).alias(c) for c in columns])
    types = dict(groups.dtypes)
    return found.union(tried.filter(~F.col("_may")).select(*rows.columns, *[F.lit(None).cast(types[c]).alias(c) for c in columns]))


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, record_type (response or revisit), refers_to, refers_url of every row of `pages` (page_id, url, html).

    Of rows with equal payloads of at least `least_bytes` bytes those with the least page_id are responses, the others revisit it. A null html is empty, a null page_id
    comes after all others and refers to the least one; payloads that only rows with null page_id hold are responses. Rows that repeat the least page_id are responses too.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    groups = stored(repeated(rows.filter(F.col("payload_bytes") >= least_bytes)), "warc_groups")
    out = with_first(rows, groups, ("first_id", "first_url"))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return out.select("page_id", "url", "html", "digest", "payload_bytes", kind.alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"))


def record_id(page_id: Column, digest: Column) -> Column:
    """The same in every run: the two say which record it is."""
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def one_line(text: Column) -> Column:
    """A header's value: line breaks would end it."""
    return F.regexp_replace(text, r"[\r\n]", " ")


def header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), one_line(value.cast("string")), F.lit("\r\n")), F.lit(""))


def write_archive(records: DataFrame, path: str) -> None:
    """Writes `records` (the columns of `marked`) as gzip files of WARC records with fresh headers to the new folder `path`.

    A response holds the payload after a short HTTP head, a revisit the head alone, whose Content-Length is that of the payload it stands for.
    """
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        header("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", record_id(F.col("refers_to"), F.col("digest"))), header("WARC-Refers-To-Target-URI", F.col("refers_url")))).otherwise(""),
        header(PAGE_ID, F.col("page_id")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", length),
        F.lit("\r\n"),
        head,
        F.when(revisit, "").otherwise(F.col("html")),
    ]
    records.select(F.concat(*lines).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class Records:
    """Puts WARC records together from lines (bytes, without their line feeds)."""

    def __init__(self):
        self.headers: dict[str, str] | None = None
        self.lines: list[bytes] = []
        self.left = 0

    def lines_in(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """Takes a line; gives a record (headers, block) once it is whole."""
        if self.left:
            self.lines.append(line)
            self.left -= len(line) + 1
            if self.left > 0:
                return None
            # the last line may go on with the line break that ends the record, or have ended with the block's own
            self.lines.append(b"")
            return self.closed(b"\n".join(self.lines)[: int(self.headers["content-length"])])
        text = line.rstrip(b"\r")
        if self.headers is None:
            if text.startswith(b"WARC/"):
                self.headers = {}
            elif text:
                raise ValueError(f"no WARC record begins with {text[:40]!r}")
        elif not text:
            length = self.headers.get("content-length")
            if length is None or not length.isdigit():
                raise ValueError(f"a record without Content-Length: {self.headers}")
            self.left = int(length)
            if not self.left:
                return self.closed(b"")
        else:
            name, _, value = text.decode("utf-8", "replace").partition(":")
            self.headers[name.strip().lower()] = value.strip()
        return None

    def closed(self, block: bytes) -> tuple[dict[str, str], bytes]:
        done = self.headers
        self.headers, self.lines, self.left = None, [], 0
        return done, block


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int | None]:
    """(payload, its bytes): what follows the HTTP head of a response; of a revisit none, and what its head says of the length."""
    head, body = b"", block
    if headers.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") != "revisit":
        return body, len(body)
    said = _LENGTH.search(head)
    return None, int(said[1]) if said else None


FIELDS = "record_type string, record_id string, url string, page_id string, payload_digest string, payload_bytes long, refers_to_record string"


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the gzip files (*.gz) in `path`: FIELDS, and payload (binary; null of revisits) if asked for.

    The digest of every response is worked out again; a payload that doesn't match its header, a record without length and a file that ends within a record are errors.
    Digests under another label than sha256 are replaced by the payload's own. A folder without records gives no rows.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * payloads
    types = [pa.int64() if f.endswith("long") else pa.string() for f in FIELDS.split(", ")] + [pa.binary()] * payloads

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, now, file = 0, Records(), None

        def row(headers: dict[str, str], block: bytes) -> tuple:
            payload, size = payload_of(headers, block)
            digest = headers.get("warc-payload-digest", "")
            digest = digest[7:].lower() if digest.startswith("sha256:") else None
            if payload is not None:
                own = hashlib.sha256(payload).hexdigest()
                if digest not in (None, own):
                    raise ValueError(f"the payload of {headers.get('warc-record-id')} has another digest than its header says")
                digest = own
            h = headers.get
            return (h("warc-type"), h("warc-record-id"), h("warc-target-uri"), h(PAGE_ID.lower()), digest, size, h("warc-refers-to")) + ((payload,) if payloads else ())

        for b in batches:
            for name, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name != file:
                    if now.headers is not None:
                        raise ValueError(f"{file} ends within a record")
                    file = name
                if (got := now.lines_in(line.as_py())) is not None:
                    out.append(row(*got))
                    held += 200 + (len(got[1]) if payloads else 0)
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
                    out, held = [], 0
        if now.headers is not None:
            raise ValueError(f"{file} ends within a record")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    lines = spark.read.schema("value string").option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return named.mapInArrow(parse, FIELDS + (", payload binary" if payloads else ""))


def resolved(records: DataFrame) -> DataFrame:
    """`records` (FIELDS) with original_id and original_bytes: of a revisit, page_id and length of the response it stands for; else null.

    Headers are grouped by payload digest, with partial results in each task, and revisits joined to the responses of theirs; where several responses hold a payload
    it is that whose record the revisit names, else the least. A revisit whose response isn't there has nulls.
    """
    responses = records.filter("record_type = 'response'").groupBy("payload_digest", "record_id").agg(F.min("page_id").alias("original_id"), F.max("payload_bytes").alias("original_bytes"))
    revisits = records.filter("record_type = 'revisit'")
    wanted = revisits.groupBy("payload_digest", "refers_to_record").agg(F.count(F.lit(1)).alias("copies"))
    pairs = wanted.alias("w").join(responses.alias("r"), "payload_digest")
    best = F.min(F.struct(~F.col("r.record_id").eqNullSafe(F.col("w.refers_to_record")), "r.record_id", "r.original_id", "r.original_bytes")).alias("x")
    named = F.sha2(F.concat_ws("\n", "payload_digest", "refers_to_record"), 256)
    groups = pairs.groupBy("payload_digest", "refers_to_record").agg(best, F.max("copies").alias("copies")).select(named.alias("digest"), "x.original_id", "x.original_bytes", "copies")
    groups = stored(groups, "warc_originals")
    found = with_first(revisits.withColumn("digest", named), groups, ("original_id", "original_bytes")).drop("digest")
    others = records.filter("record_type is null or record_type <> 'revisit'")
    return found.union(others.select("*", F.lit(None).cast("string").alias("original_id"), F.lit(None).cast("long").alias("original_bytes")))


def deduplicated(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes `pages` (page_id, url, html) as an archive without repeated payloads (in the shared folder if no path is given) and returns its records, read back and resolved."""
    spark = pages.sparkSession
    path = path or new_path(spark, "archive")
    write_archive(marked(pages), path)
    return resolved(stored(read_archive(spark, path), "warc_records"))


def archive_table(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of `pages`, from the archive that was written of them.

    Null html is an empty payload; see `marked` for null and repeated page ids. No pages give no rows; other columns are not read.
    """
    kind = pages.schema["page_id"].dataType
    size = F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("payload_bytes"))
    r = deduplicated(pages)
    return r.select(F.col("page_id").cast(kind).alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", F.col("original_id").cast(kind).alias("refers_to"))


ARCHIVE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f"""
