"""A content-addressed web archive: payloads once by verified digest, exact record headers apart, records by joining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthstat.llm.common import stage_path

LEAST = 100
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: digest of its payload and the exact header of its record, without the payload itself.

    The payload is the page in UTF-8, a NULL page an empty one. Of equal payloads of ``least`` bytes or more the one with
    the smallest page id becomes a response, all others revisits that refer to it; repeated rows of that id are responses
    too, and so is every smaller payload. Pages without an id come after all others; a payload that only they have is a
    response in each. A header holds the WARC fields and the HTTP head that opens the record's block. Line ends in an
    address are escaped; a NULL address leaves its field out.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.octet_length(body).cast("long").alias("bytes"),
                        F.sha2(body, 256).alias("digest"))
    first = slim.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first_id"))
    known = slim.join(first, slim["digest"] == first["_digest"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    size = F.col("bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return known.select("digest", F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http).cast("binary").alias("header"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write ``payloads`` (digest, payload; each content once) and ``headers`` (digest, header; one per page) under a path.

    Equal payloads meet in map-side grouping first, so a content that a third of all pages share leaves each task once.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    payloads = pages.select(F.sha2(body, 256).alias("digest"), body.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    records(pages, least, page_id, url, html).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The pages again: page_id, url, record_type, refers_to, digest, header, payload.

    Every stored payload is digested again; one that does not match its address, or a header whose payload is missing,
    fails the read. A revisit gets the payload that its digest names.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    stored = stored.select(
        F.col("digest").alias("_digest"), "payload",
        F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), "digest"))).alias("verified"))
    heads = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    joined = heads.join(stored, heads["digest"] == stored["_digest"], "left")
    text = F.decode(F.col("header"), "UTF-8")
    known = F.coalesce(F.col("verified"), F.raise_error(F.concat(F.lit("no payload is stored for "), heads["digest"])).cast("string"))
    number = lambda name: F.regexp_extract(_field(text, name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return joined.select(
        number("WARC-Record-ID").alias("page_id"), _field(text, "WARC-Target-URI").alias("url"),
        _field(text, "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        known.alias("digest"), "header", "payload")


def full_records(pages: DataFrame) -> DataFrame:
    """Whole WARC records as bytes, from what ``read_archive`` returns: header, payload unless it is a revisit, end."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return pages.select("page_id", F.concat("header", body, F.lit(END.encode())).alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write ``full_records`` as plain WARC files: Spark's text writer with the record end as line end, so any store works."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    pages.select(F.concat("header", body).cast("string").alias("value")).write.option("lineSep", END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files by their lengths: header (WARC fields and the HTTP head) and payload, both as exact bytes.

    A file is one row of the reader, so files should stay within the memory of a task, as ``write_warc`` makes them from
    partitions of the usual size.
    """
    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("content"):
                raw, at, heads, bodies = data.as_py(), 0, [], []
                while at < len(raw):
                    start = raw.index(b"\r\n\r\n", at) + 4
                    fields = dict(line.split(b": ", 1) for line in raw[at:start].split(b"\r\n")[1:] if b": " in line)
                    end = start + int(fields[b"Content-Length"])
                    head = raw.index(b"\r\n\r\n", start, end) + 4
                    heads.append(raw[at:head])
                    bodies.append(raw[head:end])
                    if raw[end:end + 4] != b"\r\n\r\n":
                        raise ValueError("a record does not end where its length says")
                    at = end + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["header", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "header binary, payload binary")


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write an archive in the shared folder and read it back."""
    path = stage_path(pages.sparkSession, "archive")
    write_archive(pages, path, least)
    return read_archive(pages.sparkSession, path)
