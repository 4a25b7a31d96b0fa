"""WARC archives: writing, reading and assembling the records of a capture.

Writing. Every page gives three records: the request, the response with the payload (or a revisit without it) and a
metadata record. Request and metadata carry WARC-Concurrent-To with the id of the response. Of the pages with equal
payloads of at least REVISIT_BYTES bytes, the one with the smallest page_id holds the payload, the others revisit it.
Spark's text writer ends each line with the two line ends that end a WARC record, so its files are archives
(compressed by gzip as wholes) and a task that is run again leaves no halves behind.

Reading. Archives are read as binary files and parsed by Content-Length, so payloads may hold anything. Pages are
written by size classes, each with as many records a file as fit FILE_BYTES, so that an archive fits a task.

Assembling. Records are joined through their concurrent-to identifiers: a request or metadata record names the
response, a response may name its request, and a record may name one that names another, however far away: names are
followed until nothing changes, twice as far in each round. Records that only name each other in a circle have none.
There is one nested row a capture: the main record (response, revisit or resource) and arrays of the others. Records
whose names lead to no main record are kept as captures without one. A payload isn't shuffled with the names.

Null payloads are empty ones. Null page ids and repeated rows are pages of their own; among equal payloads null ids
come last, and of rows that are equal in id one holds the payload. Empty tables give empty archives and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, small_batches, written

REVISIT_BYTES = 100
#: Bytes of an archive, about, and the largest page of each size class but the last.
FILE_BYTES, CLASSES = 64 << 20, (1 << 16, 1 << 20, 1 << 24)
END = "\r\n"
#: Parts that a frequent payload's pages are joined in.
SALT = 64
MAIN = ("response", "revisit", "resource")
RECORD = "record_id string, type string, target_uri string, concurrent_to array<string>, refers_to string, page_id bigint, refers_to_page bigint, payload_bytes bigint, payload_digest string, digest_ok boolean, fields map<string,string>, block binary"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, rid: Column, uri: Column, content: str, block: Column, *more: tuple[str, Column]) -> Column:
    """The text of a record without the two line ends after it; a header whose value is null is left out. uri: without
    blanks."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    top = line(f"WARC/1.1{END}WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), line("WARC-Record-ID", rid), line(f"WARC-Date: 2024-01-01T00:00:00Z{END}WARC-Target-URI", uri)
    # nulls are no lines
    return F.concat(F.concat_ws(END, *top, *[line(*x) for x in more], line(f"Content-Type: {content}{END}Content-Length", F.octet_length(block))), F.lit(END + END), block)


def _grade(size: Column) -> Column:
    """The class of a page's size."""
    return sum(((size > x).cast("int") for x in CLASSES), F.lit(0))


def numbered(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload) with row, digest, n (bytes) and grade: a table written once, in a folder for each
    grade, so that rows keep their numbers whatever is read from it."""
    rows = pages.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("grade", _grade(F.greatest(F.col("n"), F.octet_length("url").cast("long"))))
    path = scratch(pages.sparkSession, "numbered")
    rows.write.partitionBy("grade").parquet(path)
    return pages.sparkSession.read.schema(rows.schema).parquet(path)


def owners(rows: DataFrame) -> DataFrame:
    """digest, salt, owner (row), owner_page of payloads with copies; a written table."""
    first = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "row")).alias("first"))
    # only payloads with copies are joined, in parts
    first = first.where("copies > 1").select("digest", F.col("first.row").alias("owner"), F.col("first.page_id").alias("owner_page"))
    return written(first, "owners").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def roles(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows of `numbered` with record_type, owner (row) and owner_page."""
    out = rows.withColumn("salt", (F.pmod(F.xxhash64("row"), F.lit(SALT))).cast("int")).join(first, ["digest", "salt"], "left").drop("salt")
    other = (F.col("n") >= REVISIT_BYTES) & (F.col("owner") != F.col("row"))
    return out.withColumn("record_type", F.when(other, "revisit").otherwise("response"))


def write(pages: DataFrame, path: str, payload: str = "html", url: str = "url", page_id: str = "page_id") -> None:
    table = numbered(pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("about:blank")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")))
    first = owners(table)
    rid, uri, page = F.col("__rid"), F.col("__uri"), ("WARC-Page-ID", F.col("page_id"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    main = _record(
        F.col("record_type"),
        rid,
        uri,
        "application/http; msgtype=response",
        F.col("__block"),
        page,
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, _urn(F.lit("main"), F.col("owner"), F.col("digest")))),
        ("WARC-Refers-To-Page-ID", F.when(revisit, F.col("owner_page"))),
    )
    request = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}{END}"))
    request = _record("request", _urn(F.lit("request"), F.col("row"), F.col("digest")), uri, "application/http; msgtype=request", request, page, ("WARC-Concurrent-To", rid))
    meta = F.concat(F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit(END))
    meta = _record("metadata", _urn(F.lit("metadata"), F.col("row"), F.col("digest")), uri, "application/warc-fields", meta, page, ("WARC-Concurrent-To", rid))
    records = F.explode(F.array(request, main, meta)).alias("value")
    # what is named several times is made once, before the records: the JVM compiles no method of over 8,000 bytes
    once = {"__rid": _urn(F.lit("main"), F.col("row"), F.col("digest")), "__uri": F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), "__block": F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))}
    # as many as there are classes, at most
    for g in sorted({0, *(r[0] for r in table.select("grade").distinct().collect())}):
        # a page is three records, one of which holds the payload; the last class has no largest page
        most = max(3 * FILE_BYTES // CLASSES[g], 3) if g < len(CLASSES) else 3
        own = roles(table.where(F.col("grade") == g), first).withColumns(once).select(records).write.option("lineSep", END + END).option("compression", "gzip")
        # the usual level takes half of the writing's time, for an eighth less of bytes
        own.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).mode("append").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of every record."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        head: dict[str, list[str]] = {}
        for x in data[at:stop].decode("utf-8", "replace").split(END)[1:]:
            name, _, value = x.partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        n = int(head["content-length"][0])
        yield head, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n


def _row(head: dict[str, list[str]], block: bytes, keep: bool) -> dict:
    one = lambda k: (head.get(k) or [None])[0]
    number = lambda x: int(x) if x not in (None, "") else None
    kind, content = one("warc-type"), one("content-type") or ""
    payload, fields = block, {}
    if "application/http" in content:
        payload = block.partition(b"\r\n\r\n")[2]
    elif "warc-fields" in content:
        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(END) if ": " in x)
    said = (one("warc-payload-digest") or "").partition(":")[2] or None
    held = kind in ("response", "resource")
    found = hashlib.sha256(payload).hexdigest() if held else None
    return {
        "record_id": one("warc-record-id"),
        "type": kind,
        "target_uri": one("warc-target-uri"),
        "concurrent_to": head.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"),
        "page_id": number(one("warc-page-id")),
        "refers_to_page": number(one("warc-refers-to-page-id")),
        "payload_bytes": len(payload) if held else None,
        "payload_digest": found or said,
        "digest_ok": found == said if held and said else None,
        "fields": list(fields.items()),
        "block": block if keep else None,
    }


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of all archives under path. Without blocks only what is known about them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(spark)
    schema = StructType.fromDDL(RECORD)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import zlib

        for b in batches:
            for i in range(len(b)):
                data = b.column(0)[i].as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":  # one member or many
                    parts = []
                    while data[:2] == b"\x1f\x8b":
                        d = zlib.decompressobj(31)
                        parts.append(d.decompress(data))
                        data = d.unused_data
                    data = b"".join(parts)
                rows = []
                for head, block in parse(data):
                    rows.append(_row(head, block, blocks))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: transaction (id of its main record), main, requests, metadata, others.

    Every record looks for its main record: itself, or the first one that its concurrent-to names lead to. A main
    record that names others is found from them the other way round."""
    is_main = F.col("type").isin(*MAIN)
    light = records.select("record_id", is_main.alias("is_main"), "concurrent_to")
    links = light.select("record_id", F.col("is_main").alias("from_main"), F.explode("concurrent_to").alias("to"))
    # a record is named by a main one
    named = links.where("from_main").groupBy("to").agg(F.min("record_id").alias("namer"))
    first = F.try_element_at(F.array_sort("concurrent_to"), F.lit(1))
    step = records.join(named, records["record_id"] == named["to"], "left").drop("to")
    step = step.withColumn("__at", F.when(is_main, F.col("record_id")).otherwise(F.coalesce("namer", first, "record_id"))).drop("namer")
    # names that lead to a record which isn't a main one lead on from there
    leads = light.where(~F.col("is_main") & (F.size("concurrent_to") > 0)).join(named, F.col("record_id") == F.col("to"), "left")
    onward = leads.select(F.col("record_id").alias("__from"), F.coalesce("namer", first).alias("__to")).dropDuplicates(["__from"])
    far = lambda df: df.join(onward.select(F.col("__from").alias("__to"), F.col("__to").alias("__next")), "__to")
    if not far(onward).isEmpty():
        onward = written(onward, "names")
        for _ in range(onward.count().bit_length()):
            moved = far(onward).select("__from", F.col("__next").alias("__to"))
            if moved.isEmpty():
                break
            onward = written(onward.join(moved, "__from", "left_anti").unionByName(moved), "names")
        step = step.join(onward, step["__at"] == onward["__from"], "left").withColumn("__at", F.when(is_main, F.col("__at")).otherwise(F.coalesce("__to", "__at"))).drop("__from", "__to")
    own = F.struct(*[F.col(c) for c in records.columns])
    of = lambda cond: F.collect_list(F.when(cond, own))
    return step.groupBy(F.col("__at").alias("transaction")).agg(
        F.max_by(F.when(is_main, own), F.when(is_main, F.col("record_id"))).alias("main"),
        of(F.col("type") == "request").alias("requests"),
        of(F.col("type") == "metadata").alias("metadata"),
        of(~is_main & ~F.col("type").isin("request", "metadata")).alias("others"),
    )


def captures(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages written as archives in the shared folder and read back, a row a capture. Archives are parsed once: what is
    known about their records is kept, as assembling looks at it several times."""
    path = scratch(spark, "warc")
    write(pages, path)
    return assemble(written(read(spark, path, blocks=False).drop("block"), "records"))


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    main, meta = F.col("main"), F.try_element_at("metadata", F.lit(1))
    return captures(spark, pages).select(
        main["page_id"].alias("page_id"),
        F.coalesce(main["payload_bytes"], meta["fields"]["payload-bytes"].cast("long")).alias("payload_bytes"),
        main["payload_digest"].alias("payload_digest"),
        main["type"].alias("record_type"),
        main["refers_to_page"].alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
    )
