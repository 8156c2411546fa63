"""Content-addressed WARC archive.

`write` lays a table of pages down as two tables in the shared folder: `payloads`, which stores the bytes of each stored
payload once under its strong digests (SHA-256 as the address, SHA-1 as WARC names it), bucketed by address, and `headers`,
which keeps each record's exact header block, its HTTP header block and its payload's address. `records` rebuilds every
original record, byte for byte, by joining the two; the buckets let the bytes stay where they are, only headers move.
`read` knows nothing but those bytes: it parses the WARC header, the HTTP header and the payload by their stated lengths,
holds payload and lengths against the digests, and takes the page from the record's own name. `export` writes standard
WARC files.

Of records with equal payloads of at least `min_bytes` bytes, that with the largest page_id is a response and the others
are revisits of it; smaller payloads are all responses. Deciding takes one scan that keeps digests only, summed up before
the exchange. The header blocks are made from those facts; the html moves once, to the one row of each address that
stores its bytes. A small payload that very many records share meets them in shares of `share_rows` records.

A record is named by a UUID of the custom version (8) that holds the page_id and a number of its own, so that repeated
page_ids have different names and WARC-Refers-To names the page.

Defined cases: null or empty html is a payload of no bytes. Repeated page_ids give a record each: of repeated rows with
equal payloads, all rows of the largest page_id are responses. A null page_id is smaller than any other. A null url leaves
the target out. Extra columns of the input are not archived. An empty table gives empty tables. A stored payload that does
not match its address, or a record that does not match its lengths and digests, raises on reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

CRLF = "\r\n"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column, number: Column) -> Column:
    """A record's name: <urn:uuid:...> of version 8 with the page_id's 64 bits (variant digit 9: null) and 56 bits of `number`."""
    p = F.lpad(F.hex(F.coalesce(page_id.cast("long"), F.lit(0))), 16, "0")
    own = F.lpad(F.hex(number), 14, "0")
    parts = [F.substring(p, 1, 8), F.substring(p, 9, 4), F.concat(F.lit("8"), F.substring(p, 13, 3)), F.concat(F.when(page_id.isNull(), "9").otherwise("8"), F.substring(p, 16, 1), F.substring(own, 1, 2)), F.substring(own, 3, 12)]
    return F.lower(F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))


def page_of(name: Column) -> Column:
    """The page_id that a record's name holds."""
    digits = F.concat(F.substring(name, 11, 8), F.substring(name, 20, 4), F.substring(name, 26, 3), F.substring(name, 31, 1))
    return F.when(F.substring(name, 30, 1) == "8", F.conv(digits, 16, -10).cast("long"))


def _id(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit(""))


def _store(path: str) -> str:
    """The name that the payloads' bucketed table has in the session's catalog."""
    return "warc_payloads_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def one_line(url: Column) -> Column:
    """A URL with its control characters percent-encoded, as a header line can hold it."""
    control = "[\\x00-\\x1F\\x7F]"
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)), "")
    return F.when(url.rlike(control), coded).otherwise(url)


def write(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z", share_rows: int = 100_000) -> None:
    """Archive pages (page_id, url, html) under path, as payloads and headers."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = pages.select("page_id", "url", F.octet_length(payload).alias("bytes"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"))
    # Written once, so that a record's number stays whatever is computed again.
    facts = materialize(facts.withColumn("number", F.monotonically_increasing_id()), "facts")
    keepers = materialize(facts.groupBy("sha256").agg(F.max(F.struct("page_id", "number")).alias("keeper"), F.count("*").alias("n")).select("sha256", F.col("keeper.page_id").alias("keeper"), F.col("keeper.number").alias("keeper_number"), "n"), "keepers")
    told = facts.join(keepers.where("n > 1"), "sha256", "left")
    revisit = (F.col("bytes") >= min_bytes) & F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", record_id(F.col("page_id"), F.col("number"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", one_line(F.col("url"))), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", record_id(F.col("keeper"), F.col("keeper_number"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")), F.lit(CRLF),
    )
    shares = F.coalesce(F.ceil(F.col("n") / share_rows), F.lit(1)).cast("int")
    share = F.when(shares > 1, F.pmod(F.xxhash64("number"), shares).cast("int"))
    keeper = _id(F.when(F.col("n").isNull(), F.col("page_id")).otherwise(F.col("keeper")))
    told.select(header.alias("header"), http.alias("http"), F.when(~revisit, F.col("sha256")).alias("sha256"), keeper.alias("id"), share.alias("share")).write.parquet(f"{path}/headers")
    # The bytes move once, to the one row that stores them, which is dealt by its page beside its address, as one address may
    # be a third of all rows; shuffled at any size, so that the plan does not hang on a broadcast.
    chosen = keepers.select("sha256", _id(F.col("keeper")).alias("id"), F.ceil(F.col("n") / share_rows).cast("int").alias("shares")).hint("merge")
    bytes_ = pages.select(_id(F.col("page_id")).alias("id"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    one = bytes_.join(chosen, ["sha256", "id"]).groupBy("sha256", "id", "shares").agg(F.first("payload").alias("payload"))
    stored = one.select("sha256", "id", F.sha1("payload").alias("sha1"), "payload", "shares")
    # As many buckets as the shuffle has partitions, by the same keys: each is written by one task.
    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored.write.bucketBy(buckets, "sha256", "id").option("path", f"{path}/payloads").saveAsTable(_store(path))


def _verified(payloads: DataFrame) -> DataFrame:
    """The payloads, each held against its address and digest."""
    fine = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1"))
    return payloads.withColumn("payload", F.when(fine, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("sha256"))).cast("binary")))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload store: the bucketed table, or in another session its files."""
    return spark.table(_store(path)) if spark.catalog.tableExists(_store(path)) else spark.read.parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): every original record's bytes, from its header blocks and, for a response, its payload."""
    heads = spark.read.parquet(f"{path}/headers")
    stored = _verified(payloads(spark, path))
    own = heads.where("sha256 is not null")
    bare = heads.where("sha256 is null").select("header", "http", F.lit(b"").alias("payload"))
    few = own.where("share is null").join(stored.select("sha256", "id", "payload").hint("merge"), ["sha256", "id"]).select("header", "http", "payload")
    many = own.where("share is not null").join(stored.where("shares > 1").select("sha256", "payload", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")), ["sha256", "share"]).select("header", "http", "payload")
    every = bare.union(few).union(many)
    return every.select(F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), "payload", F.encode(F.lit(CRLF + CRLF), "UTF-8")).alias("record"))


def field(header: Column, name: str) -> Column:
    """A header block's field; null where it has none."""
    found = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def parse(archive: DataFrame) -> DataFrame:
    """(record_id, page_id, record_type, payload_bytes, payload_digest, refers_to, target_uri, payload) from the bytes of records, all lengths and digests verified.

    payload_bytes and payload_digest are those of the full payload, of a revisit too; its payload is empty.
    """

    def head(data: Column) -> Column:
        return F.substring_index(data.cast("string"), CRLF + CRLF, 1)

    cut = archive.select("record", head(F.col("record")).alias("header"))
    length = field(F.col("header"), "Content-Length").cast("int")
    cut = cut.select("header", "record", (F.octet_length("header") + 5).alias("at"), length.alias("length"))
    cut = cut.select("header", F.expr("substring(record, at, length)").alias("block"), (F.expr("substring(record, at + length)") == F.lit((CRLF + CRLF).encode())).alias("ends"))
    cut = cut.select("header", "block", "ends", head(F.col("block")).alias("http")).select("header", "ends", "http", F.expr("substring(block, octet_length(http) + 5)").alias("payload"))
    kind, name = field(F.col("header"), "WARC-Type"), field(F.col("header"), "WARC-Record-ID")
    size = field(F.col("http"), "Content-Length").cast("long")
    digest = F.regexp_replace(field(F.col("header"), "WARC-Payload-Digest"), "^sha1:", "")
    full = F.when(kind == "revisit", F.octet_length("payload") == 0).otherwise((F.octet_length("payload") == size) & (F.sha1("payload") == digest))
    fine = F.coalesce(F.col("ends") & full & F.startswith("header", F.lit("WARC/1.1" + CRLF)), F.lit(False))
    checked = F.when(fine, digest).otherwise(F.raise_error(F.concat(F.lit("record does not match its header: "), F.col("header"))))
    return cut.select(name.alias("record_id"), page_of(name).alias("page_id"), kind.alias("record_type"), size.alias("payload_bytes"), checked.alias("payload_digest"), page_of(field(F.col("header"), "WARC-Refers-To")).alias("refers_to"), field(F.col("header"), "WARC-Target-URI").alias("target_uri"), "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """`parse` of the archive's rebuilt records."""
    return parse(records(spark, path))


def export(spark: SparkSession, path: str, out: str) -> None:
    """The records as standard WARC files: the record separator is the text writer's line separator."""
    body = records(spark, path).select(F.decode("record", "UTF-8").alias("value"))
    body.select(F.expr("substring(value, 1, char_length(value) - 4)").alias("value")).write.option("lineSep", CRLF + CRLF).text(out)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Pages archived in the shared folder, then read back from their records' bytes."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
"""
