"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

Writing: one record per page as a row of text that Spark's own writer ends, so a file is a plain concatenation of
records and a lost task is redone by the committer. Of equal payloads of 100 bytes or more the smallest page_id is
stored, the others refer to it.

Reading: Spark splits archives at every occurrence of the magic line, inside payloads too. Each occurrence is a
candidate; its header gives the offset of its successor. Candidates whose successor is the next occurrence form runs
within which nothing is left to decide; pointer jumping over the runs from the start of each file (as many rounds as
the logarithm of the runs in a file) finds those that are reachable and where they are entered. All else is payload:
it is put back into the record that spans it. Only offsets and lengths take part in this.

Defined results: null html is an empty payload; a null page_id is written as such, never refers, and is referred to by
none; equal payloads with the same smallest page_id are responses all; null urls have no target line, and spaces and line
ends in urls are percent-encoded; empty archives give no records; a chain that meets a damaged header
ends there, and what follows in that file isn't reachable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_groups, materialize, scratch_path

MAGIC = "WARC/1.1\r\n"
LEAST_BYTES = 100  # smaller payloads are stored again
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
FEW = 100_000  # rows of three small columns that are broadcast at most
PAGE = "urn:page:"
DATE = "1970-01-01T00:00:00Z"


def with_targets(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: the payload is stored here)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    big = rows.where((F.col("payload_bytes") >= LEAST_BYTES) & F.col("page_id").isNotNull())
    groups = big.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("size"), F.min("page_id").alias("first")).where("size > 1")
    groups = materialize(groups, "warc-groups")
    rows = join_groups(rows, groups, "payload_digest", "size")
    return rows.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("size", "first")


def _lines(*lines: tuple[str, Column]) -> Column:
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in lines])


def record(page_id: str = "page_id", url: str = "url") -> Column:
    """The record without its very last line feed, from the columns of with_targets()."""
    uri = lambda c: F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    target = F.col(url)
    for blank, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A")):
        target = F.replace(target, F.lit(blank), F.lit(code))
    head = _lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", uri(page_id)),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(revisit, uri("refers_to"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", length.cast("string")),
    )
    return F.concat(F.lit(MAGIC), head, F.lit("\r\n"), block, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str, **names: str) -> None:
    with_targets(pages, **names).select(record().alias("value")).write.option("lineSep", "\n").text(path)


def _field(head: Column, name: str, what: str = r"([^\r\n]*)") -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*{what}[ \t]*\r?$", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece between two magics: file, at (offset of its magic), after (where the next one stands),
    next (offset of the record's successor by its own header; null: none can be told), head_bytes, piece, __block, __row."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"), F.col("value").alias("piece"))
    head = F.substring_index("piece", "\r\n\r\n", 1)
    ends = F.contains("piece", F.lit("\r\n\r\n"))
    raw = raw.withColumns({"head_bytes": F.octet_length(head).cast("long") + 4, "length": F.when(ends, F.try_to_number(_field(head, "Content-Length", r"(\d{1,18})"), F.lit("9" * 18)).cast("long")), "bytes": F.octet_length("piece").cast("long")})
    return raw


def chain(found: DataFrame) -> DataFrame:
    """From (file, __block, __row, head_bytes, length, bytes) of a written table: file, __block, __row, at, end and
    real, for every candidate. end is where the record's block ends, if it is real."""
    step = F.col("bytes") + len(MAGIC)
    inside = W.partitionBy("file", "__block").orderBy("__row").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = found.groupBy("file", "__block").agg(F.sum(step).alias("n"))
    blocks = blocks.select("file", "__block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    at = F.coalesce(F.sum(step).over(inside), F.lit(0)) + F.col("before") - len(MAGIC)
    rows = found.join(blocks, ["file", "__block"]).withColumn("at", at).where("at >= 0")
    rows = rows.withColumns({"after": F.col("at") + len(MAGIC) + F.col("bytes"), "end": F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length")})
    rows = materialize(rows.withColumn("next", F.col("end") + 4).withColumn("breaks", ~F.coalesce(F.col("next") == F.col("after"), F.lit(False))), "warc-candidates")
    # Runs: a run ends with a candidate whose successor isn't the next magic.
    broken = rows.groupBy("file", "__block").agg(F.count(F.when(F.col("breaks"), 1)).alias("n"))
    broken = broken.select("file", "__block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("runs_before"))
    run = F.coalesce(F.count(F.when(F.col("breaks"), 1)).over(inside), F.lit(0)) + F.col("runs_before")
    rows = materialize(rows.join(broken, ["file", "__block"]).withColumn("run", run), "warc-runs")
    runs = rows.groupBy("file", "run").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.max_by("next", "at").alias("next"))
    runs = materialize(runs, "warc-run-table")
    most = runs.agg(F.max("run")).first()[0] or 0
    entered = runs.where("run = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    if most:
        # The successor of a run's last candidate, if it is a candidate at all, lies in a later run.
        exits = runs.where("next is not null").select("file", F.col("run").alias("from"), F.col("next").alias("entry"))
        jumps = rows.select("file", "run", "at").join(exits, (F.col("at") == F.col("entry")) & (rows["file"] == exits["file"])).select(rows["file"], "from", "run", "entry")
        hops = jumps = materialize(jumps, "warc-jumps")
        reached = materialize(entered, "warc-reached")
        for _ in range(math.ceil(math.log2(most + 1)) + 1):
            further = reached.select("file", F.col("run").alias("from")).join(hops, ["file", "from"]).select("file", "run", "entry")
            reached = materialize(reached.unionByName(further).dropDuplicates(["file", "run"]), "warc-reached")
            far = hops.select("file", F.col("from").alias("__from"), F.col("run").alias("from"))
            hops = materialize(far.join(hops, ["file", "from"]).select("file", F.col("__from").alias("from"), "run", "entry"), "warc-hops")
        entered = reached
    real = rows.join(entered, ["file", "run"], "left")
    return real.select("file", "__block", "__row", "at", "end", "breaks", F.coalesce(F.col("at") >= F.col("entry"), F.lit(False)).alias("real"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, head, block (its content). Payloads with the magic inside come back whole.

    Archives are scanned twice, for offsets and for content; only the pieces of records that a payload's magic cut up
    are joined to the chain, the others are records as they stand.
    """
    pieces = candidates(spark, path)
    links = materialize(chain(materialize(pieces.drop("piece"), "warc-pieces")), "warc-links")
    odd = links.where("breaks or not real")
    n_odd = odd.count()
    head = F.substring_index("piece", "\r\n\r\n", 1)
    start = F.length(head) + 5
    even = pieces.where(F.octet_length("piece") > 0)
    if n_odd:
        key = ["file", "__block", "__row"]
        lookup = odd.select(*key)
        even = even.join(F.broadcast(lookup) if n_odd <= FEW else lookup, key, "left_anti")
    whole = even.select("file", head.alias("head"), F.substr("piece", start, F.length("piece") - start - 3).alias("block"))
    if not n_odd:
        return whole
    # Cut up records: their pieces again in order, up to the end that the header gives.
    owner = F.last(F.when(F.col("real"), F.struct("at", "end")), True).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    owned = odd.withColumn("owner", owner).where("owner.end is not null and at < owner.end")
    parts = pieces.join(F.broadcast(owned) if n_odd <= FEW else owned, key)
    parts = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    parts = parts.withColumn("piece", F.array_join(F.transform("parts", lambda x: x["piece"]), MAGIC))
    size = F.col("owner.end") - F.col("owner.at") - len(MAGIC) - F.octet_length(head) - 4
    content = F.substr(F.substr("piece", start).cast("binary"), F.lit(1), size.cast("int")).cast("string")
    rebuilt = parts.where(F.octet_length("piece") >= F.octet_length(head) + 4 + size)
    return whole.unionByName(rebuilt.select("file", head.alias("head"), content.alias("block")))


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, url, intact.

    A stored payload is measured and hashed as read, and intact if that agrees with its header; a revisit keeps the
    length and digest that it was written with.
    """
    head, http = F.col("head"), F.substring_index("block", "\r\n\r\n", 1)
    page = lambda name: F.try_to_number(_field(head, name, rf"<{PAGE}(-?\d{{1,19}})>"), F.lit("S" + "9" * 19)).cast("long")
    stored = _field(head, "WARC-Type") == "response"
    payload = F.when(stored, F.substr("block", F.length(http) + 5))
    stated = F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha256:", "")
    length = F.try_to_number(_field(http, "Content-Length", r"(\d{1,18})"), F.lit("9" * 18)).cast("long")
    out = records.select(page("WARC-Record-ID").alias("page_id"), payload.alias("payload"), length.alias("length"), stated.alias("stated"), _field(head, "WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), _field(head, "WARC-Target-URI").alias("url"))
    digest = F.coalesce(F.sha2(F.col("payload").cast("binary"), 256), "stated")
    out = out.withColumns({"payload_bytes": F.coalesce(F.octet_length("payload").cast("long"), "length"), "payload_digest": digest, "intact": digest == F.col("stated")})
    return out.drop("length", "stated")


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write pages to an archive in the shared folder, and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, **names)
    return pages_of(read(spark, path))
