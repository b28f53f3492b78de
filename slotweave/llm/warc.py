"""WARC archives: written by Spark's text writer, read back by verifying the chain of records.

The reader splits the files at the magic of a record header, wherever it occurs, also inside
payloads. Each task reports, for every piece it meets, where the record would begin and, by its
Content-Length, where its successor would. Following these offsets inside a block of the file
gives every candidate's way out of the block; pointer jumping over the blocks, from the first
byte of each file, finds where each block is entered. Only records on that chain are kept: a
magic inside a payload is never the successor of a real record. Headers may have any length.

A payload that holds the magic comes in several pieces; the pieces of such records are read in a
second scan and joined, all others are digested where they are read and never leave their task.

Null payloads are empty; null URLs are left out; a null page_id is written as such and comes
back null. Repeated rows are records of their own (each copy with the largest id of its group is
a response). Files that do not begin with the magic hold no records. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.llm.common import write_stage
from slotweave.session import scratch_path

# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

REVISIT_BYTES = 1000


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))


def write_archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write one record per page and return the archive's folder.

    Of equal payloads of at least ``revisit_bytes`` bytes the one with the largest page_id is a
    response, the others are revisits without a block.
    """
    path = scratch_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", " ").alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("size"),
        F.sha2(body, 256).alias("content"),
    )
    first = (
        rows.where(F.col("size") >= revisit_bytes)
        .groupBy("content")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("content", "kept")
    )
    first = write_stage(first, "copies")
    typed = rows.join(first, "content", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        _header("WARC-Date", F.lit(RECORD_DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("body"))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("kept").cast("string"), F.lit(">")))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("X-Payload-Length", F.col("size")),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("body")),
    )
    typed.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)
    return path


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset inside the block's pieces, bytes): pieces of a block come in order."""
    place, offset = None, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, block) != place:
                place, offset = (file, block), 0
            yield file, block, offset, value
            offset += len(value) + len(MAGIC)


def parse_header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields (lower-case names) and length of a record header after the magic; None if it is none."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for line in piece[:stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in fields or not fields.get("content-length", "").isdecimal():
        return None
    return fields, stop + 4


_PIECE = "file string, block long, at long, size long, jump long, whole boolean, fields map<string,string>, length long, digest string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece its size and, if a record could begin here, the distance to its successor."""
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("jump", pa.int64())]
        + [("whole", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("length", pa.int64()), ("digest", pa.string())]
    )
    rows: list[tuple] = []
    for file, block, at, value in _located(batches):
        parsed = parse_header(value)
        row = (file, block, at, len(value), None, False, None, None, None)
        if parsed:
            fields, head = parsed
            length = int(fields["content-length"])
            whole = len(value) >= head + length
            digest = hashlib.sha1(value[head : head + length]).hexdigest() if whole else None
            row = (*row[:4], len(MAGIC) + head + length + 4, whole, list(fields.items()), length, digest)
        rows.append(row)
        if len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _exits(block: pa.Table) -> pa.Table:
    """Where the chain from each candidate leaves its block; null if it breaks inside."""
    start = block["start"].to_numpy()
    jump = block["next"].to_numpy()
    order = np.argsort(start)
    start, jump = start[order], jump[order]
    last = start[-1]
    way = jump.copy()
    index = np.searchsorted(start, jump)
    for i in range(len(start) - 1, -1, -1):
        if jump[i] <= last:
            j = index[i]
            way[i] = way[j] if start[j] == jump[i] and j > i else -1
    return pa.table({"file": block["file"].take(pa.array(order)), "block": block["block"].take(pa.array(order)), "start": start, "way": way})


def _entered(block: pa.Table) -> pa.Table:
    """The records on the chain from the block's entry."""
    start = block["start"].to_numpy()
    order = np.argsort(start)
    start, jump = start[order], block["next"].to_numpy()[order]
    at, marked = block["entry"][0].as_py(), []
    while at is not None:
        i = int(np.searchsorted(start, at))
        if i == len(start) or start[i] != at:
            break
        marked.append(i)
        at = int(jump[i]) if jump[i] > at else None
    taken = pa.array(order[marked])
    return block.take(taken).select(["file", "block", "start"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """file, start, fields, length and digest (SHA-1 of the block) of every record on the chain."""
    pieces = write_stage(_pieces(spark, path).mapInArrow(_report, _PIECE), "pieces")
    sizes = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    sizes = sizes.withColumn("entry0", F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1)
    # A piece begins after a magic; what comes before the first magic of a file is no candidate.
    placed = pieces.join(sizes.select("file", "block", "base"), ["file", "block"])
    placed = placed.withColumn("start", F.col("base") + F.col("at") - len(MAGIC)).where("start >= 0")
    placed = write_stage(placed.withColumn("next", F.col("start") + F.col("jump")).drop("base"), "candidates")
    candidates = placed.where("next is not null").select("file", "block", "start", "next")
    ways = candidates.groupBy("file", "block").applyInArrow(_exits, "file string, block long, start long, way long")
    ways = write_stage(ways.where("way >= 0").select("file", "start", "way"), "ways")
    most = sizes.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached = placed.select("file").distinct().select("file", F.lit(0).cast("long").alias("start"))
    # After round k the set holds all block entries within 2^k blocks of the file's start.
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        reached = write_stage(reached.union(reached.join(ways, ["file", "start"]).select("file", F.col("way").alias("start"))).distinct(), "reached")
        further = ways.select("file", "start", F.col("way").alias("mid")).join(
            ways.select("file", F.col("start").alias("mid"), "way"), ["file", "mid"], "left"
        )
        ways = write_stage(further.where("way is not null").select("file", "start", "way"), "ways")
    entries = reached.join(candidates.select("file", "block", "start"), ["file", "start"]).select("file", "block", F.col("start").alias("entry"))
    chain = candidates.join(entries, ["file", "block"]).groupBy("file", "block").applyInArrow(_entered, "file string, block long, start long")
    chain = write_stage(chain, "chain")
    records = placed.join(chain, ["file", "block", "start"]).select("file", "start", "fields", "length", "digest", "whole")
    split = _split_payloads(spark, path, placed, chain)
    whole = records.where("whole").drop("whole")
    if split is None:
        return whole
    return whole.unionByName(records.where("not whole").drop("digest", "whole").join(split, ["file", "start"]))


def _split_payloads(spark: SparkSession, path: str, placed: DataFrame, chain: DataFrame) -> DataFrame | None:
    """Digests of the records whose payload holds the magic, or None if there are none."""
    owner = F.last("record", ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    owned = placed.join(chain.withColumn("record", F.col("start")), ["file", "block", "start"], "left").withColumn("owner", owner)
    open_records = placed.join(chain, ["file", "block", "start"]).where("not whole").select("file", F.col("start").alias("owner"))
    needed = write_stage(owned.select("file", "block", "at", "owner").join(open_records, ["file", "owner"]), "open")
    if needed.isEmpty():
        return None

    def values(batches):
        for file, block, at, value in _located(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "at": [at], "value": [value]})

    parts = _pieces(spark, path).mapInArrow(values, "file string, block long, at long, value binary").join(needed, ["file", "block", "at"])

    def digest(record: pa.Table) -> pa.Table:
        order = sorted(range(record.num_rows), key=lambda i: (record["block"][i].as_py(), record["at"][i].as_py()))
        text = MAGIC.join(record["value"][i].as_py() for i in order)
        fields, head = parse_header(text)
        block = text[head : head + int(fields["content-length"])]
        return pa.table({"file": record["file"].slice(0, 1), "start": record["owner"].slice(0, 1), "digest": [hashlib.sha1(block).hexdigest()]})

    return parts.groupBy("file", "owner").applyInArrow(digest, "file string, start long, digest string")


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's digest is that of its block as read."""
    field = F.col("fields")
    page = lambda name: F.regexp_extract(field[name], r"^<urn:page:(-?\d+)>$", 1)
    revisit = field["warc-type"] == "revisit"
    number = lambda text: F.when(text != "", text.cast("long"))
    return records.select(
        number(page("warc-record-id")).alias("page_id"),
        F.when(revisit, field["x-payload-length"].cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(field["warc-payload-digest"], "^sha1:(.*)$", 1)).otherwise(F.col("digest")).alias("payload_digest"),
        field["warc-type"].alias("record_type"),
        F.when(revisit, number(page("warc-refers-to"))).alias("refers_to"),
    )
