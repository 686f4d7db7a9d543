"""Hosts exports: address mappings in comments, name=blob lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import b32_address, decode_blob, identity_hash

#: Lines of a text that one task reads in order.
BLOCK_LINES = 50_000
HEADER = r"^#\s*(.+?):\s+(.+?)\.b32\.i2p"


def header(line: Column) -> Column:
    """(name, address) of a comment that maps a name to an address, each null where it is blank; null for other lines."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(line, HEADER, i)), F.lit(""))
    return F.when(line.startswith("#"), F.struct(part(1).alias("name"), part(2).alias("address")))


def carry_headers(lines: DataFrame) -> DataFrame:
    """lines (path, block, pos, line) with the name and address of the last header at or above each line of its path.

    The blocks of a path follow each other, and pos orders the lines of a block. Each block is read on its own; then the
    last header of each block, one small row, is handed to the blocks after it. So a file of any size spreads over tasks.
    """
    at = lines.withColumn("_h", header(F.col("line")))
    so_far = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = ("name", "address")
    own = at.select("path", "block", "pos", "line", *[F.last(f"_h.{c}", True).over(so_far).alias(f"_{c}") for c in parts])
    # a row a block: what it ends with, and what those before it end with
    ends = at.groupBy("path", "block").agg(*[F.max_by(f"_h.{c}", F.when(F.col(f"_h.{c}").isNotNull(), F.col("pos"))).alias(f"_{c}") for c in parts])
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("path", "block", *[F.last(f"_{c}", True).over(before).alias(f"_handed_{c}") for c in parts])
    both = own.join(handed, ["path", "block"])
    return both.select("path", "block", "pos", "line", *[F.coalesce(f"_{c}", f"_handed_{c}").alias(c) for c in parts])


def entries(lines: DataFrame) -> DataFrame:
    """The name=blob lines of (path, block, pos, line): path, block, pos, i2p_dns_name, ident_hash_hex, b32_raw, dest_data_len,
    dest_b64. The name and address of the header above go before the line's own. Lines that don't decode are skipped."""
    data = carry_headers(lines).where(~F.col("line").startswith("#") & F.col("line").contains("="))
    data = data.withColumn("own", F.trim(F.substring_index("line", "=", 1))).withColumn("dest_b64", F.trim(F.substring_index(F.expr("substring(line, instr(line, '=') + 1)"), "#!sig=", 1)))
    data = data.withColumn("raw", decode_blob(F.col("dest_b64"))).where((F.col("dest_b64") != "") & F.col("raw").isNotNull())
    h = identity_hash(F.col("raw"))
    return data.select("path", "block", "pos", F.coalesce("name", "own").alias("i2p_dns_name"), h.alias("ident_hash_hex"), F.coalesce("address", b32_address(h)).alias("b32_raw"), F.octet_length("raw").alias("dest_data_len"), "dest_b64")


def parse_hosts(files: DataFrame) -> DataFrame:
    """Rows of hosts exports, from a table (path, value) of whole texts; pos is the line's number from 0.

    A comment `# name: address.b32.i2p` holds for all later lines of its text. Null texts have no lines.
    """
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    return entries(lines.withColumn("block", F.floor(F.col("pos") / BLOCK_LINES))).drop("block")


def read_hosts(spark, path: str) -> DataFrame:
    """Rows of the hosts exports of a path. Spark cuts large files by its own rules; a cut is a block, and the order of its
    lines is that in which its task reads them."""
    # numbers only order lines within a block, which one task reads, so another scan gives the same order
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))
    return entries(lines)


def blob_of(entries: DataFrame, hash_hex: str) -> DataFrame:
    """The first entry of a hash."""
    found = entries.where(F.col("ident_hash_hex") == hash_hex.upper())
    return found.orderBy(*[c for c in ("path", "block", "pos") if c in entries.columns]).limit(1)
