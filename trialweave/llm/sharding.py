"""Sharding by extendible hashing, in DataFrame functions only.

The hash of a document is the first ``BITS`` bits of the MD5 of its key. A directory starts with one bucket for
all; a bucket above the byte limit splits on the next bit, and no other does, until every bucket fits. Since the bytes
of a prefix only shrink as it grows, a document's bucket is its shortest prefix whose bytes fit: bytes are summed
once per fine prefix, and depths are read off those sums. Fine prefixes that do not fit are refined in a further
round of more bits, over their documents alone.

Documents that share all ``BITS`` bits cannot be parted by hash: such a bucket is cut by a running sum into
numbered pages that fit (pages above 0). One document above the limit is a page of its own and flagged.

Null text counts no bytes, a null key hashes as the empty string; rows that repeat a key stay together unless
they exceed the limit. An empty table gives no rows. Columns of the input stay, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordering import running_sum
from ..plans.sizing import measured
from .store import stored

BITS = 60
RESULTS = ("shard", "depth", "page", "bytes", "oversized")


def hash_bits(key: str) -> Column:
    """The first 60 bits of the MD5 of the key's text, as BIGINT."""
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(value: Column, bits: Column | int) -> Column:
    """The leading ``bits`` of a hash."""
    return F.call_function("shiftright", value, (F.lit(BITS) - bits).cast("int"))


def _directory(cells: DataFrame, above: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth): the depth of the bucket of each ``bits``-bit cell, null where the cell itself is too large.

    ``above``: bits that are known not to fit.
    """
    spread = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth"))
    wide = F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth"))
    sums = spread.groupBy("depth", wide.alias("prefix")).agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") <= limit)
    fits = spread.select("cell", "depth", wide.alias("prefix")).join(sums.select("depth", "prefix"), ["depth", "prefix"])
    least = fits.groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(least, "cell", "left")


def shard(documents: DataFrame, limit: int, key: str = "doc_id", step: int = 10) -> DataFrame:
    """Add shard string (the bits of the bucket), depth int, page long, bytes long, oversized boolean."""
    kept = [c for c in documents.columns if c not in RESULTS]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = documents.select(*[F.col(f"`{c}`") for c in kept], hash_bits(key).alias("__hash"), size.alias("bytes"))
    total = documents.agg(F.sum(size).alias("n")).first()["n"] or 0
    # cells a thousandth of a bucket in size, if keys are spread evenly
    bits, above = min(BITS, max(0, (total // max(limit, 1)).bit_length()) + step), 0
    directories, left = [], rows.select("__hash", "bytes")
    while True:
        cell = prefix(F.col("__hash"), bits)
        cells = stored(left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")), "shard-cells")
        directory = stored(_directory(cells, above, bits, limit), "shard-directory")
        directories.append((bits, directory))
        open_cells = directory.filter("depth IS NULL").select("cell")
        if bits == BITS or open_cells.isEmpty():
            break
        left = left.withColumn("cell", cell).join(measured(open_cells), "cell", "left_semi").drop("cell")
        above, bits = bits + 1, min(BITS, bits + step)
    found = rows.withColumn("depth", F.lit(None).cast("int"))
    for bits, directory in directories:
        own = directory.filter("depth IS NOT NULL").select(F.col("cell").alias("__cell"), F.col("depth").alias("__depth"))
        found = found.withColumn("__cell", prefix(F.col("__hash"), bits)).join(measured(own), "__cell", "left")
        found = found.withColumn("depth", F.coalesce("depth", "__depth")).drop("__cell", "__depth")
    full = F.coalesce(F.col("depth"), F.lit(BITS))
    name = F.substring(F.lpad(F.conv(F.col("__hash").cast("string"), 10, 2), BITS, "0"), F.lit(1), full)
    found = found.withColumn("shard", name)
    # buckets that no bit can split: pages by a running sum, in the order of the text
    last_bits, last = directories[-1]
    if last_bits == BITS and not last.filter("depth IS NULL").isEmpty():
        stuck = found.filter("depth IS NULL").withColumn("__order", F.xxhash64(*[F.col(f"`{c}`") for c in kept]))
        stuck = running_sum(stuck, ["__hash"], ["__order"], "bytes", "__upto")
        page = F.floor((F.col("__upto") - F.col("bytes")) / F.lit(max(limit, 1))).cast("long") * 2
        # a document that crosses a page border opens a page of its own
        crosses = F.floor((F.col("__upto") - 1) / F.lit(max(limit, 1))) * 2 > page
        page = F.when(crosses, page + 1).otherwise(page)
        stuck = stuck.withColumn("page", page).drop("__upto", "__order")
        found = found.filter("depth IS NOT NULL").withColumn("page", F.lit(0).cast("long")).unionByName(stuck)
    else:
        found = found.withColumn("page", F.lit(0).cast("long"))
    found = found.withColumn("depth", full.cast("int")).withColumn("oversized", F.col("bytes") > limit)
    return found.select(*[F.col(f"`{c}`") for c in kept], *RESULTS)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder per shard and page; rows of a shard meet in one task, at most ``limit`` bytes of text."""
    sharded.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
