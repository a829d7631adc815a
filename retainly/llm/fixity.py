"""Fixity audit of WARC replicas by Merkle trees.

A record is hashed by itself; ranges of offsets are hashed over the records
that begin in them, in order, with their offsets and lengths; ranges of 16
ranges over those, and so on up to the file's root. Ranges are cut by offset,
not by count, so a record that one replica lacks changes the hashes above it
and no others. Replicas are compared root by root; of the files whose roots
differ the ranges one level down are looked at, and so on, so that below the
roots only mismatching branches are read, down to the damaged records.

Payloads are hashed where they are read and never shuffled. A node has at most
as many children as records begin in FIRST bytes, or 16, however large a file
is; files are laid out by place, so a host with a third of all pages spreads
over many.

Null urls and contents count as empty; records without an id are records like
any other. Repeated records have places of their own. Empty replicas have no
roots: what one has and the other lacks is reported as missing or extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

FIRST = 16  # binary digits of the offsets within a lowest range
FAN = 4  # binary digits of a range's number within the next
LEVELS = 4
NO_FILE = -(2**63)  # stands for a null file
END = "\r\n\r\n"  # fixed value: what separates header, content and the next record


def header(record_id: Column, url: Column, size: Column) -> Column:
    """A WARC/1.0 resource record's header."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(record_id),
        F.lit(">\r\nWARC-Target-URI: "), text(url), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size.cast("string"), F.lit(END))


def records(pages: DataFrame, file: Column) -> DataFrame:
    """pages (page_id, url, html, ...) -> file, page_id, offset, length, digest: the records of the files that
    write() makes of them, in order of page_id. `file` groups pages into files of a bounded size."""
    content = F.coalesce(F.col("html").cast("string"), F.lit(""))
    whole = F.concat(header(F.col("page_id"), F.col("url"), F.octet_length(content)), content, F.lit(END))
    hashed = pages.select(file.cast("bigint").alias("file"), "page_id", F.octet_length(whole).cast("bigint").alias("length"), F.sha2(whole.cast("binary"), 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("file", "page_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def write(pages: DataFrame, file: Column, path: str) -> None:
    """Valid .warc files under folders file=N: the records in order, one file for each value of `file`."""
    prepare(pages.sparkSession)
    content = F.coalesce(F.col("html").cast("string"), F.lit(""))
    whole = F.concat(header(F.col("page_id"), F.col("url"), F.octet_length(content)), content)
    digest = F.sha2(F.concat(whole, F.lit(END)).cast("binary"), 256)
    (pages.select(file.cast("bigint").alias("file"), "page_id", whole.alias("value"), digest.alias("digest"))
     .repartition("file").sortWithinPartitions("file", "page_id", "digest").select("file", "value")
     .write.partitionBy("file").option("lineSep", END).text(path))


def tree(found: DataFrame) -> list[DataFrame]:
    """records -> tables (file, at, up, hash) from the records, level 0 (with page_id and length), to the roots."""
    levels = [found.select(F.coalesce("file", F.lit(NO_FILE)).alias("file"), F.col("offset").alias("at"), F.shiftright("offset", FIRST).alias("up"), F.concat_ws(":", "length", "digest").alias("hash"), "page_id", "length")]
    for k in range(LEVELS + 1):
        last = k == LEVELS
        key = F.lit(0).cast("bigint").alias("at") if last else F.col("up").alias("at")
        up = F.lit(0).cast("bigint") if k >= LEVELS - 1 else F.shiftright("at", FAN)
        rows = levels[-1].select("file", F.col("at").alias("child_at"), key, "hash")
        children = F.array_sort(F.collect_list(F.struct("child_at", "hash")))  # bounded by the range's width
        text = F.array_join(F.transform(children, lambda c: F.concat_ws("@", c["child_at"].cast("string"), c["hash"])), "\n")
        levels.append(rows.groupBy("file", "at").agg(F.sha2(text, 256).alias("hash")).select("file", "at", up.alias("up"), "hash"))
    return levels


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two replicas' records -> file, offset, page_id, length, status: `corrupt`, `missing` (from theirs) or `extra`
    (in theirs alone), by descending from differing roots. Rows of a replica at one offset of a file are one record."""
    spark = ours.sparkSession
    prepare(spark)
    trees = [[saved(level, f"merkle-{k}") for k, level in enumerate(tree(found))] for found in (ours, theirs)]
    bad = None
    for a, b in zip(*(reversed(t) for t in trees)):
        leaf = "page_id" in a.columns
        extra = ["page_id", "length"] if leaf else []
        sides = []
        for side, name in ((a, "a"), (b, "b")):
            if bad is not None:
                side = side.join(bad, (side["file"] == bad["bad_file"]) & (side["up"] == bad["bad_at"]), "left_semi")
            sides.append(side.select("file", "at", F.col("hash").alias(f"hash_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in extra)))
        differing = sides[0].join(sides[1], ["file", "at"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if leaf:
            status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("corrupt")
            return differing.select(F.nullif(F.col("file"), F.lit(NO_FILE)).alias("file"), F.col("at").alias("offset"), F.coalesce("page_id_a", "page_id_b").alias("page_id"), F.coalesce("length_a", "length_b").alias("length"), status.alias("status"))
        bad = differing.select(F.col("file").alias("bad_file"), F.col("at").alias("bad_at"))


def damaged(found: DataFrame, pages: DataFrame, file: Column) -> DataFrame:
    """A second replica for trials, laid out as the first: of every 97 pages one has its first character changed,
    of every 211 one is lost."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    changed = F.concat(F.when(F.substring(html, 1, 1) == "~", "^").otherwise("~"), F.substring(html, 2, 2**31 - 1))
    other = records(pages.withColumn("html", F.when(F.col("page_id") % 97 == 5, changed).otherwise(html)), file)
    places = found.select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("offset").alias("o"))
    return (other.drop("offset").join(places, (F.col("file") == F.col("f")) & (F.col("page_id") == F.col("p"))).where("page_id % 211 <> 7")
            .select("file", "page_id", F.col("o").alias("offset"), "length", "digest"))
