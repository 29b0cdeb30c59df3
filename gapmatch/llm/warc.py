"""WARC fixity audit with Merkle trees.

Pages become WARC records in the order of their ids; the manifest keeps offset, length and SHA-256 of each. Records
whose offsets fall into one range of bytes make a leaf, sixteen nodes make their parent. The replica's records are
dealt to the same leaves by the first key of each, on their own, and its tree is built from its own digests. The two
trees are compared from the root down: only children of nodes that differ are looked at, and only records of leaves
that differ are joined.

Records are sorted in ranges of bounded size, also those of one id; sums and numbers run inside a range, and what the
ranges before it hold is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

RANGE = 1 << 20  #: bytes of archive in a leaf
FAN = 16
ROWS = 1 << 16  #: records sorted together, about
KEY = ["page_id", "nth"]


def records(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as (page_id, record): a WARC resource record; null url or html is empty."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.filter("page_id is not null").select(F.col("page_id").cast("long"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def _ranged(rows: DataFrame, *by) -> DataFrame:
    """rows sorted into ranges of about ``ROWS`` rows, stored with the number of the range as ``part``."""
    rows = written(rows, "rows")
    ranges = max(1, -(-rows.count() // ROWS))
    return written(rows.repartitionByRange(ranges, *by).withColumn("part", F.spark_partition_id()), "ranges")


def _ahead(totals: DataFrame, value: str, fold=F.sum) -> DataFrame:
    """(part, ahead): ``value`` folded over all ranges before; one row per range."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", fold(value).over(before).alias("ahead"))


def digests(recs: DataFrame) -> DataFrame:
    """(page_id, nth, length, digest, part, before): nth tells records of one id apart, in the order of their digests;
    ``before`` is the sum of all lengths before a record."""
    plain = recs.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    # Equal records of one id may be many: a random tie-breaker lets a range end between them.
    sorted_ = _ranged(plain.withColumn("tie", F.rand(8)), "page_id", "digest", "tie")
    order = ["page_id", "digest", "tie"]
    inside = W.partitionBy("part").orderBy(*order)
    numbered = sorted_.withColumn("own", F.sum("length").over(inside) - F.col("length")).withColumn(
        "place", F.row_number().over(W.partitionBy("part", "page_id").orderBy("digest", "tie")))
    ahead = _ahead(sorted_.groupBy("part").agg(F.sum("length").alias("bytes")), "bytes")
    # Only the first id of a range can have records in ranges before it.
    ends = sorted_.groupBy("part").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    edge = sorted_.join(ends, "part").filter((F.col("page_id") == F.col("first")) | (F.col("page_id") == F.col("last")))
    held = edge.groupBy("page_id", "part").agg(F.count(F.lit(1)).alias("n"))  # two rows per range
    earlier = held.withColumn("earlier", F.sum("n").over(W.partitionBy("page_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    return numbered.join(ahead, "part").join(earlier, ["part", "page_id"], "left").select(
        "page_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).cast("int").alias("nth"), "length", "digest",
        (F.col("own") + F.coalesce("ahead", F.lit(0))).alias("before"))


def manifest(found: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(page_id, nth, length, digest, offset, leaf)."""
    return found.select(
        *KEY, "length", "digest", F.col("before").alias("offset"), F.floor(F.col("before") / range_bytes).cast("long").alias("leaf"))


def dealt(found: DataFrame, ours: DataFrame) -> DataFrame:
    """The replica's records with the leaf of ours whose keys they are among: the last one that begins at or before them."""
    begins = ours.groupBy("leaf").agg(F.min(F.struct(*KEY)).alias("k")).select("k.page_id", "k.nth", F.lit(0).alias("kind"), "leaf")
    none = [F.lit(None).cast("long").alias(c) for c in ("length",)] + [F.lit(None).cast("string").alias("digest")]
    rows = begins.select("page_id", "nth", "kind", "leaf", *none).unionByName(
        found.select("page_id", "nth", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("leaf"), "length", "digest"))
    sorted_ = _ranged(rows, "page_id", "nth", "kind")
    inside = W.partitionBy("part").orderBy("page_id", "nth", "kind")
    ahead = _ahead(sorted_.groupBy("part").agg(F.max("leaf").alias("most")), "most", F.max)
    leaf = F.coalesce(F.last("leaf", ignorenulls=True).over(inside), F.col("ahead"), F.lit(0))
    return sorted_.join(ahead, "part").withColumn("leaf", leaf.cast("long")).filter("kind = 1").select(*KEY, "length", "digest", "leaf")


def leaf_digests(listed: DataFrame, most: int = RANGE // 64) -> DataFrame:
    """(node, digest) of the records (page_id, nth, digest, leaf) of each leaf. A leaf of more records than its bytes
    can hold is not listed: it differs from any true one."""
    sizes = listed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    items = F.sort_array(F.collect_list(F.struct(*KEY, "digest")))
    line = F.transform(items, lambda x: F.concat_ws(":", x["page_id"].cast("string"), x["nth"].cast("string"), x["digest"]))
    whole = listed.join(sizes, "leaf", "left_anti").groupBy(F.col("leaf").alias("node")).agg(F.sha2(F.concat_ws(",", line).cast("binary"), 256).alias("digest"))
    return whole.unionByName(sizes.select(F.col("leaf").alias("node"), F.concat(F.lit("crowded "), F.col("n").cast("string")).alias("digest")))


def tree(leaves: DataFrame, levels: int | None = None, fan: int = FAN) -> list[DataFrame]:
    """Levels of the tree over leaves (node, digest), leaves first; the last level is the root, or the ``levels``-th."""
    made = [written(leaves, "tree")]
    while len(made) < levels if levels else made[-1].filter("node > 0").limit(1).count():
        up = made[-1].groupBy(F.floor(F.col("node") / fan).cast("long").alias("node"))
        listed = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), x["digest"]))
        made.append(written(up.agg(F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("digest")), "tree"))
    return made


def mismatches(ours: list[DataFrame], theirs: list[DataFrame], fan: int = FAN) -> DataFrame:
    """Leaves that differ, found from the roots down; a node that one side lacks differs."""
    odd = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if odd is not None:
            below: Column = F.floor(F.col("node") / fan) == F.col("above")
            a, b = a.join(odd, below, "left_semi"), b.join(odd, below, "left_semi")
        both = a.withColumnRenamed("digest", "a").join(b, "node", "full")
        odd = written(both.filter(~F.col("a").eqNullSafe(F.col("digest"))).select(F.col("node").alias("above")), "mismatches")
    return odd.select(F.col("above").alias("leaf"))


def audit(pages: DataFrame, replica: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Two tables of pages (page_id, url, html). Returns (page_id, nth, offset, length, leaf, digest, status), a row per
    record of ``pages`` and per record that only the replica has (status ``extra``, no offset or leaf).

    Status is ``ok``, ``corrupt`` (another digest) or ``missing``. Rows without an id take no part. Rows repeated
    under one id are records told apart by ``nth``. A table that is empty on either side is an audit without matches.
    """
    ours = written(manifest(digests(records(pages)), range_bytes), "manifest")
    theirs = written(dealt(digests(records(replica)), ours), "replica")
    first = tree(leaf_digests(ours))
    odd = mismatches(first, tree(leaf_digests(theirs), len(first)))
    looked = theirs.join(odd, "leaf", "left_semi").select(*KEY, F.col("length").alias("their_length"), F.col("digest").alias("theirs"))
    suspects = ours.join(odd, "leaf", "left_semi").join(looked, KEY, "full")
    status = (
        F.when(F.col("digest").isNull(), "extra").when(F.col("theirs").isNull(), "missing")
        .when(F.col("theirs") == F.col("digest"), "ok").otherwise("corrupt"))
    columns = [*KEY, "offset", F.coalesce("length", "their_length").alias("length"), "leaf", F.coalesce("digest", "theirs").alias("digest")]
    sound = ours.join(odd, "leaf", "left_anti").select(*KEY, "offset", "length", "leaf", "digest", F.lit("ok").alias("status"))
    return sound.unionByName(suspects.select(*columns, status.alias("status")))
