"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source starts with the same expected number of copies. Its whole part is certain; the
fractional parts are rounded by duels: two documents exchange words (probability times size) in a random one of
two directions, by as much as makes one of them whole. Both directions keep the words of the pair, and the coin
is such that no expected count changes, so a source keeps its words through all duels.

Duels run as a fold over bounded chunks of a source. Every chunk leaves one fractional document, which goes up to
the next level, until each source has one; that one goes to the nearer side. What it adds or takes is then mended
by a few documents of falling size, one per power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2  #: copies of a source at most
CHUNK = 128
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, k, size): words of each text, 0 for null; ``k`` is the source as a key that is never null."""
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("k"),
        word_count(F.col("text")).alias("size")).filter("doc_id is not null")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(k, source_size, target). Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of
    all words; none gets over ``most`` times its size, and the excess goes to the others by weight.

    The water level of the capped shares is found on the sources in the order of size by weight: level_i is what
    would be left per weight if all sources before i were capped; the first i it does not exceed sets the level.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1  # over sources, not documents
    by = sized.groupBy("k", "source").agg(F.sum("size").alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return by.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("k", "source_size", "target")


def _coin(*of: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *of), F.lit(1 << 52)) / float(1 << 52)


def _duel(acc: Column, x: Column) -> Column:
    """One duel of the carried document ``acc`` (key, z words, p, done) with ``x`` (key, z, p)."""
    a, p, b, q = acc["z"], acc["p"], x["z"], x["p"]
    fill, drain = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
    up = F.coalesce(_coin(acc["key"]["doc_id"], acc["key"]["size"], x["key"]["doc_id"], x["key"]["size"]) < F.try_divide(drain, fill + drain), F.lit(False))

    def carry(key, z, prob, out, took):
        prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob))
        return F.struct(key.alias("key"), z.alias("z"), prob.alias("p"),
                        F.concat(acc["done"], F.array(F.struct(out.alias("key"), F.lit(took).alias("took")))).alias("done"))

    won = (
        F.when(up & (a * (1 - p) <= b * q), carry(x["key"], b, q - a * (1 - p) / b, acc["key"], 1))
        .when(up, carry(acc["key"], a, p + b * q / a, x["key"], 0))
        .when(a * p <= b * (1 - q), carry(x["key"], b, q + a * p / b, acc["key"], 0))
        .otherwise(carry(acc["key"], a, p - b * (1 - q) / a, x["key"], 1))
    )
    first = F.struct(x["key"].alias("key"), x["z"].alias("z"), x["p"].alias("p"), acc["done"].alias("done"))
    return F.when(acc["key"].isNull(), first).otherwise(won)


def _level(items: DataFrame) -> DataFrame:
    """items (k, key, z, p) to a row per chunk: (k, key, z, p, done)."""
    chunks = items.groupBy("k").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    placed = items.join(chunks, "k").select("k", F.pmod(F.xxhash64(F.lit(3), "key"), "chunks").alias("chunk"), F.struct("z", "key", "p").alias("x"))
    # By chunk from here on: the join above leaves a source's rows together.
    placed = placed.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "chunk")
    rows = placed.groupBy("k", "chunk").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
    none = F.lit(None).cast("struct<key: struct<doc_id: bigint, size: bigint>, z: double, p: double, done: array<struct<key: struct<doc_id: bigint, size: bigint>, took: int>>>")
    start = F.struct(none["key"].alias("key"), F.lit(0.0).alias("z"), F.lit(0.0).alias("p"),
                     F.array().cast("array<struct<key: struct<doc_id: bigint, size: bigint>, took: int>>").alias("done"))
    return rows.select("k", F.aggregate("xs", start, _duel).alias("r")).select("k", "r.key", "r.z", "r.p", "r.done")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs (doc_id, text, source). Returns (doc_id, source, size, source_size, target, copies, taken), a row per row.

    ``copies`` is the floor or the ceiling of target / source_size, ``taken`` is size times copies. Null is a source
    of its own; texts without words take 0 copies. Rows repeated under one id, source and size are rounded as one,
    with as many words. Rows without an id take no part. Reruns over the same rows agree.
    """
    sized = written(sizes(docs), "sizes")
    goal = written(targets(sized, weights, share, most).coalesce(1), "targets")
    items = sized.filter("size > 0").groupBy("doc_id", "k", "size").agg((F.count("*") * F.col("size")).cast("double").alias("z")).join(goal, "k")
    rate = F.col("target") / F.col("source_size")
    items = written(items.select(
        "k", F.struct("doc_id", "size").alias("key"), "z", F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("p")), "items")
    open_ = items.filter("p > 0").select("k", "key", "z", "p")
    decided = []
    while True:
        level = written(_level(open_), "duels")
        decided.append(level.select("k", F.explode("done").alias("d")).select("k", "d.key", "d.took"))
        open_ = level.select("k", "key", "z", "p")
        if open_.groupBy("k").count().filter("count > 1").isEmpty():
            break
    rounds = open_.select("k", "key", (F.col("p") >= 0.5).cast("int").alias("took"))
    for d in decided:
        rounds = rounds.union(d)
    made = written(items.join(rounds, ["k", "key"], "left").withColumn("took", F.coalesce("took", F.lit(0))), "rounded")
    # Mending: of each source the largest document per power of two on either side, tried from large to small.
    gap = made.groupBy("k").agg(F.sum(F.col("z") * (F.col("whole") + F.col("took"))).alias("words")).join(goal, "k").select(
        "k", (F.col("words") - F.col("target")).alias("over"))
    coins = made.filter("p > 0").groupBy("k", F.floor(F.log2("z")).alias("scale"), "took").agg(F.max(F.struct("z", "key", "took")).alias("c"))
    coins = coins.groupBy("k").agg(F.sort_array(F.collect_list("c"), asc=False).alias("coins")).join(gap, "k")

    def mend(acc: Column, c: Column) -> Column:
        step = F.when(c["took"] == 1, c["z"]).otherwise(-c["z"])
        good = F.abs(acc["over"] - step) < F.abs(acc["over"])
        return F.when(good, F.struct((acc["over"] - step).alias("over"), F.concat(acc["keys"], F.array(c["key"])).alias("keys"))).otherwise(acc)

    start = F.struct(F.col("over").alias("over"), F.array().cast("array<struct<doc_id: bigint, size: bigint>>").alias("keys"))
    turned = coins.select("k", F.explode(F.aggregate("coins", start, mend)["keys"]).alias("key"), F.lit(1).alias("turn"))
    copies = F.col("whole") + F.when(F.col("turn") == 1, 1 - F.col("took")).otherwise(F.col("took"))
    final = made.join(turned, ["k", "key"], "left").select("k", "key.doc_id", "key.size", copies.alias("copies"))
    return sized.join(final, ["k", "doc_id", "size"], "left").join(goal, "k").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"),
        (F.col("size") * F.coalesce("copies", F.lit(0))).alias("taken"))
