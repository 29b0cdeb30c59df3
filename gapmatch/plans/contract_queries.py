"""Payloads of every contract and request in one table, checked in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..sources import contracts as C
from .tables import spread, table


def _payloads(spark, sf_dir):
    """(contract, key, payload): rows of the tables as JSON of all kinds; some break rules, some are cut short."""
    def read(name):
        return spread(table(spark, sf_dir, name))

    def one(kind, rows, key, **fields):
        payload = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
        return rows.select(F.lit(kind).alias("contract"), F.col(key).cast("long").alias("key"), payload.alias("payload"))

    c, p, o, d = F.col("c_custkey"), F.col("p_partkey"), F.col("o_orderkey"), F.col("doc_id")
    category = F.when(c % 3 == 0, "must_have").when(c % 3 == 1, "nice_to_have")
    needed = F.struct(F.col("c_name").alias("text"), category.alias("category"), F.when(c % 7 == 0, "rare").otherwise("evidenceable").alias("kind"))
    asked = F.struct(F.lit("technical").alias("category"), F.col("s_name").alias("text"), F.lit(3).alias("difficulty"))
    mark = F.struct(F.lit("Depth").alias("name"), (p % 7).cast("int").alias("score"))
    todo = F.struct(F.when(o % 4 == 0, "urgent").otherwise("high").alias("priority"), F.when(o % 5 > 0, F.col("o_orderpriority")).alias("title"))
    rows = [
        one("requirement", read("benchmark"), "item_id", text=F.col("text"), category=F.when(F.col("item_id") % 4 == 1, "optional").otherwise("must_have")),
        one("requirements", read("customer"), "c_custkey", requirements=F.array_repeat(needed, (c % 25).cast("int"))),
        one("match_item", read("part"), "p_partkey", requirement=F.when(p % 9 > 0, F.col("p_name")), status=F.when(p % 4 == 0, "unsure").otherwise("strong"),
            confidence=F.col("p_size") / 40),
        one("match_report", read("orders"), "o_orderkey", overall_score=F.floor(F.col("o_totalprice") / 4000), verdict=F.col("o_orderstatus"),
            summary=F.when(o % 6 > 0, F.col("o_orderpriority"))),
        one("question", read("part"), "p_partkey", category=F.when(p % 5 == 0, "other").otherwise("behavioural"), text=F.concat_ws(" ", "p_name", "p_type"),
            difficulty=F.when(p % 2 == 0, (p % 8).cast("int"))),
        one("questions", read("supplier"), "s_suppkey", questions=F.array_repeat(asked, (F.col("s_suppkey") % 23).cast("int"))),
        one("evaluation", read("part"), "p_partkey", rubric=F.when(p % 3 == 0, "essay").otherwise("star"), criteria=F.array_repeat(mark, (p % 5).cast("int") + 1),
            overall_score=F.col("p_size") / 8),
        one("scorecard", read("orders"), "o_orderkey", readiness_score=F.floor(F.col("o_totalprice") / 4500), readiness_band=F.col("o_orderstatus"),
            summary=F.col("o_orderpriority"), action_items=F.when(o % 2 == 0, F.array(todo))),
        one("rewrite", read("customer"), "c_custkey", bullet=F.repeat(F.col("c_mktsegment"), (c % 60).cast("int")), placeholders=F.array("c_name")),
        one("letter", read("documents"), "doc_id", subject=F.col("source"), body=F.col("text")),
        one("request:answer", read("conversations"), "conv_id", text=F.col("text"), duration_seconds=F.length("text") * 9),
        one("request:session", read("customer"), "c_custkey", title=F.repeat(F.col("c_name"), (c % 12).cast("int"))),
        one("request:document", read("documents"), "doc_id", text=F.repeat(F.col("text"), F.when(d % 50 == 0, 30).otherwise(1))),
        one("diary", read("supplier"), "s_suppkey", text=F.col("s_name")),
    ]
    every = reduce(lambda a, b: a.union(b), rows)
    return every.withColumn("payload", F.when(F.col("key") % 41 == 0, F.expr("left(payload, char_length(payload) - 1)")).otherwise(F.col("payload")))


def contract_dispatch(spark, sf_dir):
    """Payloads that break rules, by contract and broken rules."""
    checked = C.quarantined(C.check_payloads(_payloads(spark, sf_dir)))
    return checked.groupBy("contract", F.array_join("violations", ",").alias("violations")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("key").alias("key_sum"))


QUERIES = {"contract_dispatch": contract_dispatch}
