"""Cost, latency and cache analytics over the call log.

Calls: call_id, session_id, stage, model, prompt_version, prompt_tokens, completion_tokens,
latency_ms, cache_hit, status, created_at. Money is decimal, so sums do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T
from ..storage import written
from .ranks import with_below

MONEY = "decimal(18,9)"


def rate_table(spark: SparkSession) -> DataFrame:
    """(model, usd_in, usd_out) per million tokens."""
    rows = [(m, i, o) for m, (i, o) in K.USD_PER_MILLION.items()]
    return spark.createDataFrame(rows, "model string, i string, o string").select(
        "model", F.col("i").cast("decimal(9,2)").alias("usd_in"), F.col("o").cast("decimal(9,2)").alias("usd_out")
    )


def price(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``cost_usd``; a model without a rate costs nothing."""
    dear = F.col("prompt_tokens") * F.col("usd_in") + F.col("completion_tokens") * F.col("usd_out")
    return (
        calls.join(rates, "model", "left")
        .withColumn("cost_usd", F.coalesce(dear / 1_000_000, F.lit(0)).cast(MONEY))
        .drop("usd_in", "usd_out")
    )


def log_calls(prompts: DataFrame, rates: DataFrame) -> DataFrame:
    """Telemetry rows of finished calls (prompt, completion, error): one per call, ok or not."""
    return price(
        prompts.withColumn("prompt_tokens", T.token_estimate(F.col("prompt")))
        .withColumn("completion_tokens", F.when(F.col("error").isNull(), T.token_estimate(F.col("completion"))).otherwise(0))
        .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
        .drop("prompt", "completion"),
        rates,
    )


def total_spend(calls: DataFrame) -> DataFrame:
    return calls.agg(F.coalesce(F.sum("cost_usd"), F.lit(0).cast(MONEY)).alias("spent_usd"))


def spend_gate(calls: DataFrame, ceiling: float = K.SPEND_CEILING_USD, exempt: bool = False) -> DataFrame:
    """(spent_usd, refused): further calls are refused at or above the ceiling; 0 switches it off."""
    on = ceiling > 0 and not exempt
    return total_spend(calls).withColumn(
        "refused", (F.col("spent_usd") >= F.lit(str(ceiling)).cast(MONEY)) & F.lit(on)
    )


def spend_hours(calls: DataFrame) -> DataFrame:
    """(installation, hour, spent_usd): spend per installation and hour; works on streams too."""
    return (
        calls.groupBy("installation", F.window("created_at", "1 hour").alias("w"))
        .agg(F.sum("cost_usd").alias("spent_usd"))
        .select("installation", F.col("w.start").alias("hour"), "spent_usd")
    )


def first_breaches(hours: DataFrame, calls: DataFrame, ceiling: float = K.SPEND_CEILING_USD) -> DataFrame:
    """(installation, call_id, created_at, spent_usd): the first call, by time and id, at which the running
    total of an installation reaches the ceiling; a ceiling of 0 is never reached.

    ``hours`` are the ``spend_hours`` of ``calls``. Totals run over hours, and calls are ordered only inside the
    one hour of an installation in which the ceiling falls.
    """
    limit = F.lit(str(ceiling)).cast(MONEY)
    upto = F.sum("spent_usd").over(Window.partitionBy("installation").orderBy("hour"))
    crossing = (
        hours.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("spent_usd"))
        .filter((F.col("upto") >= limit) & (F.col("before") < limit) & F.lit(ceiling > 0))
        .select("installation", "hour", "before")
    )
    running = F.sum("cost_usd").over(
        Window.partitionBy("installation").orderBy("created_at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = (
        calls.select("installation", "call_id", "created_at", "cost_usd", F.window("created_at", "1 hour")["start"].alias("hour"))
        .join(crossing, ["installation", "hour"])
        .withColumn("spent_usd", F.col("before") + running)
        .filter(F.col("spent_usd") >= limit)
    )
    first = F.min(F.struct("created_at", "call_id", "spent_usd")).alias("f")
    return inside.groupBy("installation").agg(first).select("installation", "f.call_id", "f.created_at", "f.spent_usd")


def by_session(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def exact_percentile(rows: DataFrame, key: str, value: str, p: float, slack: float = 0.002) -> DataFrame:
    """(key, n, value at p), exact and interpolated, without holding a group's values anywhere.

    A sketch brackets the wanted rank; rows below the bracket are only counted, and just the sliver
    inside it is ranked, as counts of distinct values cut into bounded ranges.
    """
    slim = written(rows.select(key, value).filter(F.col(value).isNotNull()), "values")  # read twice below
    bracket = slim.groupBy(key).agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, [max(0.0, p - slack), min(1.0, p + slack)], 10_000).alias("b"),
    )
    bracket = written(bracket.select(key, "n", F.col("b")[0].alias("low"), F.col("b")[1].alias("high")), "bracket")
    v, low, high = F.col(value), F.col("low"), F.col("high")
    # One pass: the sliver by value, and a row for all the rest. The rest has the two neighbours of the bracket: the wanted
    # rank of a small group may lie one step outside.
    split = slim.join(bracket, key).groupBy(key, F.when(v.between(low, high), v).alias("v")).agg(
        F.count("*").alias("times"), F.count_if(v < low).alias("below"), F.max(F.when(v < low, v)).alias("before"),
        F.min(F.when(v > high, v)).alias("after"),
    )
    split = written(split, "sliver")
    sliver = with_below(split.filter("v is not null").select(key, "v", "times"), key, "v", "times")
    ranked = sliver.select(key, F.col("v").alias(value), (F.col("below") + F.col("times")).alias("upto"))
    edges = split.filter("v is null").select(key, "below", "before", "after")
    at = p * (F.col("n") - 1)
    known = bracket.select(key, "n").join(edges, key, "left").withColumn("below", F.coalesce("below", F.lit(0)))
    placed = ranked.join(known, key).withColumn("last", F.col("below") + F.col("upto"))
    # Row numbers are 0-based: a value covers ranks up to last - 1.
    def at_rank(rank, name):
        inside = F.min(F.when(F.col("last") > rank, v))
        return F.when(rank < F.col("below"), F.col("before")).otherwise(F.coalesce(inside, F.col("after"))).alias(name)

    picked = placed.groupBy(key, "n", "below", "before", "after").agg(at_rank(F.floor(at), "lo"), at_rank(F.ceil(at), "hi"))
    return picked.select(key, "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias(value))


def latency_by_stage(calls: DataFrame) -> DataFrame:
    return exact_percentile(calls, "stage", "latency_ms", 0.95).select(
        "stage", F.col("n").alias("calls"), F.round("latency_ms", 6).alias("p95_ms")
    )


def stage_rollup(calls: DataFrame) -> DataFrame:
    """Cost and cache rate by session and stage with subtotals; nulls mark a subtotal row."""
    return calls.rollup("session_id", "stage").agg(
        F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"),
        F.round(F.avg(F.col("cache_hit").cast("double")), 6).alias("cache_rate"),
        F.grouping_id().cast("int").alias("level"),
    )


def errors_by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model", "prompt_version").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.avg((F.col("status") == "error").cast("double")), 6).alias("error_rate"),
        F.round(F.avg(F.col("cache_hit").cast("double")), 6).alias("cache_rate"),
    )


def unpriced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Models in use that the rate table does not know."""
    used = calls.groupBy("model").agg(F.count("*").alias("calls"))
    return used.join(rates, "model", "left_anti")


def request_windows(requests: DataFrame, window: str, ceiling: int) -> DataFrame:
    """(caller, window_start, requests, over): fixed-window counts per caller; works on streams too."""
    return (
        requests.groupBy(F.window("ts", window).alias("w"), "caller")
        .agg(F.count("*").alias("requests"))
        .select("caller", F.col("w.start").alias("window_start"), "requests", (F.col("requests") > ceiling).alias("over"))
    )


def caller_key(user: Column, address: Column) -> Column:
    """Who is counted: the signed-in user, else the address."""
    return F.coalesce(user.cast("string"), address)


def tier_windows(requests: DataFrame, tiers: dict[str, tuple[int, int]] = K.RATE_TIERS) -> DataFrame:
    """(caller, tier, window_start, requests, over): requests (caller, tier, ts) in the fixed window of their tier.

    Works on streams too: the longest window carries the watermark and the state, shorter ones divide it. Requests
    of an unknown tier have no ceiling and are counted in the longest window.
    """
    longest = max(seconds for seconds, _ in tiers.values())
    if any(longest % seconds for seconds, _ in tiers.values()):
        raise ValueError("the longest window must be a multiple of every other")
    tier = F.col("tier")
    length, ceiling = F.lit(longest), F.lit(None).cast("int")
    for name, (seconds, most) in tiers.items():
        length = F.when(tier == name, seconds).otherwise(length)
        ceiling = F.when(tier == name, most).otherwise(ceiling)
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return (
        requests.withColumn("part", F.floor((at % longest) / length))
        .groupBy(F.window("ts", f"{longest} seconds").alias("w"), "caller", "tier", "part")
        .agg(F.count("*").alias("requests"))
        .select(
            "caller", "tier", (F.col("w.start") + F.make_dt_interval(secs=F.col("part") * length)).alias("window_start"),
            "requests", F.coalesce(F.col("requests") > ceiling, F.lit(False)).alias("over"),
        )
    )
