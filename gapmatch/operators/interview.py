"""Question planning and answer scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import matching as M
from ..functions import text as T


# --- questions ---------------------------------------------------------------------------
def _first(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    place = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)


def plan_questions(
    items: DataFrame, key: str = "session_id", n_technical: int = K.N_TECHNICAL,
    n_behavioural: int = K.N_BEHAVIOURAL,
) -> DataFrame:
    """(key, category, place, linked_requirement, difficulty) in asking order within a category.

    Technical questions go to what is missing or thin first; stated traits come before the bank.
    """
    prio = F.when(F.col("status") == "missing", 0.0).when(F.col("status") == "partial", 1.0).when(
        F.col("status") == "strong", 2.0).otherwise(3.0)
    prio = prio + F.when(F.col("category") == "must_have", 0.0).otherwise(1.5)
    technical = _first(
        items.filter("kind = 'evidenceable'").withColumn("prio", prio), key, ["prio", "order_key"], n_technical
    ).select(
        key, F.lit("technical").alias("category"), "place", F.col("requirement").alias("linked_requirement"),
        F.when(F.col("status") == "missing", 4).otherwise(3).alias("difficulty"),
    )
    stated = _first(items.filter("kind = 'behavioural'"), key, ["order_key"], n_behavioural).select(
        key, F.lit("behavioural").alias("category"), "place", F.col("requirement").alias("linked_requirement"),
        F.lit(3).alias("difficulty"),
    )
    return technical.unionByName(stated).unionByName(top_up(items, key, n_behavioural))


def top_up(items: DataFrame, key: str = "session_id", n_behavioural: int = K.N_BEHAVIOURAL) -> DataFrame:
    """Bank questions for sessions that state fewer traits than asked for, starting at an offset that
    depends on the number of items."""
    bank = F.array(*[F.lit(b) for b in K.QUESTION_BANK])
    size = len(K.QUESTION_BANK)
    counted = items.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "behavioural").alias("traits")
    )
    need = counted.withColumn("have", F.least("traits", F.lit(n_behavioural))).filter(F.col("have") < n_behavioural)
    return need.select(
        key, "n", "have", F.explode(F.sequence(F.lit(0), (F.lit(n_behavioural - 1) - F.col("have")).cast("int"))).alias("i")
    ).select(
        key, F.lit("behavioural").alias("category"), (F.col("have") + F.col("i") + 1).cast("int").alias("place"),
        F.element_at(bank, ((F.col("n") + F.col("i")) % size + 1).cast("int")).alias("linked_requirement"),
        F.lit(3).alias("difficulty"),
    )


def link_questions(questions: DataFrame, items: DataFrame, key: str = "session_id") -> DataFrame:
    """Add ``linked_item``: the last item of the session with the question's requirement text."""
    last = items.groupBy(key, F.col("requirement").alias("linked_requirement")).agg(
        F.max("order_key").alias("linked_item")
    )
    return questions.join(last, [key, "linked_requirement"], "left")


# --- answers -----------------------------------------------------------------------------
def scale(value: Column, lo: float, hi: float) -> Column:
    """A linear 1-5 score, rounded half to even and clamped."""
    return (
        F.when(value <= lo, 1).when(value >= hi, 5)
        .otherwise(F.bround(1 + 4 * (value - lo) / (hi - lo), 0).cast("int"))
    )


def _sum(cols) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + c
    return total


def answer_features(answers: DataFrame, answer: str = "answer", requirement: str = "requirement") -> DataFrame:
    """Counts an answer is scored on; ``requirement`` may be empty."""
    text, req = F.col(answer), F.col(requirement)
    low = F.lower(text)
    toks = answers.withColumn("_toks", T.tokens(text)).withColumn("_needles", M.needles(T.keywords(req)))
    return toks.select(
        *answers.columns,
        F.size("_toks").alias("words"),
        F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]"))).alias("sents"),
        T.quantity_mentions(text).alias("numbers"),
        T.occurrences(low, " i ").alias("i_count"),
        T.occurrences(low, " we ").alias("we_count"),
        F.when(req == "", F.lit(0.5)).otherwise(M.coverage(F.col("_needles"), M.text_keys(F.col("_toks")))).alias("cover"),
        *[T.phrases_present(low, phrases).alias(name) for name, phrases in K.STAR_MARKERS.items()],
        _sum(T.occurrences(low, p) for p in K.TRADE_OFF_PHRASES).alias("trade_offs"),
    )


def score_answers(features: DataFrame, rubric: str = "rubric") -> DataFrame:
    """Add ``criteria`` (array of name, score), ``overall_score``, strengths, improvements, follow-up."""
    f = F.col
    star = [
        scale(f("situation"), 0, 2), scale(f("task"), 0, 2), scale(f("action"), 0, 3),
        scale(f("result") + f("numbers"), 0, 3), scale(f("numbers"), 0, 3),
    ]
    technical = [
        scale(f("cover") * 5 + F.when(f("numbers") > 0, 1).otherwise(0), 0.5, 4.0),
        scale(f("words") * (f("cover") + 0.5), 40, 260),
        scale(f("trade_offs"), 0, 3),
        scale(6 - F.abs(f("sents") - 7) * 0.6, 1.0, 5.5),
        scale(f("cover"), 0.1, 0.7),
    ]

    def listed(names, scores):
        return F.array(*[
            F.struct(F.lit(i).alias("nth"), F.lit(n).alias("name"), s.alias("score"))
            for i, (n, s) in enumerate(zip(names, scores))
        ])

    raw = F.when(f(rubric) == "star", listed(K.STAR_CRITERIA, star)).otherwise(
        listed(K.TECHNICAL_CRITERIA, technical)
    )
    blended = F.transform(
        "_raw",
        lambda c: F.struct(
            F.greatest(F.lit(1), F.least(F.lit(5), F.bround((c["score"] * 3 + f("_len")) / 4, 0).cast("int"))).alias("score"),
            c["nth"].alias("nth"), c["name"].alias("name"),
        ),
    )
    notes = F.create_map(*[F.lit(x) for pair in K.COMMENTS.items() for x in pair])
    follow = F.create_map(*[F.lit(x) for pair in K.FOLLOW_UPS.items() for x in pair])

    def label(c):
        return F.format_string("%s (%d/5) — %s", c["name"], c["score"], F.element_at(notes, c["name"]))

    # Ascending by score, then by rubric order; the reverse of that order lists the strengths.
    ranked = F.array_sort("criteria")
    best = F.slice(F.filter(F.reverse("_ranked"), lambda c: c["score"] >= 4), 1, 3)
    worst = F.slice(F.filter("_ranked", lambda c: c["score"] <= 3), 1, 3)
    return (
        features.withColumn("_len", scale(f("words"), 25, 170))
        .withColumn("_raw", raw)
        .withColumn("criteria", blended)
        .withColumn("overall_score", F.bround(F.aggregate("criteria", F.lit(0), lambda a, c: a + c["score"]) / 5, 1))
        .withColumn("_ranked", ranked)
        .withColumn("_best", best)
        .withColumn("_worst", worst)
        .withColumn(
            "strengths",
            F.when(F.size("_best") > 0, F.transform("_best", label))
            .otherwise(F.array(label(F.element_at("_ranked", -1)))),
        )
        .withColumn(
            "improvements",
            F.when(F.size("_worst") > 0, F.transform("_worst", label)).otherwise(F.array(F.lit(K.IMPROVEMENT_DEFAULT))),
        )
        .withColumn("weakest", F.element_at("_ranked", 1)["name"])
        .withColumn("follow_up", F.coalesce(F.try_element_at(follow, f("weakest")), F.lit(K.FOLLOW_UP_DEFAULT)))
        .withColumn(
            "criterion_scores",
            F.map_from_entries(F.transform("criteria", lambda c: F.struct(c["name"], c["score"].cast("double")))),
        )
        .drop("_len", "_raw", "_ranked", "_best", "_worst")
    )


def rubric_of(category: Column) -> Column:
    return F.when(category == "behavioural", "star").otherwise("technical")
