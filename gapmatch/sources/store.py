"""Keyed tables that are merged and erased: every operation takes and returns DataFrames, the caller stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scorecards import latest_per_key


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing rows of equal key; columns missing on either side are null."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def current_documents(documents: DataFrame) -> DataFrame:
    """A session holds one document per kind: the one supplied last."""
    return latest_per_key(documents, ["session_id", "kind"], ["created_at", "doc_key"])


def purge(chunks: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks without those of erased documents or sessions. Only the erased document goes, never the
    other documents of its session."""
    return chunks.join(tombstones.select(*keys).distinct(), keys, "left_anti")


# table -> (its key, parent table, column that points at the parent)
CHILDREN = {
    "documents": ("doc_key", "sessions", "session_id"),
    "children": ("chunk_id", "documents", "doc_key"),
    "match_report": ("report_id", "sessions", "session_id"),
    "match_item": ("item_id", "match_report", "report_id"),
    "cv_suggestion": ("suggestion_id", "match_item", "item_id"),
    "question": ("question_id", "sessions", "session_id"),
    "answer": ("answer_id", "question", "question_id"),
    "evaluation": ("evaluation_id", "answer", "answer_id"),
    "scorecard": ("card_id", "sessions", "session_id"),
    "cover_letter": ("letter_id", "sessions", "session_id"),
}


def erase_sessions(tables: dict[str, DataFrame], tombstones: DataFrame) -> dict[str, DataFrame]:
    """Every table without the erased sessions. Call telemetry stays, with its session forgotten.

    A table that carries ``session_id`` beside its own keys, as children should from the day they are written, is
    one scan and one anti-join with the erased sessions. Others follow their keys up to the nearest table that
    carries it: the erased keys of those parents are found by semi-joins, and only for tables that need them.
    """
    erased = tombstones.select("session_id").distinct()
    owned = {name for name, df in tables.items() if "session_id" in df.columns}

    def gone(name: str) -> DataFrame:
        """Erased keys of a table under its own key column."""
        if name == "sessions":
            return erased
        key, parent, column = CHILDREN[name]
        if name in owned:
            return tables[name].join(erased, "session_id", "left_semi").select(key).distinct()
        return tables[name].join(gone(parent), column, "left_semi").select(key).distinct()

    left = {"sessions": tables["sessions"].join(erased, "session_id", "left_anti")}
    for name, (_, parent, column) in CHILDREN.items():
        if name in owned:
            left[name] = tables[name].join(erased, "session_id", "left_anti")
        elif name in tables:
            left[name] = tables[name].join(gone(parent), column, "left_anti")
    if "llm_call" in tables:
        mark = erased.withColumn("_gone", F.lit(True))
        left["llm_call"] = (
            tables["llm_call"].join(mark, "session_id", "left")
            .withColumn("session_id", F.when(F.col("_gone").isNull(), F.col("session_id")))
            .drop("_gone")
        )
    return left


def missing_columns(stored: DataFrame, declared) -> list[str]:
    """Declared columns the stored table lacks. Nullable ones can be added on read; a required one
    cannot be invented and is refused."""
    lacking = [f for f in declared.fields if f.name not in stored.columns]
    required = [f.name for f in lacking if not f.nullable]
    if required:
        raise ValueError(f"stored table lacks required columns: {', '.join(required)}")
    return [f.name for f in lacking]


def conform(stored: DataFrame, declared) -> DataFrame:
    """The stored rows under the declared schema, with missing nullable columns as nulls."""
    lacking = set(missing_columns(stored, declared))
    return stored.select(*[
        (F.lit(None).cast(f.dataType) if f.name in lacking else F.col(f.name).cast(f.dataType)).alias(f.name)
        for f in declared.fields
    ])


def append_metrics(long: DataFrame, path: str) -> None:
    """Append metric rows (config, suite, metric, value) of one run as JSON."""
    long.withColumn("run_ts", F.current_timestamp()).write.mode("append").json(path)


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, probes) of a label file. A pair without probes keeps its labels and has no probe rows."""
    raw = spark.read.schema(
        "pairs array<struct<id:string,cv:string,jd:string,requirements:array<struct<match:string,expected_status:string>>,"
        "retrieval:array<struct<query:string,relevant_contains:array<string>>>>>"
    ).json(path, multiLine=True)
    pairs = raw.select(F.explode("pairs").alias("p"))
    labels = pairs.select(F.col("p.id").alias("scope"), F.posexplode("p.requirements").alias("label_pos", "r")).select(
        "scope", "label_pos", F.col("r.match").alias("phrase"), F.col("r.expected_status").alias("expected")
    )
    probes = pairs.select(F.col("p.id").alias("scope"), F.posexplode("p.retrieval").alias("n", "r")).select(
        "scope", F.col("n").cast("string").alias("query_id"), F.col("r.query").alias("text"),
        F.col("r.relevant_contains").alias("wanted"),
    )
    return labels, probes


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(answers, ordered pairs) of a hand-scored answer file."""
    raw = spark.read.schema(
        "answers array<struct<id:string,rubric:string,question:string,requirement:string,expected_score:int,text:string>>,"
        "pairs array<array<string>>"
    ).json(path, multiLine=True)
    answers = raw.select(F.explode("answers").alias("a")).select(
        F.col("a.id").alias("answer_id"), "a.rubric", "a.question", F.coalesce("a.requirement", F.lit("")).alias("requirement"),
        F.col("a.expected_score").cast("double").alias("expected"), F.col("a.text").alias("answer"),
    )
    pairs = raw.select(F.explode("pairs").alias("p")).select(F.col("p")[0].alias("better"), F.col("p")[1].alias("worse"))
    return answers, pairs
