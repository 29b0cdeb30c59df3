"""Shape checks for structured payloads and requests.

A contract is a schema plus named rules; a row lists the rules it breaks. Rows that break none are
accepted, the rest go to quarantine with their reasons - nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CATEGORY = ("must_have", "nice_to_have")
KIND = ("evidenceable", "behavioural")
STATUS = ("strong", "partial", "missing")
QUESTION = ("technical", "behavioural")
RUBRIC = ("star", "technical")
PRIORITY = ("high", "medium", "low")


def _one_of(value: Column, allowed: tuple, default: str | None = None) -> Column:
    return (F.coalesce(value, F.lit(default)) if default else value).isin(*allowed)


def _whole(value: Column) -> Column:
    """Fractional scores are rounded half to even before they are checked."""
    return F.bround(value, 0)


# name -> (schema, {rule: condition on the parsed payload that must hold})
CONTRACTS = {
    "requirement": (
        "text string, category string, kind string",
        {
            "text_length": lambda p: F.length(p["text"]).between(3, 300),
            "category": lambda p: _one_of(p["category"], CATEGORY, "must_have"),
            "kind": lambda p: _one_of(p["kind"], KIND, "evidenceable"),
        },
    ),
    "requirements": (
        "requirements array<struct<text:string,category:string,kind:string>>",
        {
            "list_size": lambda p: F.size(p["requirements"]) <= 20,
            "text_length": lambda p: F.forall(p["requirements"], lambda r: F.length(r["text"]).between(3, 300)),
            "category": lambda p: F.forall(p["requirements"], lambda r: _one_of(r["category"], CATEGORY, "must_have")),
            "kind": lambda p: F.forall(p["requirements"], lambda r: _one_of(r["kind"], KIND, "evidenceable")),
        },
    ),
    "match_item": (
        "requirement string, category string, kind string, status string, confidence double, evidence_quote string",
        {
            "requirement": lambda p: p["requirement"].isNotNull(),
            "status": lambda p: _one_of(p["status"], STATUS),
            "confidence": lambda p: p["confidence"].between(0, 1),
            "category": lambda p: _one_of(p["category"], CATEGORY, "must_have"),
            "kind": lambda p: _one_of(p["kind"], KIND, "evidenceable"),
        },
    ),
    "match_report": (
        "overall_score double, verdict string, summary string",
        {
            "overall_score": lambda p: _whole(p["overall_score"]).between(0, 100),
            "verdict": lambda p: p["verdict"].isNotNull(),
            "summary": lambda p: p["summary"].isNotNull(),
        },
    ),
    "question": (
        "category string, text string, difficulty int",
        {
            "category": lambda p: _one_of(p["category"], QUESTION),
            "text_length": lambda p: F.length(p["text"]) >= 10,
            "difficulty": lambda p: F.coalesce(p["difficulty"], F.lit(3)).between(1, 5),
        },
    ),
    "questions": (
        "questions array<struct<category:string,text:string,difficulty:int>>",
        {"list_size": lambda p: F.size(p["questions"]).between(1, 20)},
    ),
    "evaluation": (
        "rubric string, criteria array<struct<name:string,score:int>>, overall_score double",
        {
            "rubric": lambda p: _one_of(p["rubric"], RUBRIC),
            "criteria_size": lambda p: F.size(p["criteria"]) >= 3,
            "criterion_range": lambda p: F.forall(p["criteria"], lambda c: c["score"].between(1, 5)),
            "overall_score": lambda p: p["overall_score"].between(1, 5),
        },
    ),
    "scorecard": (
        "readiness_score double, readiness_band string, summary string, action_items array<struct<priority:string,title:string>>",
        {
            "readiness_score": lambda p: _whole(p["readiness_score"]).between(0, 100),
            "readiness_band": lambda p: p["readiness_band"].isNotNull(),
            "summary": lambda p: p["summary"].isNotNull(),
            "priority": lambda p: p["action_items"].isNull()
            | F.forall(p["action_items"], lambda a: _one_of(a["priority"], PRIORITY) & a["title"].isNotNull()),
        },
    ),
    "rewrite": ("bullet string, placeholders array<string>", {"bullet_length": lambda p: F.length(p["bullet"]).between(10, 400)}),
    "letter": ("subject string, body string", {"body_length": lambda p: F.length(p["body"]) >= 80}),
}

REQUESTS = {
    "answer": {
        "text_length": lambda p: F.length(p["text"]).between(10, 8000),
        "duration": lambda p: p["duration_seconds"].isNull() | p["duration_seconds"].between(0, 7200),
    },
    "session": {"title_length": lambda p: F.length(p["title"]).between(2, 160)},
    "document": {"text_length": lambda p: F.length(p["text"]) <= 200_000},
}


#: What a request of each kind carries.
REQUEST_FIELDS = {"answer": "text string, duration_seconds double", "session": "title string", "document": "text string"}


def broken(rules: dict, payload) -> Column:
    """array<string> of the rules that do not hold; an unknown outcome counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(holds(payload), F.lit(False)), name) for name, holds in rules.items()])
    )


def check_json(rows: DataFrame, contract: str, payload: str = "payload") -> DataFrame:
    """Add ``violations`` of a JSON column.

    The parsed payload comes out of a generator, which filters on the outcome do not pass: it is parsed once for
    all rules, and the rules are plain columns.
    """
    schema, rules = CONTRACTS[contract]
    parsed = F.from_json(payload, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    p = F.col("_p")
    checked = F.when(p.isNull() | p["_bad"].isNotNull(), F.array(F.lit("malformed"))).otherwise(broken(rules, p))
    return rows.select("*", F.explode(F.array(parsed)).alias("_p")).select(*[F.col(f"`{c}`") for c in rows.columns], checked.alias("violations"))


def check_payloads(rows: DataFrame, contract: str = "contract", payload: str = "payload") -> DataFrame:
    """Add ``violations`` of JSON payloads of many kinds; the ``contract`` column names a contract, or a request as
    ``request:kind``.

    A payload is parsed once, to a variant, whatever its kind; a rule reads the fields of its own contract, and a field
    that does not convert to its type counts as missing. A payload that is no JSON object is ``malformed``, a kind that is not known
    ``unknown_contract``.
    """
    kinds = {name: (fields, rules) for name, (fields, rules) in CONTRACTS.items()}
    kinds |= {f"request:{name}": (REQUEST_FIELDS[name], rules) for name, rules in REQUESTS.items()}
    found = F.array(F.lit("unknown_contract"))
    for name, (fields, rules) in kinds.items():
        read = {f.name: F.try_variant_get(F.col("_v"), f"$.{f.name}", f.dataType.simpleString()) for f in T.StructType.fromDDL(fields)}
        found = F.when(F.col(f"`{contract}`") == name, broken(rules, read)).otherwise(found)
    known = F.col(f"`{contract}`").isin(*kinds)
    object_ = F.schema_of_variant("_v").startswith("OBJECT")
    checked = F.when(known & (F.col("_v").isNull() | ~object_), F.array(F.lit("malformed"))).otherwise(found)
    # The parsed payload comes out of a generator, as above: one parse for all rules.
    parsed = rows.select("*", F.explode(F.array(F.try_parse_json(F.col(f"`{payload}`")))).alias("_v"))
    return parsed.select(*[F.col(f"`{c}`") for c in rows.columns], checked.alias("violations"))


def check_request(rows: DataFrame, request: str) -> DataFrame:
    return rows.withColumn("violations", broken(REQUESTS[request], rows))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


PROFILE_FIELDS = (
    ("headline", "Current title"), ("seniority", "Seniority"), ("years_experience", "Years of experience"),
    ("target_roles", "Targeting"), ("languages", "Languages"),
)


def profile_context(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, context): the only profile text that leaves the table. Everything personal stays behind
    because only the listed columns are selected."""
    parts = []
    for name, title in PROFILE_FIELDS:
        value = F.col(name).cast("string")
        parts.append(F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{title}: "), value)))
    return profiles.select(key, F.concat_ws("\n", *parts).alias("context"))
