"""Embedders, judges and contracts that callers bring or mix, and the evaluation over files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmatch.operators import grid as G
from gapmatch.operators import judges as J
from gapmatch.operators.memo import Memo, model_embedder, word_model
from gapmatch.plans import evaluate
from gapmatch.sources import contracts as C
from gapmatch.sources import documents as D
from gapmatch.sources import store as S
from gapmatch.storage import work_dir


def counting(folder):
    """A model that writes down every batch it is called with, and when it is loaded."""
    def load():
        import uuid
        from pathlib import Path

        Path(folder, f"load-{uuid.uuid4().hex}").write_text("")
        whole = word_model(16)

        def model(texts):
            Path(folder, f"batch-{uuid.uuid4().hex}").write_text(json.dumps(texts))
            return whole(texts)

        return model

    return load


def test_memo_embeds_every_text_once(spark, tmp_path):
    texts = [f"text number {k % 250}" for k in range(700)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    embed = model_embedder(f"counting-{tmp_path.name}", counting(str(tmp_path)))
    memo = Memo(spark, f"{work_dir(spark)}/memo-{tmp_path.name}-a", "m", 16, embed)
    assert memo.stored().count() == 0
    assert memo.fill(df.filter("doc_id < 100"), "a") == 100
    assert memo.fill(df, "b") == 151  # 150 more, and the empty text once for null and ''
    assert memo.fill(df, "c") == 0
    sent = [t for f in tmp_path.glob("batch-*") for t in json.loads(f.read_text())]
    assert len(sent) == 251 and len(set(sent)) == 251
    assert max(len(json.loads(f.read_text())) for f in tmp_path.glob("batch-*")) <= 100
    got = {r["doc_id"]: r["vec"] for r in memo.vectors(df).collect()}
    want = word_model(16)([t or "" for t in texts]).astype(np.float32)
    assert len(got) == 702 and all(np.allclose(got[i], want[i]) for i in range(702))
    other = Memo(spark, memo.path, "another model", 16, embed)
    assert other.misses(df).count() == 251


ITEMS = [("s", "1", "Builds Kafka pipelines", "We ran Kafka daily."), ("s", "2", "Knows Rust", "We ran Kafka daily."), ("s", "3", "Speaks Greek", None), ("s", "4", "Runs Kafka", "Kafka, never written")]
FOUND = [("s", "1", 1, "We ran  kafka daily. And more."), ("s", "2", 1, "We ran Kafka daily."), ("s", "4", 1, "Else.")]


def test_judges_share_one_table(spark):
    items = spark.createDataFrame(ITEMS, "scope string, query_id string, text string, evidence_quote string")
    found = spark.createDataFrame(FOUND, "scope string, query_id string, rank int, text string")

    def strict(requirements, quotes, passages):
        return [(len(p) > 0 and "Rust" not in r, 0.5, f"{len(q)} characters") for r, q, p in zip(requirements, quotes, passages)]

    opinions = J.judged(items, found, [J.VERBATIM, J.model_judge("strict", strict)])
    got = {(r.judge, r.query_id): (r.supported, r.score, r.rationale) for r in opinions.collect()}
    assert got["verbatim", "1"] == (True, .333, "quoted word for word, 1 of 3 keywords")
    assert got["verbatim", "2"][0] is False and got["verbatim", "4"] == (False, .5, "not in a passage, 1 of 2 keywords")
    assert got["strict", "1"] == (True, .5, "19 characters") and got["strict", "2"][0] is False and len(got) == 6
    rates = {r.judge: (r.judged, r.support_rate, r.trustworthy, r.note, r.agreement) for r in J.by_judge(opinions).collect()}
    assert rates == {"verbatim": (3, .333333, False, "indicative only", .666667), "strict": (3, .666667, True, "", .666667)}


GOOD = {
    "requirement": {"text": "Knows Kafka"}, "requirements": {"requirements": []},
    "match_item": {"requirement": "x", "status": "strong", "confidence": 0.5}, "match_report": {"overall_score": 99.5, "verdict": "v", "summary": "s"},
    "question": {"category": "technical", "text": "Why is that so?"}, "questions": {"questions": [{"category": "technical", "text": "t", "difficulty": 1}]},
    "evaluation": {"rubric": "star", "criteria": [{"name": "a", "score": 5}] * 3, "overall_score": 4.2}, "scorecard": {"readiness_score": 50, "readiness_band": "b", "summary": "s"},
    "rewrite": {"bullet": "Shipped [X] to all"}, "letter": {"subject": "s", "body": "b" * 80}, "request:answer": {"text": "t" * 10}, "request:session": {"title": "My job"},
    "request:document": {"text": "any"},
}
BAD = [
    ("requirement", '{"text": "ab", "category": "odd"}', ["text_length", "category"]), ("requirement", "[1, 2]", ["malformed"]), ("requirement", "{", ["malformed"]),
    ("requirement", None, ["malformed"]), ("match_item", '{"requirement": "x", "status": "strong", "confidence": "high"}', ["confidence"]), ("match_item", '{"status": "strong", "confidence": 2}', ["requirement", "confidence"]),
    ("evaluation", '{"rubric": "star", "criteria": [{"score": 6}], "overall_score": 0}', ["criteria_size", "criterion_range", "overall_score"]),
    ("scorecard", '{"readiness_score": 101, "readiness_band": "b", "summary": "s", "action_items": [{"priority": "high"}]}', ["readiness_score", "priority"]),
    ("request:answer", '{"text": "short", "duration_seconds": 7201}', ["text_length", "duration"]), ("request:session", '{"title": "x"}', ["title_length"]),
    ("nobody", "{}", ["unknown_contract"]), (None, "{}", ["unknown_contract"]),
]


def test_all_contracts_in_one_pass(spark):
    rows = [(n, k, json.dumps(v)) for n, (k, v) in enumerate(GOOD.items())] + [(100 + n, k, v) for n, (k, v, _) in enumerate(BAD)]
    checked = C.check_payloads(spark.createDataFrame(rows, "n int, contract string, payload string"))
    assert set(GOOD) == {*C.CONTRACTS, *(f"request:{k}" for k in C.REQUESTS)}
    got = {r.n: r.violations for r in checked.collect()}
    assert all(got[n] == [] for n in range(len(GOOD))) and {n - 100: v for n, v in got.items() if n >= 100} == {n: v for n, (_, _, v) in enumerate(BAD)}
    plan = C.quarantined(checked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert C.accepted(checked).count() == len(GOOD)


def test_upload_guard(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 rest")
    (tmp_path / "b.pdf").write_bytes(b"PK zip")
    (tmp_path / "c.pdf").write_bytes(b"%P")
    with open(tmp_path / "d.pdf", "wb") as f:
        f.write(b"%PDF")
        f.truncate(D.K.MAX_BYTES + 1)
    got = {r.path.rsplit("/", 1)[1]: r.upload_error for r in D.read_binary_files(spark, str(tmp_path)).drop("content").collect()}
    assert got == {"a.pdf": None, "b.pdf": "not_a_pdf", "c.pdf": "not_a_pdf", "d.pdf": "too_large"}


ANSWERS = {"answers": [
    {"id": "a1", "rubric": "technical", "question": "q", "requirement": "Kafka", "expected_score": 4, "text": "Kafka ran for 3 years. It was a trade-off against cost, because of latency. " * 4},
    {"id": "a2", "rubric": "star", "question": "q", "expected_score": 1, "text": "We did it."},
    {"id": "a3", "rubric": "star", "question": "q", "requirement": "", "expected_score": 3, "text": "The situation was a failing service. My task was to fix it. I rebuilt it and reduced errors by 40%."}],
    "pairs": [["a1", "a2"], ["a3", "a2"], ["a1", "gone"]]}


def test_answer_files_and_measured_repeats(spark, tmp_path):
    (tmp_path / "answers.json").write_text(json.dumps(ANSWERS))
    answers, pairs = S.read_answers(spark, str(tmp_path / "answers.json"))
    assert {r.answer_id: (r.rubric, r.requirement, r.expected) for r in answers.collect()} == {
        "a1": ("technical", "Kafka", 4.0), "a2": ("star", "", 1.0), "a3": ("star", "", 3.0)}
    assert sorted((r.better, r.worse) for r in pairs.collect()) == [("a1", "a2"), ("a1", "gone"), ("a3", "a2")]
    row = evaluate.scoring_metrics(spark, str(tmp_path)).first()
    assert (row.answers, row.repeated, row.self_consistency, row.checked, row.pairwise_accuracy) == (3, 3, 0.0, 2, 1.0)
    # A scorer that varies is seen to vary.
    varied = G.repeated_scores(answers, lambda rows: rows.withColumn("overall_score", F.col("repeat") + 1), 3)
    assert G.scoring_by_repeat(varied.withColumn("suite", F.lit(1)), "suite").first().self_consistency == pytest.approx(0.816497)


CV = """EXPERIENCE
Built data pipelines with Kafka and Spark for a retail company, and ran them for three years without an outage.
Led the migration of forty services to Kubernetes and wrote the deployment tooling in Go.

SKILLS
Kafka, Spark, Python, Go, Kubernetes, PostgreSQL
"""
JD = """REQUIREMENTS
- Experience with Kafka pipelines in production
- Deployment of services on Kubernetes
- Fluent in Haskell and formal verification
"""


def test_evaluation_of_a_folder_equals_one_configuration_at_a_time(spark, tmp_path):
    for name, text in (("cv1.txt", CV), ("jd1.txt", JD), ("cv2.txt", CV.replace("Kafka", "Flink")), ("jd2.txt", JD)):
        (tmp_path / name).write_text(text)
    wanted = [{"match": "Kafka", "expected_status": "strong"}, {"match": "Haskell", "expected_status": "missing"}]
    probes = [{"query": "kafka pipelines", "relevant_contains": ["Built data pipelines"]}, {"query": "container deployment", "relevant_contains": ["Kubernetes and wrote"]}]
    (tmp_path / "labels.json").write_text(json.dumps({"pairs": [
        {"id": "p1", "cv": "cv1.pdf", "jd": "jd1.pdf", "requirements": wanted, "retrieval": probes},
        {"id": "p2", "cv": "cv2.pdf", "jd": "jd2.pdf", "requirements": [{"match": "Kafka", "expected_status": "missing"}], "retrieval": []}]}))
    whole = {r.config: r.asDict() for r in evaluate.quality_metrics(spark, str(tmp_path)).collect()}
    assert set(whole) == set(G.GRID) and all(r["probes"] == 2 and r["requirements"] == 6 and r["labelled"] == 3 for r in whole.values())
    assert all(r["citation_validity"] == 1.0 and r["summary_numeric_consistency"] == 1.0 for r in whole.values())
    for name in ("rerank off", "windows"):
        alone = evaluate.quality_metrics(spark, str(tmp_path), grid={name: G.GRID[name]}).first().asDict()
        assert alone == whole[name]


def test_metrics_sink_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("all on", "quality", "mrr", 0.5), ("all on", "quality", "lost", None)], "config string, suite string, metric string, value double")
    for _ in range(2):
        S.append_metrics(rows, str(tmp_path / "sink"))
    back = spark.read.json(str(tmp_path / "sink"))
    assert back.count() == 4 and back.filter("metric = 'mrr'").select("config", "suite", "value").distinct().collect() == [("all on", "quality", 0.5)]
    assert {r.run_ts is not None for r in back.collect()} == {True}
