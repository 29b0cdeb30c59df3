import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmatch.operators import evaluation as E
from gapmatch.operators import interview as I
from gapmatch.operators import progress as G
from gapmatch.operators import ranks
from gapmatch.operators import scorecards as S
from gapmatch.operators import telemetry as L

ITEM = "session_id int, order_key int, requirement string, category string, kind string, status string, confidence double, evidence_quote string"


def item(s, n, req, status, category="must_have", kind="evidenceable"):
    return (s, n, req, category, kind, status, .5, None)


def test_questions(spark):
    rows = [item(1, 0, "A", "strong"), item(1, 1, "B", "missing"), item(1, 2, "C", "missing", "nice_to_have"), item(1, 3, "D", "missing", kind="behavioural")]
    got = I.plan_questions(spark.createDataFrame(rows, ITEM), n_technical=2).orderBy("category", "place").collect()
    assert [(r.category, r.linked_requirement, r.difficulty) for r in got] == [
        ("behavioural", "D", 3), ("behavioural", "Incident ownership", 3), ("behavioural", "Pragmatism", 3), ("technical", "B", 4), ("technical", "C", 4)]


def test_answers_are_scored_on_the_right_rubric(spark):
    rows = [("w", "star", "", "When I joined, my job was the queue. I built it and I led three people. As a result we cut costs by 40% and saved 12 ms."),
            ("n", "star", "", "No."), ("t", "technical", "Kafka", "I chose Kafka rather than a table because of load; but the cost of it was real.")]
    df = I.score_answers(I.answer_features(spark.createDataFrame(rows, "id string, rubric string, requirement string, answer string")))
    got = {r.id: r for r in df.collect()}
    assert [c.name for c in got["w"].criteria] == ["Situation", "Task", "Action", "Result", "Impact"]
    assert got["w"].overall_score > got["n"].overall_score == 1.0
    assert got["n"].weakest == "Situation" and len(got["n"].improvements) == 3
    assert [c.name for c in got["t"].criteria][0] == "Correctness" and got["t"].trade_offs == 3
    assert got["t"].criterion_scores["Relevance"] == 4.0


def test_scorecard_uses_the_latest_answer(spark):
    answers = spark.createDataFrame(
        [(1, 1, 1, 10, [("Depth", 1)]), (1, 1, 2, 40, [("Depth", 4)]), (1, 2, 1, 30, [("Depth", 3)])],
        "session_id int, question_id int, answer_key int, score10 long, criteria array<struct<name:string,score:int>>")
    latest = S.latest_per_key(answers, ["session_id", "question_id"], ["answer_key"])
    scores = spark.createDataFrame([(1, 50), (2, 80)], "session_id int, overall_score long")
    card = S.readiness(scores, latest).collect()
    assert [(c.session_id, c.answers, c.answer_mean, c.readiness_score, c.readiness_band) for c in card] == [(1, 2, 3.5, 62, "Nearly ready")]
    assert {c.session_id: c.readiness_score for c in S.readiness(scores, latest, minimum=0).collect()}[2] == 80
    comps = S.competencies(latest)
    assert comps.first().score == 3.5
    items = spark.createDataFrame([item(1, n, f"R{n}", "missing") for n in range(9)], ITEM)
    acts = S.action_items(spark.createDataFrame([(1,), (2,)], "session_id int"), items, comps).orderBy("session_id", "place").collect()
    assert [a.session_id for a in acts] == [1] * 8 + [2] and acts[-1].priority == "low"


def test_progress(spark):
    day = lambda n: datetime(2024, 1, n)
    sessions = spark.createDataFrame(
        [(7, 1, "One", day(1)), (7, 2, "Two", day(2)), (7, 3, "Two", day(3)), (8, 4, "Else", day(1))], "user_id int, session_id int, title string, created_at timestamp")
    items = spark.createDataFrame(
        [item(1, 0, "Experience with Terraform", "missing"), item(2, 0, "Terraform or similar", "missing"), item(3, 0, "Terraform again", "missing"),
         item(2, 1, "Kafka", "missing"), item(3, 1, "Kafka", "missing"), item(4, 0, "Terraform", "missing"), item(1, 2, "Redis", "strong")], ITEM)
    got = G.recurring_gaps(sessions, items).collect()
    assert [(g.user_id, g.gap_key, g.label, g.missing_in, g.applications) for g in got] == [(7, "terraform", "Experience with Terraform", 2, ["One", "Two"])]
    by_id = G.recurring_gaps(sessions, items, by_title=False).orderBy("place").collect()
    assert [(g.gap_key, g.missing_in) for g in by_id] == [("terraform", 3), ("kafka", 2)]
    comps = spark.createDataFrame([(1, "Depth", 2.0), (3, "Depth", 3.5), (4, "Depth", 1.0)], "session_id int, name string, score double")
    assert [(t.user_id, t.first, t.latest, t.series, t.delta) for t in G.competency_trend(sessions, comps).collect()] == [(7, 2.0, 3.5, [2.0, 3.5], 1.5)]
    results = spark.createDataFrame([(1, 40, 50, 2, 75), (2, 61, None, 0, 0), (3, None, 70, 0, 0)],
                                    "session_id int, match_score long, readiness_score long, answers long, s10 long")
    points = G.session_points(sessions.withColumn("target_role", F.lit("Engineer")), results)
    t = {r.user_id: r for r in G.progress_totals(points).collect()}
    assert (t[7].sessions_total, t[7].sessions_scored, t[7].latest_readiness, t[7].readiness_delta, t[7].mean_match, t[7].has_trend) == (3, 2, 70, 20, 50.5, False)
    assert t[7].mean_answer_score == 3.75 and t[8].best_readiness is None and t[8].mean_answer_score is None


def test_results_count_all_answers_and_grade_the_latest(spark):
    answers = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 2, 40), (1, 2, 1, 30), (3, 1, 1, 20)], "session_id int, question_id int, answer_key int, score10 long")
    scores = spark.createDataFrame([(1, 50), (2, 80)], "session_id int, overall_score long")
    got = G.session_results(scores, answers, ("answer_key",)).orderBy("session_id").collect()
    assert [tuple(r) for r in got] == [(1, 50, 62, 3, 80), (2, 80, None, 0, 0), (3, None, None, 1, 20)]
    assert G.session_results(scores, answers, ("answer_key",), minimum=0).filter("session_id = 2").first().readiness_score == 80


def test_every_table_is_read_once(spark, tmp_path):
    """Roll-ups over stored tables scan each of them once."""
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    sessions = stored("sessions", [(7, 1, "One", "Engineer", 1)], "user_id int, session_id int, title string, target_role string, created_at int")
    items = stored("items", [item(1, 0, "R", "missing")], ITEM)
    comps = stored("comps", [(1, "Depth", 2.0)], "session_id int, name string, score double")
    scores = stored("scores", [(1, 50)], "session_id int, overall_score long")
    answers = stored("answers", [(1, 1, 1, 10)], "session_id int, question_id int, answer_key int, score10 long")
    results = G.session_results(scores, answers, ("answer_key",))
    for df, tables in ((S.action_items(sessions, items, comps), 3), (G.progress_totals(G.session_points(sessions, results)), 3),
                       (G.recurring_gaps(sessions, items), 2), (G.competency_trend(sessions, comps), 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == tables


def test_metrics_on_tiny_tables(spark):
    outcomes = spark.createDataFrame([("q1", 1), ("q2", 4), ("q3", None)], "query_id string, first_rank long")
    m = E.retrieval_metrics(outcomes).first()
    assert (m.probes, m.hit_rate_1, m.hit_rate_3, m.hit_rate_5, m.mean_first_rank) == (3, .333333, .333333, .666667, 2.5) and m.mrr == pytest.approx(.416667)
    empty = E.retrieval_metrics(outcomes.limit(0)).first()
    assert empty.probes == 0 and empty.hit_rate_1 == 0.0 and empty.mean_first_rank is None
    items = spark.createDataFrame(
        [("strong", "strong", "q", True, True), ("partial", "missing", "q", False, True), ("missing", "strong", None, None, None), ("strong", None, None, None, None)],
        "predicted string, expected string, quote string, quote_in_source boolean, quote_in_context boolean")
    g = E.grounding_metrics(items).first()
    assert (g.labelled, g.citation_validity, g.citation_in_context, g.unsupported_verdict_rate) == (3, .5, 1.0, .333333)
    assert (g.status_accuracy, g.status_within_one, g.false_evidence_rate, g.missed_evidence_rate) == (.333333, .666667, 1.0, .5)


def test_rank_correlation_with_ties(spark):
    rows = [("a", x, y) for x, y in ((1, 2), (2, 2), (3, 5), (4, 4), (4, 7))] + [("b", 1, 1), ("b", 2, 2), ("c", 1, 3), ("c", 2, 3), ("c", 3, 3)]
    df = spark.createDataFrame([(s, float(x), float(y)) for s, x, y in rows], "suite string, expected double, predicted double")
    got = {r.suite: r.spearman for r in E.spearman(df, "suite").collect()}
    assert got["a"] == pytest.approx(0.789474, abs=1e-6) and got["b"] is None and got["c"] is None


def test_pairs_without_scores_are_skipped(spark):
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "gone")], "better string, worse string")
    scores = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "answer_id string, predicted double")
    got = E.pairwise_accuracy(E.pair_outcomes(pairs, scores)).first()
    assert (got.checked, got.violations, got.pairwise_accuracy) == (2, 1, .5)


def test_exact_percentile(spark):
    rows = [("a", float(i)) for i in range(1001)] + [("b", 5.0)] * 700 + [("c", 1.0), ("c", 3.0)]
    df = spark.createDataFrame(rows, "stage string, latency_ms double")
    got = {r.stage: (r.calls, r.p95_ms) for r in L.latency_by_stage(df).collect()}
    assert got == {"a": (1001, 950.0), "b": (700, 5.0), "c": (2, 2.9)}


@pytest.mark.parametrize("size", [7, 1 << 18])
def test_ranks_of_one_group_with_all_rows(spark, monkeypatch, size):
    """Ranges of a few values: the same ranks, and no window over a whole group."""
    monkeypatch.setattr(ranks, "RANGE", size)
    rng = random.Random(4)
    rows = [("all", float(rng.randrange(400)), float(rng.randrange(300))) for _ in range(2000)] + [("few", 1.0, 2.0), ("few", 2.0, 2.5), ("few", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "suite string, expected double, predicted double")
    got = {(r.suite, r.expected): r.r for r in E.average_ranks(df, "expected", "r", "suite").collect()}
    for suite in ("all", "few"):
        values = [x for s, x, _ in rows if s == suite]
        for v in set(values):
            assert got[suite, v] == sum(x < v for x in values) + (values.count(v) + 1) / 2
    want = np.corrcoef(*(_ranks([r[k] for r in rows if r[0] == "all"]) for k in (1, 2)))[0, 1]
    assert {r.suite: r.spearman for r in E.spearman(df, "suite").collect()}["all"] == pytest.approx(want, abs=1e-6)
    latencies = df.select(F.col("suite").alias("stage"), (F.col("expected") * 7 + F.col("predicted")).alias("latency_ms"))
    p95 = {r.stage: r.p95_ms for r in L.latency_by_stage(latencies).collect()}
    for suite in ("all", "few"):
        assert p95[suite] == pytest.approx(np.percentile([x * 7 + y for s, x, y in rows if s == suite], 95), abs=1e-6)


def _ranks(values):
    return [sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values]


def test_money(spark):
    calls = spark.createDataFrame([("gpt-4o", 1000, 100), ("mystery", 5, 5)], "model string, prompt_tokens int, completion_tokens int")
    priced = L.price(calls, L.rate_table(spark))
    assert {r.model: float(r.cost_usd) for r in priced.collect()} == {"gpt-4o": 0.0035, "mystery": 0.0}
    assert L.spend_gate(priced, 0.0035).first().refused and not L.spend_gate(priced, 0).first().refused
    assert L.spend_gate(priced.limit(0)).first().refused is False
    assert [r.model for r in L.unpriced(calls, L.rate_table(spark)).collect()] == ["mystery"]


def test_quotes_are_sought_in_the_document_they_cite(spark):
    items = spark.createDataFrame(
        [("s", "1", "Runs Kafka", "strong", "must_have", "evidenceable", "Ran  kafka daily", "cv1-s0-p0-c0"),
         ("s", "2", "Knows Rust", "strong", "must_have", "evidenceable", "ran kafka daily", "cv2-f3-c0"),
         ("s", "3", "Speaks Greek", "missing", "must_have", "evidenceable", None, None)],
        "scope string, query_id string, text string, status string, category string, kind string, evidence_quote string, evidence_chunk_id string")
    passages = spark.createDataFrame([("s", "1", "We ran Kafka daily."), ("s", "1", "Else."), ("s", "2", "Nothing.")], "scope string, query_id string, text string")
    sources = spark.createDataFrame([("cv1", "x" * 500 + " We ran Kafka\ndaily."), ("cv2", "No such line.")], "doc_key string, text string")
    labels = spark.createDataFrame([("s", 1, "kafka", "strong"), ("s", 2, "rust", "missing"), ("t", 3, "greek", "missing")],
                                   "scope string, label_pos int, phrase string, expected string")
    got = E.grounding_outcomes(items, passages, sources, labels).orderBy("query_id").collect()
    assert [(g.predicted, g.expected, g.quote_in_source, g.quote_in_context) for g in got] == [
        ("strong", "strong", True, True), ("strong", "missing", False, False), ("missing", None, None, None)]
