import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as t

from gapmatch.operators import telemetry as L
from gapmatch.sources import contracts as C
from gapmatch.sources import store as W
from gapmatch.streaming import jobs as J
from gapmatch.streaming.breaches import breach_events


def test_contracts_quarantine_with_reasons(spark):
    crit = [{"name": n, "score": 3} for n in "abc"]
    good = {"rubric": "star", "criteria": crit, "overall_score": 3.5}
    rows = [good, {**good, "rubric": "essay"}, {**good, "criteria": crit[:2] + [{"name": "c", "score": 6}]}, {**good, "criteria": crit[:1], "overall_score": 0}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(4, "{oops")], "i int, payload string")
    got = {r.i: r.violations for r in C.check_json(df, "evaluation").collect()}
    assert got == {0: [], 1: ["rubric"], 2: ["criterion_range"], 3: ["criteria_size", "overall_score"], 4: ["malformed"]}
    plan = C.quarantined(C.check_json(df, "evaluation"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    report = spark.createDataFrame([('{"overall_score": 100.4, "verdict": "v", "summary": "s"}',), ('{"overall_score": 100.6, "verdict": "v"}',)], "payload string")
    assert [r.violations for r in C.check_json(report, "match_report").collect()] == [[], ["overall_score", "summary"]]
    assert C.accepted(C.check_json(report, "match_report")).count() == 1


def test_profile_lets_nothing_personal_out(spark):
    df = spark.createDataFrame([(1, "Dev", None, 3, "", "Greek", "1990-01-01", "x")],
                               "user_id int, headline string, seniority string, years_experience int, target_roles string, languages string, date_of_birth string, gender string")
    out = C.profile_context(df)
    assert out.columns == ["user_id", "context"] and out.first().context == "Current title: Dev\nYears of experience: 3\nLanguages: Greek"


def test_merge_and_erasure(spark):
    first = spark.createDataFrame([("a", "s1", 1), ("b", "s1", 2), ("c", "s2", 3)], "chunk_id string, session_id string, v int")
    merged = W.upsert(first, spark.createDataFrame([("b", "s1", 9)], first.schema), ["chunk_id"])
    assert {r.chunk_id: r.v for r in merged.collect()} == {"a": 1, "b": 9, "c": 3}
    left = W.purge(merged, spark.createDataFrame([("s1",)], "session_id string"), ["session_id"])
    assert [r.chunk_id for r in left.collect()] == ["c"]


def test_erasure_reaches_every_child_and_keeps_telemetry(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "sessions": df([(1,), (2,)], "session_id int"), "question": df([(10, 1), (20, 2)], "question_id int, session_id int"),
        "answer": df([(100, 10), (200, 20)], "answer_id int, question_id int"), "evaluation": df([(7, 100), (8, 200)], "evaluation_id int, answer_id int"),
        "cover_letter": df([(5, 1)], "letter_id int, session_id int"), "llm_call": df([(1, 1), (2, 2)], "call_id int, session_id int"),
    }
    left = W.erase_sessions(tables, df([(1,)], "session_id int"))
    assert {n: x.count() for n, x in left.items()} == {"sessions": 1, "question": 1, "answer": 1, "evaluation": 1, "cover_letter": 0, "llm_call": 2}
    assert sorted(str(r.session_id) for r in left["llm_call"].collect()) == ["2", "None"]


def test_tables_that_carry_their_session_are_erased_without_their_parents(spark, tmp_path):
    for name, rows, schema in (("sessions", [(1,), (2,)], "session_id int"), ("question", [(10, 1), (20, 2)], "question_id int, session_id int"),
                               ("answer", [(100, 10, 1), (200, 20, 2)], "answer_id int, question_id int, session_id int"),
                               ("evaluation", [(7, 100), (8, 200)], "evaluation_id int, answer_id int")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("sessions", "question", "answer", "evaluation")}
    left = W.erase_sessions(tables, spark.createDataFrame([(1,)], "session_id int"))
    assert {n: [r[f"{n}_id"] for r in x.withColumnRenamed("session_id", "sessions_id").collect()] for n, x in left.items()} == {
        "sessions": [2], "question": [20], "answer": [200], "evaluation": [8]}
    scans = {n: x._jdf.queryExecution().executedPlan().toString().count("FileScan") for n, x in left.items()}
    assert scans == {"sessions": 1, "question": 1, "answer": 1, "evaluation": 2}


def test_schema_drift(spark):
    stored = spark.createDataFrame([(1,)], "a int")
    ok = t.StructType([t.StructField("a", t.IntegerType()), t.StructField("b", t.StringType())])
    assert W.conform(stored, ok).first().asDict() == {"a": 1, "b": None}
    with pytest.raises(ValueError):
        W.conform(stored, t.StructType([t.StructField("b", t.StringType(), False)]))


def test_label_files(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"pairs": [
        {"id": "p", "cv": "a.pdf", "jd": "b.pdf", "requirements": [{"match": "Kafka", "expected_status": "strong"}], "retrieval": []},
        {"id": "r", "cv": "a.pdf", "jd": "b.pdf", "requirements": [], "retrieval": [{"query": "q", "relevant_contains": ["x"]}]}]}))
    labels, probes = W.read_labels(spark, str(tmp_path / "labels.json"))
    assert [r.scope for r in labels.collect()] == ["p"] and [r.scope for r in probes.collect()] == ["r"]


def test_streams_do_not_depend_on_batching(spark, tmp_path):
    rows = [(c, f"2024-01-01 {h:02d}:{m:02d}:00") for c in (1, 2) for h in range(3) for m in range(0, 60, 10 * c)]
    events = spark.createDataFrame(rows, "caller int, ts string").select("caller", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts")
    found = {}
    for parts in (1, 6):
        folder = str(tmp_path / f"in{parts}")
        events.repartitionByRange(parts, "ts").write.parquet(folder)
        base = str(tmp_path / f"out{parts}")
        stream = J.file_stream(spark, folder, "*.parquet", events.schema, per_trigger=1)
        J.request_rates(stream, base, "1 hour", 4, lateness="1 day").awaitTermination()
        found[parts] = sorted((r.caller, r.window_start, r.requests, r.over) for r in J.newest(spark, f"{base}/rates", ["caller", "window_start"]).collect())
    assert found[1] == found[6] and len(found[1]) == 6 and [r[2:] for r in found[1]] == [(6, True)] * 3 + [(3, False)] * 3


@pytest.mark.parametrize("files", [1, 4])
def test_breach_is_the_same_call_for_any_batching(spark, tmp_path, files):
    rows = [("a", 1, "10:00", "0.4"), ("b", 2, "10:00", "0.1"), ("a", 4, "11:30", "0.3"), ("a", 3, "11:30", "0.3"), ("a", 5, "11:40", "5.0"), ("b", 6, "12:00", "0.2")]
    calls = spark.createDataFrame(rows, "installation string, call_id int, at string, c string").selectExpr(
        "installation", "call_id", "cast(concat('2024-01-01 ', at, ':00') as timestamp) created_at", "cast(c as decimal(18,9)) cost_usd")
    folder = str(tmp_path / "in")
    calls.repartition(files, "call_id").write.parquet(folder)
    base = str(tmp_path / "out")
    J.spend(J.file_stream(spark, folder, "*.parquet", calls.schema, per_trigger=1), base).awaitTermination()
    hours = J.newest(spark, f"{base}/spend", ["installation", "hour"])
    got = [(r.installation, r.call_id, float(r.spent_usd)) for r in L.first_breaches(hours, calls, 1.0).collect()]
    assert got == [("a", 4, 1.0)]
    assert L.first_breaches(hours, calls, 0).count() == 0


@pytest.mark.parametrize("files", [1, 4])
def test_keyed_breach_is_the_same_call_for_any_batching(spark, tmp_path, files):
    """The events of the two-pass answer, from state alone; every installation that has been silent is let go."""
    rows = [("a", 1, "10:00", "0.4"), ("b", 2, "10:00", "0.1"), ("a", 4, "11:30", "0.3"), ("a", 3, "11:30", "0.3"), ("a", 5, "11:40", "5.0"), ("b", 6, "12:00", "0.2"),
            ("c", 7, "12:30", "7.5"), ("c", 8, "12:31", "1.0")]
    schema = "installation string, call_id int, at string, c string"
    calls = spark.createDataFrame(rows, schema).selectExpr(
        "installation", "call_id", "cast(concat('2024-01-01 ', at, ':00') as timestamp) created_at", "cast(c as decimal(18,9)) cost_usd")
    later = spark.createDataFrame([("z", 9, "10:00", "0.1")], schema).selectExpr(
        "installation", "call_id", "cast(concat('2024-01-05 ', at, ':00') as timestamp) created_at", "cast(c as decimal(18,9)) cost_usd")
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    calls.repartition(files, "call_id").write.parquet(folder)
    stream = J.file_stream(spark, folder, "*.parquet", calls.schema, per_trigger=1)
    events = breach_events(stream, 1.0, "1 day", timedelta(days=1))
    J.start(events, J.into(f"{base}/events"), base).awaitTermination()
    later.coalesce(1).write.mode("append").parquet(folder)
    query = J.start(events, J.into(f"{base}/events"), base)
    query.awaitTermination()
    got = spark.read.schema("installation string, call_id bigint, created_at timestamp, spent_usd decimal(18,9)").parquet(f"{base}/events").collect()
    want = L.first_breaches(L.spend_hours(calls), calls, 1.0).collect()
    assert sorted((r.installation, r.call_id, r.created_at, r.spent_usd) for r in got) == sorted((r.installation, r.call_id, r.created_at, r.spent_usd) for r in want)
    assert {r.installation for r in got} == {"a", "c"}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # z alone


@pytest.mark.parametrize("files", [1, 3])
def test_tiers_have_their_own_windows_and_ceilings(spark, tmp_path, files):
    rows = [("u", "auth", f"10:00:{s:02d}") for s in range(6)] + [("u", "auth", "10:01:00")]
    rows += [("u", "register", f"10:{m:02d}:00") for m in range(11)] + [("v", "nothing", "10:59:59")]
    asked = spark.createDataFrame(rows, "caller string, tier string, at string").selectExpr("caller", "tier", "cast(concat('2024-01-01 ', at) as timestamp) ts")
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    asked.repartition(files).write.parquet(folder)
    J.request_tiers(J.file_stream(spark, folder, "*.parquet", asked.schema, per_trigger=1), base, lateness="1 day").awaitTermination()
    got = J.newest(spark, f"{base}/tiers", ["caller", "tier", "window_start"]).collect()
    assert sorted((r.caller, r.tier, r.window_start.strftime("%H:%M"), r.requests, r.over) for r in got) == [
        ("u", "auth", "10:00", 6, True), ("u", "auth", "10:01", 1, False), ("u", "register", "10:00", 11, True), ("v", "nothing", "10:00", 1, False)]


def test_a_document_twice_in_one_batch_and_a_replayed_batch(spark, tmp_path):
    text = "Built the billing service and ran its migration without an outage. " * 20
    rows = [("a", 2, text + "The last version."), ("a", 1, "short"), ("b", 1, text), ("b", 1, text), ("c", 1, text), ("c", 2, "")]
    batch = spark.createDataFrame(rows, "doc_key string, nth int, text string").repartition(3)
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    batch.coalesce(1).write.parquet(folder)
    stream = J.file_stream(spark, folder, "*.parquet", batch.schema)
    for _ in range(2):
        J.ingest(stream, base, order=("nth",)).awaitTermination()
        status, _, children = J.ingested(spark, base)
        assert {r.doc_key: r.ingest_status for r in status.collect()} == {"a": "ready", "b": "ready", "c": "failed"} and status.count() == 3
        keys = [r.chunk_id for r in children.collect()]
        assert len(keys) == len(set(keys)) and any("The last version." in r.text for r in children.filter("doc_key = 'a'").collect())
        found = sorted((r.doc_key, r.state) for r in J.ingest_log(spark, base).collect())
        # The batch is replayed: its commit is taken back, its rows stay.
        for f in (tmp_path / "out" / "checkpoint" / "commits").glob("*0*"):
            f.unlink()
    assert found == [("a", "pending"), ("a", "processing"), ("a", "ready"), ("b", "pending"), ("b", "processing"), ("b", "ready"), ("c", "failed"), ("c", "pending")]


def test_a_document_that_arrives_again_replaces_its_chunks(spark, tmp_path):
    long = "Built the billing service and ran its migration without an outage. " * 20
    folder, base = tmp_path / "in", str(tmp_path / "out")
    for n, rows in enumerate([[("a", long), ("b", long), ("c", "short")], [("a", long + "Second version of this text."), ("b", "")]]):
        spark.createDataFrame(rows, "doc_key string, text string").coalesce(1).write.parquet(str(folder / f"n{n}"))
    stream = spark.readStream.schema("doc_key string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    J.ingest(stream, base).awaitTermination()
    status, parents, children = J.ingested(spark, base)
    states = {r.doc_key: r.states for r in J.ingest_log(spark, base).groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("batch", "step", "state"))).alias("states")).collect()}
    assert [s["state"] for s in states["a"]] == ["pending", "processing", "ready"] * 2
    assert [s["state"] for s in states["b"]] == ["pending", "processing", "ready", "pending", "failed"] and [s["state"] for s in states["c"]] == ["pending", "failed"]
    assert {r.doc_key: r.state for r in J.ingest_states(spark, base).collect()} == {"a": "ready", "b": "failed", "c": "failed"}
    assert {r.doc_key: (r.ingest_status, r.chunk_count > 0) for r in status.collect()} == {"a": ("ready", True), "b": ("failed", False), "c": ("failed", False)}
    assert {r.doc_key for r in parents.collect()} == {"a"} == {r.doc_key for r in children.collect()}
    assert any("Second version" in r.text for r in children.collect()) and len(children.first().vec) == 384


def test_a_stream_reads_a_table_that_is_one_file_or_a_folder(spark, tmp_path):
    from gapmatch.streaming import jobs as J

    rows = spark.range(10)
    rows.repartition(3).write.parquet(f"{tmp_path}/many/t.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one/t.parquet")
    for kind in ("many", "one"):
        stream = J.file_stream(spark, f"{tmp_path}/{kind}", "t.parquet", rows.schema)
        J.start(stream, J.into(f"{tmp_path}/{kind}-out"), f"{tmp_path}/{kind}-base").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/{kind}-out").count() == 10
