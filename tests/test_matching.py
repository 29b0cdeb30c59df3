import pytest
from pyspark.sql import functions as F

from gapmatch.operators import evidence as V
from gapmatch.operators import reports as P
from gapmatch.operators import requirements as Q

CV = (
    "CORE SKILLS\nKotlin 1.9 / Java\nSpring Boot\nREST services / SOAP\nGradle . Git\nCI/CD pipelines\n"
    "PROFILE\nBackend developer who specialises in Kotlin/Spring services and messaging.\n"
    "EXPERIENCE\nMoved the old Java billing monolith to Java 17, covering upgrades and checks at runtime.\n"
    "EDUCATION\nMSc in Computer Science\n"
)


def judge(spark, texts, cv=CV, kind="evidenceable"):
    reqs = spark.createDataFrame([("s", str(i), t, "must_have", kind) for i, t in enumerate(texts)],
                                 "scope string, query_id string, text string, category string, kind string")
    passages = spark.createDataFrame([("s", str(i), 1, "c0", "X", 1, cv) for i in range(len(texts))],
                                     "scope string, query_id string, rank int, chunk_id string, section string, page int, text string")
    return reqs, passages


def decisive(spark, text):
    reqs, passages = judge(spark, [text])
    ready = V.armed(reqs, V.idf_table(passages))
    return V.evidence_rows(passages, ready).first().ev


@pytest.mark.parametrize("text", [
    "Good knowledge of Java (17+), the Quarkus ecosystem and clean design",
    "Experience consuming RESTful services", "Micronaut framework (or Spring Boot, willing to move)",
    "Degree in Computer Science or a related field",
])
def test_named_things_the_text_shows_are_found(spark, text):
    ev = decisive(spark, text)
    assert ev.gate and ev.decisive and ev.quote.split()[0] in CV


@pytest.mark.parametrize("text", ["Familiarity with GraphQL APIs", "Experience with Couchbase", "Orchestration (Nomad, Docker)", "Event streams (e.g. Kafka)"])
def test_absent_skills_stay_absent(spark, text):
    assert not decisive(spark, text).decisive


def test_verdicts_cite_verbatim_or_stay_missing(spark):
    reqs, passages = judge(spark, ["Java and Spring Boot services", "Experience with Couchbase", "enjoys clean writing"])
    items = {r.query_id: r for r in V.verify_citations(V.verdicts(reqs, passages), passages).collect()}
    assert items["0"].status == "strong" and items["0"].evidence_quote in " ".join(CV.split())
    assert items["1"].status == "missing" and items["1"].evidence_quote is None and items["1"].evidence_page is None


def test_citation_location(spark):
    rows = [("Moved the old java billing monolith.", "Moved the old Java billing monolith to", "Moved the old Java billing monolith"),
            ("Invented words", "Moved the old Java", None), ("...", "abc", None), ("Σχεδίασα ΤΟ σχήμα.", "Εγώ σχεδίασα το σχήμα, μόνος", "σχεδίασα το σχήμα")]
    df = spark.createDataFrame(rows, "q string, p string, want string")
    for r in df.select("want", V.locate(F.col("q"), F.col("p")).alias("got")).collect():
        assert r.got == r.want


def test_score_weights_and_refusal(spark):
    rows = [("a", 0, "X", "must_have", "evidenceable", "strong", .9, "q"), ("a", 1, "Y", "nice_to_have", "evidenceable", "partial", .5, "q"),
            ("a", 2, "Z", "must_have", "behavioural", "missing", .1, None), ("b", 0, "W", "must_have", "behavioural", "missing", .1, None)]
    items = spark.createDataFrame(rows, "session_id string, order_key int, requirement string, category string, kind string, status string, confidence double, evidence_quote string")
    got = {r.session_id: r for r in P.match_reports(items).collect()}
    assert got["a"].overall_score == 83 and got["a"].verdict == "Strong match" and got["a"].summary.startswith("1 of 2 requirements")
    assert got["b"].overall_score == 0 and got["b"].n_behavioural == 1 and got["b"].must_missing == []
    sessions = spark.createDataFrame([("a",), ("c",)], "session_id string")
    assert [r.session_id for r in P.refused_sessions(sessions, items).collect()] == ["c"]


def test_bullets(spark):
    rows = [("strong", "q", "done", []), ("missing", None, "Built [X] for [Y]", ["[X]", "[Y]"]), ("missing", None, "Built it all", ["[X]", "[Y]"]), ("partial", "q", "Built it", [])]
    df = spark.createDataFrame(rows, "status string, evidence_quote string, bullet string, placeholders array<string>")
    assert [r.refusal for r in P.gate_bullets(df).collect()] == ["already_evidenced", "", "finished_claim", ""]


def extracted(spark, text):
    df = spark.createDataFrame([("d", text)], "doc_key string, text string")
    return [(r.text, r.category, r.kind) for r in Q.extract(df, "doc_key").orderBy("order_index").collect()]


def test_postings(spark):
    got = extracted(spark, "Acme is growing\nRequirements\n- Kotlin\n- Four years of backend work\n- Excellent communication\nNice to have\n- Terraform\n"
                           "What we offer\n- Private insurance and a pension\n")
    assert got == [("Kotlin", "must_have", "evidenceable"), ("Four years of backend work", "must_have", "evidenceable"),
                   ("Excellent communication", "must_have", "behavioural"), ("Terraform", "nice_to_have", "evidenceable")]


def test_posting_without_headings_and_without_requirements(spark):
    assert extracted(spark, "We sell shoes and we like it here very much.\nmarkets go up and down") == []
    got = extracted(spark, "You bring Kotlin together with Postgres tuning\nwe are a happy bunch of people")
    assert [t for t, _, _ in got] == ["You bring Kotlin together with Postgres tuning we are a happy bunch of people"]


def test_posting_dedupe_and_cap(spark):
    lines = "\n".join(f"- Tool{n} operations" for n in range(20))
    got = extracted(spark, "Requirements\n- Kotlin services\n- Services Kotlin\n" + lines)
    assert len(got) == 12 and got[0][0] == "Kotlin services" and got[1][0] == "Tool0 operations"
