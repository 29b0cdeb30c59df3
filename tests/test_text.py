import pytest
from helpers import value

from gapmatch.functions import matching as M
from gapmatch.functions import text as T


def test_tokens_keep_compounds_and_fold_greek(spark):
    assert value(spark, T.tokens, "Ran a CI/CD job in C++ for Node.js") == ["ran", "ci/cd", "job", "in", "c++", "for", "node.js"]
    assert value(spark, T.tokens, "Σχεδιασμός Λόγος") == ["σχεδιασμοσ", "λογοσ"]


def test_keywords_drop_boilerplate_and_keep_order(spark):
    assert value(spark, T.keywords, "Strong knowledge of Kafka and Redis and Kafka") == ["kafka", "redis"]
    assert value(spark, T.keywords, "Άριστη γνώση Java") == ["java"]


@pytest.mark.parametrize("text,expected", [
    ("First item\nSecond item", ["First item", "Second item"]),
    ("Moved the billing jobs to a\nnew cluster.", ["Moved the billing jobs to a new cluster."]),
    ("Worked with\nKafka every day", ["Worked with Kafka every day"]),
    ("TOOLS\nvim and tmux", ["TOOLS", "vim and tmux"]),
    ("one\n\ntwo", ["one", "two"]),
    ("", []),
])
def test_reflow(spark, text, expected):
    assert value(spark, T.reflowed, text) == expected


def test_sentences_keep_short_names_only(spark):
    got = value(spark, T.sentences, "Vue.js\n- we\n- Shipped the search page last spring. ok.")
    assert got == ["Vue.js", "Shipped the search page last spring."]


def test_salient_terms(spark):
    assert value(spark, T.salient_terms, "Hands-on Kafka and (PostgreSQL), plus Full-stack Vue.js.") == ["kafka", "postgresql", "vue.js"]


def test_unspace_repairs_runs_of_four(spark):
    assert value(spark, T.unspace, "P R O F I L E of a b man") == "PROFILE of a b man"
    assert value(spark, T.unspace, "I a m here") == "I a m here"


def test_unspace_changes_only_what_the_rule_matched(spark):
    assert value(spark, T.unspace, "A B C D then A B C D E end") == "ABCD then ABCDE end"
    assert value(spark, T.unspace, "A B C D and ZA B C D") == "ABCD and ZA B C D"
    assert value(spark, T.unspace, "") == ""


def test_language_by_share(spark):
    assert value(spark, T.language, "Εμπειρία σε Java, Docker") == "Greek"
    assert value(spark, T.language, "Java and Docker π") == "English"
    assert value(spark, T.language, "123") == "English"


@pytest.mark.parametrize("word,stem", [("πτυχιου", "πτυχι"), ("δοκιμων", "δοκιμ"), ("ολα", "ολα"), ("kubernetes", "kubernetes")])
def test_greek_stem(spark, word, stem):
    assert value(spark, T.greek_stem, word) == stem


def met(spark, keyword, text):
    return value(spark, lambda k, t: M.any_met(M.needles(T.F.array(k)), M.text_keys(T.tokens(t))), keyword, text)


@pytest.mark.parametrize("keyword,text,expected", [
    ("kafka", "used Kafka daily", True),
    ("cloud", "ran on AWS for years", True),
    ("java", "a Java/Spring shop", True),
    ("python", "a Java/Spring shop", False),
    ("containerisation", "containers everywhere", True),
    ("restful", "a REST service", True),
    ("σχεδιασμο", "σχεδίασα συστήματα", True),
    ("graphql", "REST APIs only", False),
])
def test_matching_rules(spark, keyword, text, expected):
    assert met(spark, keyword, text) is expected


def test_coverage_bounds(spark):
    def cover(a, b):
        return M.coverage(M.needles(T.keywords(a)), M.text_keys(T.tokens(b)))

    assert value(spark, cover, "kafka redis", "Kafka with Redis") == 1.0
    assert value(spark, cover, "kafka redis", "baking bread") == 0.0
    assert value(spark, cover, "of the", "Kafka") == 0.0


def test_routing_and_small_rules(spark):
    assert value(spark, T.intent, "What does the employer want?") == "search_job_description"
    assert value(spark, T.intent, "hello") == "get_match_report"
    assert value(spark, T.company_from, "Acme - Data Engineer", "Data Engineer") == "Acme"
    assert value(spark, T.company_from, "Data Engineer - Remote", "Data Engineer") == ""
    assert value(spark, T.is_achievement, "Designed the whole billing schema for payments") is True
    assert value(spark, T.is_achievement, "Senior Engineer, Acme Ltd (2019-2022) Berlin office") is False
    assert value(spark, lambda t: T.clip(t, 5), "abcdefgh") == "abcd…"
    assert value(spark, T.gap_key, "5+ years of experience") == ""
    assert value(spark, T.gap_key, "Experience with Terraform") == value(spark, T.gap_key, "Terraform or similar") == "terraform"
    assert value(spark, T.requirement_kind, "excellent communication") == "behavioural"
    assert value(spark, T.requirement_kind, "communication in Python reviews") == "evidenceable"
