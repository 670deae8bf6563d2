import pytest
from pyspark.sql import functions as F

from claimgrain import dims
from claimgrain.operators import answers, audit, safety

CASE = ("struct<age_range:string,indications:array<string>,contraindications:array<string>,"
        "current_medications:array<string>,baseline_labs:map<string,string>,notes:string>")
LABS = {"IGF-1": "180"}


def case(contra=(), meds=(), labs=LABS, notes=None, indications=("tendon injury",)):
    return ("40-49", list(indications), list(contra), list(meds), labs, notes)


def codes(spark, query, case=None, mention=False):
    df = spark.createDataFrame([(1, query, case, mention)],
                               f"request_id int, query string, case {CASE}, chunks_mention boolean")
    return [f.code for f in safety.evaluate(df).collect()[0]["flags"]]


@pytest.mark.parametrize("query, patient, mention, want", [
    ("dosing of BPC-157?", None, False, []),
    ("Is it safe in PREGNANCY?", None, False, ["SR-001"]),
    ("dosing", case(["pregnant"]), False, ["SR-001"]),
    ("dosing", case(["breastfeeding"]), False, ["SR-001"]),
    ("dosing", case(notes="second trimester"), False, ["SR-001"]),
    ("IGF-1 with a malignancy?", None, False, ["SR-002"]),
    ("dosing", case(["malignancy history"]), True, ["SR-002"]),
    ("dosing", case(["malignancy history"]), False, []),
    ("Selank dosing", case(["cancer"]), False, []),
    ("dosing", case(labs={}), False, ["SR-003"]),
    ("dosing", case(labs=None), False, ["SR-003"]),
    ("dosing", case(meds=["a", "b"]), False, []),
    ("dosing", case(meds=["a", "b", "c"]), False, ["SR-004"]),
    ("cjc-1295 pregnant", case(["tumour"], ["a", "b", "c"], {}), False,
     ["SR-001", "SR-002", "SR-003", "SR-004"]),
])
def test_rules(spark, query, patient, mention, want):
    assert codes(spark, query, patient, mention) == want


def test_medication_count_in_message(spark):
    df = spark.createDataFrame([("q", case(meds=list("abcd")), None)],
                               f"query string, case {CASE}, chunks_mention boolean")
    flag = safety.evaluate(df).collect()[0]["flags"][0]
    assert flag.severity == "info" and "on 4 medications" in flag.message


def test_mentions_growth(spark):
    chunks = spark.createDataFrame([("a", "plain"), ("a", "with Ipamorelin"), ("b", "plain")],
                                   "query_id string, content string")
    got = {r.query_id: r.chunks_mention for r in safety.mentions_growth(chunks).collect()}
    assert got == {"a": True, "b": False}


def test_access_gate(spark):
    df = spark.createDataFrame([(1, False, "researcher", False), (2, True, "clinician", False),
                                (3, True, "researcher", True), (4, True, "admin", True)],
                               "request_id int, restricted boolean, role string, enabled boolean")
    gated = safety.access_gate(df, F.col("enabled"))
    assert [r.decision for r in gated.orderBy("request_id").collect()] == ["allow", "deny", "deny", "allow"]
    log = audit.gate_events(gated, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert sorted(r.request_id for r in log) == [2, 3]


CHUNK = ("query_id string, rank int, chunk_id string, document_id string, source_name string, "
         "source_url string, evidence_tier int, content string")


def ranked(spark, *rows):
    return spark.createDataFrame([("q", i + 1, *r) for i, r in enumerate(rows)], CHUNK)


def test_citations_one_per_document(spark):
    df = ranked(spark, ("c1", "d1", "A", "u", 1, "x" * 400), ("c2", "d1", "A", "u", 1, "b"),
                ("c3", "", "B", None, 4, " line\nbreak "))
    got = answers.citations(df).orderBy("number").collect()
    assert [(r.number, r.source_id, r.chunk_id) for r in got] == [(1, "d1", "c1"), (2, "c3", "c3")]
    assert got[0].excerpt == "x" * 300 + "\u2026" and got[1].excerpt == "line break"
    block = answers.sources_block(answers.citations(df)).collect()[0]
    assert block.sources == "\n\n**Sources:**\n[1] A \u2014 u\n[2] B" and block.n_citations == 2


def test_citation_integrity(spark):
    df = spark.createDataFrame([("see [1] and [3][3]", 2), ("none", 0), ("[1] [2]", 2)],
                               "answer string, n_citations int")
    got = [(list(r.orphaned), list(r.unused)) for r in answers.citation_integrity(df).collect()]
    assert got == [([3], [2]), ([], []), ([], [])]


def test_one_aggregate_equals_its_parts(spark):
    df = ranked(spark, ("c1", "d1", "A", "u", 1, "one IGF-1"), ("c2", "d1", "A", "u", 1, "two"),
                ("c3", "d2", "B", None, 4, "three"))
    whole = answers.evidence_per_query(df).collect()[0]
    assert whole.context == answers.context_block(df).collect()[0].context
    assert whole.sources == answers.sources_block(answers.citations(df)).collect()[0].sources
    assert whole.evidence_summary == answers.evidence_summary(df).collect()[0].evidence_summary
    assert whole.confidence == answers.confidence(df).collect()[0].confidence
    assert (whole.tiers, whole.chunks_mention, whole.n_citations) == ("1,4", True, 2)
    assert whole.context.startswith("[Source 1] (Tier 1, A)\none IGF-1\n\n[Source 2]")


def test_answer_without_evidence(spark):
    requests = spark.createDataFrame([(1, "none", "What?", "clinician", None)],
                                     f"request_id int, query_id string, query string, role string, case {CASE}")
    evidence = answers.evidence_per_query(ranked(spark, ("c", "d", "A", None, 1, "x")))
    row = answers.batch_answers(requests, evidence, "Tool").collect()[0]
    assert dims.NO_CONTEXT in row.answer and row.confidence == 0.0 and row.label == "insufficient"
    assert row.evidence_summary == dims.NO_EVIDENCE and row.n_citations == 0
    assert row.disclaimer.startswith("This response is generated by Tool,")


def test_critical_flag_escalates_disclaimer(spark):
    requests = spark.createDataFrame([(1, "q", "pregnant?", "clinician", None)],
                                     f"request_id int, query_id string, query string, role string, case {CASE}")
    evidence = answers.evidence_per_query(ranked(spark, ("c", "d", "A", None, 1, "x")))
    row = answers.batch_answers(requests, evidence).collect()[0]
    assert row.disclaimer.startswith(dims.CRITICAL_NOTICE)
    assert row.answer.endswith("**Sources:**\n[1] A")


def test_recommendations(spark):
    raw = "\n".join(["intro", "- short", "- first long recommendation", "  * second long recommendation",
                     "\u2022 third long recommendation", "\u2192 fourth long recommendation",
                     "-no space after the dash", "- fifth long recommendation", "- sixth long recommendation"])
    df = spark.createDataFrame([(raw,)], "a string")
    got = df.select(answers.recommendations(F.col("a")).alias("r")).collect()[0]["r"]
    assert got == [f"{n} long recommendation" for n in ["first", "second", "third", "fourth", "fifth"]]


def test_prompt_body(spark):
    df = spark.createDataFrame([("q1", case(indications=[])), ("q2", None)], f"query string, case {CASE}")
    rows = df.select(answers.prompt_body(F.col("query"), F.lit("CTX"), F.col("case")).alias("p")).collect()
    assert rows[0].p == ("Clinical Query: q1\n\nPatient Context (de-identified):\n  Age range: 40-49\n"
                         "  Indications: none\n  Contraindications: none\n\n\nEvidence Context:\nCTX")
    assert rows[1].p == "Clinical Query: q2\n\nEvidence Context:\nCTX"


def test_condition_flags_and_low_tier(spark):
    df = spark.createDataFrame([(1, "IGF-1?", case(["Pregnancy ", "asthma"])), (2, "other", case(["pregnancy"]))],
                               f"request_id int, query string, case {CASE}")
    assert [tuple(r) for r in safety.condition_flags(df).collect()] == [(1, "pregnancy", "critical")]
    low = safety.low_tier_only(spark.createDataFrame([("a", 4), ("a", 5), ("b", 1), ("b", 5)],
                                                     "query_id string, evidence_tier int"))
    assert {r.query_id: r.low_tier_only for r in low.collect()} == {"a": True, "b": False}
