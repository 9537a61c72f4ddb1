"""The composed flows on a few invented papers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans import reviews
from foliant.sources import readers

REVIEWS = [
    {"reviewer_id": "r1", "rating": "3", "confidence": "4", "weaknesses_text": "Missing baseline comparison", "strengths_text": "novel", "summary_text": "one two"},
    {"reviewer_id": "r1", "rating": "6", "confidence": "5", "weaknesses_text": "unclear writing", "strengths_text": "clear", "summary_text": "one two three"},
    {"reviewer_id": "r2", "rating": None, "confidence": "x", "weaknesses_text": "no ablation"},
]
PAPERS = [
    {"openreview_id": "a", "year": 2024, "track": "main", "title": "An LLM agent benchmark", "abstract": "agentic tool", "keywords": ["x"], "accepted_main": True, "reviews": REVIEWS, "path": "1",
     "rebuttals": [{"id": "m0", "comment": "> old\nWe add an ablation."}], "reviewer_comments": [{"id": "m1", "signature": "x/Reviewer_r1", "comment": "I raised my score."}, {"id": "m2", "signature": "x/Reviewer_zz", "comment": "last day"}]},
    {"openreview_id": "", "forum": "b", "year": 2026, "track": "main", "title": "Intelligent tutoring for students", "area_dir": "edu", "primary_area": "Education  X", "reviews": REVIEWS[2:], "path": "2"},
    {"openreview_id": "c", "year": 2025, "track": "main", "title": "Knowledge distillation with student network", "abstract": "student learning", "path": "3"},
    {"openreview_id": "w", "year": 2025, "track": "workshop", "title": "agentic", "path": "4"},
    {"openreview_id": "d", "year": 2025, "track": "main", "title": "About agents", "path": "5"},
]


@pytest.fixture(scope="module")
def papers(spark):
    fields = [f for f in readers.PAPER_TYPE.fields if f.name not in ("keywords", "_corrupt_record")]
    schema = T.StructType([*fields, T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("path", T.StringType())])
    return spark.createDataFrame([{f.name: p.get(f.name) for f in schema.fields} for p in PAPERS], schema)


@pytest.mark.parametrize(("title", "abstract", "agent", "education"), [
    ("LLM agents", "", "core", None), ("Multi-agent learning", "", "adjacent", None), ("agents", "", "generic", None),
    ("Tutoring systems", "", None, "core"), ("Knowledge tracing", "", None, None), ("Knowledge tracing for students", "", None, "core"),
    ("Pure maths", "student learning", None, "generic"), ("Student misconceptions in school", "", None, "adjacent"), ("Teacher model", "student assessment", None, None),
])
def test_tiers(spark, title, abstract, agent, education):
    df = spark.createDataFrame([(title, abstract, None, None, None)], "title string, abstract string, tldr string, primary_area string, keywords array<string>")
    r = reviews.classify_papers(df).first()
    assert (r["agent_tier"], r["education_tier"]) == (agent, education)


def test_priority_and_screening(spark, papers):
    records = reviews.priority_records(papers)
    got = {r["openreview_id"]: (r["agent_tier"], r["education_tier"], r["selected"]) for r in records.collect()}
    assert got == {"a": ("core", None, True), "b": (None, "core", True), "d": ("generic", None, False)}
    labels = spark.createDataFrame([("a", "Core", "no", None, None, "x" * 500), ("d", "direct", None, ["t"] * 9, None, None)], "openreview_id string, agent_relevance string, education_relevance string, agent_tags array<string>, education_tags array<string>, rationale string")
    rows = {r["openreview_id"]: r for r in reviews.screened(records, labels).collect()}
    assert rows["a"]["agent_core"] and not rows["a"]["intersection"] and len(rows["a"]["luna_rationale"]) == 400
    assert rows["d"]["luna_only_agent"] and rows["d"]["rejected"] and len(rows["d"]["luna_agent_tags"]) == 6
    with pytest.raises(Exception, match="unknown id"):
        reviews.screened(records, labels.withColumn("openreview_id", F.lit("zz"))).collect()


def test_filter_flow(papers):
    routes, report = reviews.filtered_papers(papers)
    got = {(r["paper"], r["msg"]): r["route"] for r in routes.collect()}
    assert got == {("a", 0): "discussion", ("a", 1): "local_event", ("a", 2): "reminder"}
    per = {r["paper"]: r for r in report.collect()}
    assert (per["a"]["quoted_lines"], per["a"]["locally_classified_comments"], per["a"]["python_only"]) == (1, 1, False)
    assert per["c"]["python_only"] and not per["b"]["python_only"] and "w" not in per


def test_archetypes(spark, papers):
    members = spark.createDataFrame([("a", ["agent"], ["memory"]), ("b", ["education"], None), ("c", ["cross"], None)], "openreview_id string, domains array<string>, tags array<string>")
    facts = reviews.review_facts(papers, members)
    got = {(r["archetype"], r["paper"], r["reviewer"]): r for r in facts.collect()}
    one = got["agent_memory_planning", "a", "r1"]
    assert one["rating"] == "6" and one["concerns"] == ["clarity_presentation"] and one["words"] == 6 and one["place"] == 0
    assert ("education_tutoring_pedagogy", "b", "r2") in got and ("cross_assessment_content", "c", None) in got
    rows = {r["archetype"]: r for r in reviews.archetype_summary(facts).collect()}
    assert (rows["agent_eval_benchmark"]["review_count"], rows["agent_eval_benchmark"]["confidence"]) == (2, "low")
    assert (rows["education_tutoring_pedagogy"]["coverage"], rows["education_tutoring_pedagogy"]["heldout_status"]) == (0.0, "insufficient_training")
    assert {r["tag"] for r in reviews.concern_examples(facts).collect()} == {"clarity_presentation", "ablation_mechanism"}
    events = reviews.discussion_events(papers, facts).where("archetype = 'agent_memory_planning'").collect()
    assert [(r["score_action"], r["events"]) for r in events] == [("increased", 1)]
    assert {(r["members"], r["n_keys"]) for r in reviews.identity_audit(papers).collect()} == {(1, 1), (2, 1)}


def test_results_catalog_activity_profiles(spark, papers):
    item = readers.RESULT_TYPE
    rows = [
        {"openreview_id": "a", "research_tags": ["t"] * 14, "response_outcomes": [{"reviewer_id": "Reviewer_r1", "effectiveness": "strong", "score_action": "raised", "confidence": 0.5}], "counterfactuals": [{"evidence_grade": "b"}]},
        {"openreview_id": "a", "research_tags": None, "response_outcomes": None},
    ]
    items = spark.createDataFrame([{f.name: r.get(f.name) for f in item.fields} for r in rows], item).withColumn("ordinal", F.monotonically_increasing_id())
    events = spark.createDataFrame([("a", 0, "r1", "m1", "I raised my score. All of my concerns are resolved")], "paper string, ord int, reviewer_id string, source_message_id string, evidence string")
    kept, merged = reviews.normalized_results(items, events)
    r = kept.collect()
    assert len(r) == 1 and r[0]["research_tags_violation"] and len(r[0]["research_tags"]) == 12 and r[0]["counterfactuals"][0]["evidence_grade"] == "B"
    m = merged.collect()
    assert [(x["score_action"], x["effectiveness"], x["local_reconciled"], x["source_message_id"]) for x in m] == [("increased", "strong_success", True, "m1")]
    catalog = reviews.public_catalog(papers.where("openreview_id <> ''")).collect()
    assert [c["topic_slug"] for c in catalog] == ["unknown"] * 3
    manifest = spark.createDataFrame([("a", 2024, "secret"), ("q", 2025, "s")], "openreview_id string, year int, path string")
    results = spark.createDataFrame([("a", ['"agent"', '{"name":"edu"}', "{}", '"x"', '"y"'])], "openreview_id string, research_tags array<string>")
    shown = {r["openreview_id"]: r.asDict() for r in reviews.public_activity(manifest, papers, results).collect()}
    assert shown["a"]["research_tags"] == ["agent", "edu", "x"] and "path" not in shown["a"]
    assert shown["q"]["title"] == "q" and shown["q"]["research_tags"] is None
    made = spark.createDataFrame([("p", ["c"] * 9)], "archetype string, priority_checks array<string>")
    for c in ("positive_signals", "common_rejection_reasons", "rebuttal_update_conditions", "questions_to_ask", "limitations"):
        made = made.withColumn(c, F.lit(None).cast("array<string>"))
    made = made.withColumns({"review_stance": F.lit(""), "system_prompt": F.lit("s" * 6000)})
    p = reviews.completed_profiles(spark.createDataFrame([("p",)], "archetype string"), made).first()
    assert len(p["priority_checks"]) == 8 and len(p["system_prompt"]) == 5000 and p["review_stance"].startswith("Evidence")
