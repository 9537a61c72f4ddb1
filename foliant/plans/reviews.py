"""The composed flows over papers with nested reviews and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import ranking, reconcile, stats
from ..operators.clean import clean_messages, route_messages
from ..sources import readers

CHOSEN = ("core", "adjacent")
#: The most entries that a model result's lists keep.
LIMITS = {"research_tags": 12, "positive_factors": 5, "negative_factors": 8, "response_outcomes": 8, "counterfactuals": 3}


# Topic classification ------------------------------------------------------------------
def classify_papers(papers: DataFrame) -> DataFrame:
    """``papers`` with tier, tags and relevance score for agents and education.

    Tags in the title, the keywords and the body count 5, 3 and 1 (core) or 3, 2
    and 1 (adjacent).  Without an education context, some core tags and those in
    the body alone do not count; distillation papers lose weak education tiers.
    """
    body = F.concat_ws(" || ", *[text.or_empty(c) for c in ("abstract", "tldr", "primary_area")])
    df = papers.withColumns({"_t": text.or_empty("title"), "_k": F.concat_ws(" || ", F.coalesce("keywords", F.array().cast("array<string>"))), "_b": body})
    df = df.withColumn("_all", F.concat_ws(" || ", "_t", "_k", "_b"))
    fields = ("_t", "_k", "_b")
    packs = {"ac": rules.AGENT_CORE, "aa": rules.AGENT_ADJACENT, "ec": rules.EDUCATION_CORE, "ea": rules.EDUCATION_ADJACENT}
    df = df.withColumns({f"{p}{f}": rules.tags(f, pack) for p, pack in packs.items() for f in fields})
    context, distilled = rules.matches("_all", rules.EDUCATION_CONTEXT), rules.matches("_all", rules.DISTILLATION)
    merged = lambda p: F.array_sort(F.array_distinct(F.concat(*[F.col(f"{p}{f}") for f in fields])))
    df = df.withColumns({"_ctx": context, "_dis": distilled, "_some": F.arrays_overlap(merged("ec"), F.array(F.lit("education"), F.lit("tutoring")))})
    gone = F.array(*map(F.lit, rules.CONTEXT_TAGS))
    weak = ~F.col("_ctx") | (F.col("_dis") & ~F.col("_some"))
    df = df.withColumns({f"ec{f}": F.when(weak, F.array_except(f"ec{f}", gone)).otherwise(F.col(f"ec{f}")) for f in fields})
    df = df.withColumn("ea_b", F.when(F.col("_ctx"), F.col("ea_b")).otherwise(F.array().cast("array<string>")))
    score = lambda p, weights: sum((F.size(f"{p}{f}") * w for f, w in zip(fields, weights, strict=True)), F.lit(0)).cast("long")
    df = df.withColumns({"sac": score("ac", (5, 3, 1)), "saa": score("aa", (3, 2, 1)), "sec": score("ec", (5, 3, 1)), "sea": score("ea", (3, 2, 1))})
    some = lambda *ps: sum((F.size(f"{p}{f}") for p in ps for f in fields), F.lit(0)) > 0
    tier = lambda c, a, generic: rules.first_label([(F.col(c) >= 2, "core"), (F.col(a) >= 2, "adjacent"), (generic, "generic")], None)
    df = df.withColumns({"agent_tier": tier("sac", "saa", some("ac", "aa") | rules.matches("_all", rules.GENERIC_AGENT)), "education_tier": tier("sec", "sea", some("ec", "ea"))})
    lost = F.coalesce(F.col("education_tier").isin("adjacent", "generic") & F.col("_dis"), F.lit(False))
    df = df.withColumns({
        "agent_tags": F.concat(merged("ac"), merged("aa")), "agent_relevance_score": F.col("sac") + F.col("saa"),
        "education_tags": F.concat(merged("ec"), F.when(lost, F.array().cast("array<string>")).otherwise(merged("ea"))),
        "education_relevance_score": F.col("sec") + F.col("sea"), "education_tier": F.when(~lost, F.col("education_tier")),
        "paper_type": rules.paper_type("title", "abstract"),
    })
    # One generated row: filters on the labels stay above the chain of pattern tests
    # instead of repeating it for each use of a tag.
    made = ("agent_tier", "agent_tags", "agent_relevance_score", "education_tier", "education_tags", "education_relevance_score", "paper_type")
    kept = [c for c in papers.columns if c not in made]
    return df.select(*kept, F.explode(F.array(F.struct(*made))).alias("_made")).select(*kept, "_made.*")


def chosen(tier: str) -> Column:
    """Whether a tier or relevance is core or adjacent; null is not."""
    return F.coalesce(F.col(tier).isin(*CHOSEN), F.lit(False))


def priority_records(papers: DataFrame) -> DataFrame:
    """Main-track papers with a tier, the first of each id, with ``place`` in report order."""
    df = readers.main_track(papers).withColumn("openreview_id", readers.paper_id()).where("coalesce(openreview_id, '') <> ''")
    df = classify_papers(df).where("agent_tier is not null or education_tier is not null")
    df = ranking.best_per_key(df, ["openreview_id"], [F.asc("year"), F.asc("path")])
    url = text.first_filled("openreview_url", F.concat(F.lit("https://openreview.net/forum?id="), F.col("openreview_id")))
    authors = F.coalesce("authors", F.array().cast("array<struct<name:string,affiliations:array<string>>>"))
    places = F.flatten(F.transform(authors, lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>"))))
    df = df.withColumns({
        "openreview_url": url, "author_names": F.transform(F.filter(authors, lambda a: text.or_empty(a["name"]) != ""), lambda a: a["name"]),
        "affiliations": F.array_sort(F.array_distinct(places)), "selected": chosen("agent_tier") | chosen("education_tier"),
    })
    return df


def screened(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Records joined to their model labels, with the route flags; unknown ids raise."""
    known = records.withColumn("_known", F.lit(True))
    df = labels.select(
        "openreview_id", rules.relevance("agent_relevance").alias("luna_agent_relevance"), rules.relevance("education_relevance").alias("luna_education_relevance"),
        ranking.truncated("agent_tags", 6).alias("luna_agent_tags"), ranking.truncated("education_tags", 6).alias("luna_education_tags"), F.substring(text.or_empty("rationale"), 1, 400).alias("luna_rationale"),
    ).join(known, "openreview_id", "left")
    df = df.where(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown id: "), "openreview_id")).cast("boolean")).otherwise(True)).drop("_known")
    agent, education = chosen("agent_tier") & chosen("luna_agent_relevance"), chosen("education_tier") & chosen("luna_education_relevance")
    core = lambda c: F.col(c) == "core"
    return df.withColumns({
        "agent": agent, "education": education, "intersection": agent & education,
        "agent_core": agent & core("luna_agent_relevance"), "education_core": education & core("luna_education_relevance"),
        "intersection_core": agent & education & core("luna_agent_relevance") & core("luna_education_relevance"),
        "luna_only_agent": ~chosen("agent_tier") & chosen("luna_agent_relevance"), "luna_only_education": ~chosen("education_tier") & chosen("luna_education_relevance"),
        "rejected": ~agent & ~education,
    })


# Message filter ------------------------------------------------------------------------
def filtered_papers(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, report): each main-track paper's messages with their routes, and one
    row for each paper with counts, token estimates and ``python_only``."""
    main = readers.main_track(papers).withColumn("paper", readers.paper_id())
    said = readers.discussion(main)
    cleaned = clean_messages(said.select("paper", "msg", "text")).join(said, ["paper", "msg"])
    routes = route_messages(cleaned).withColumns({"reviewer_id": text.last_part("signature"), "evidence_excerpt": text.excerpt("cleaned", 800)})
    count = lambda r: F.count_if(F.col("route") == r)
    per = routes.groupBy("paper").agg(
        count("reminder").alias("dropped_reminders"), count("nudge").alias("dropped_author_nudges"), count("local_event").alias("locally_classified_comments"),
        count("discussion").alias("discussion"), *[F.sum(c).alias(c) for c in ("quoted_lines", "table_lines", "reference_blocks", "duplicate_paragraphs", "courtesy_paragraphs", "truncated")],
        F.sum(text.token_estimate("text")).alias("tokens_before"), F.sum(F.when(F.col("route") == "discussion", text.token_estimate("cleaned")).otherwise(0)).alias("tokens_after"),
    )
    counted = (("reviews", "review_count"), ("rebuttals", "rebuttal_count"), ("reviewer_comments", "reviewer_comment_count"))
    sizes = main.select("paper", *[F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(n) for c, n in counted])
    report = sizes.join(per, "paper", "left").na.fill(0)
    return routes, report.withColumn("python_only", F.expr("review_count + discussion + locally_classified_comments = 0"))


# Model results -------------------------------------------------------------------------
def normalized_results(items: DataFrame, local_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, outcomes): one result for each id, lists cut to their limits with flags,
    values normalised beside their raw ones, and local events merged into the outcomes."""
    kept = ranking.keep_most_complete(items, "openreview_id", list(LIMITS), "ordinal")
    kept = kept.withColumns({f"{c}_violation": ranking.too_long(c, n) for c, n in LIMITS.items()})
    kept = kept.withColumns({c: ranking.truncated(c, n) for c, n in LIMITS.items()})
    kept = kept.withColumns({
        "response_outcomes": reconcile.with_raw("response_outcomes", {"effectiveness": rules.effectiveness, "score_action": rules.normalized_action}),
        "counterfactuals": reconcile.with_raw("counterfactuals", {"evidence_grade": rules.grade}),
        "research_tags": F.filter(F.transform("research_tags", text.strip), lambda x: x != ""),
    })
    outcomes = kept.select(F.col("openreview_id").alias("paper"), F.posexplode("response_outcomes").alias("pos", "o")).select("paper", "pos", "o.reviewer_id", "o.effectiveness", "o.score_action", "o.confidence")
    return kept, reconcile.merge_events(outcomes, local_events)


# Archetypes ----------------------------------------------------------------------------
def review_facts(papers: DataFrame, memberships: DataFrame) -> DataFrame:
    """A row for each (archetype, paper, reviewer): the last review of a reviewer counts.

    ``memberships``: openreview_id, domains, tags (model tags that routing reads).
    """
    df = papers.withColumn("openreview_id", readers.paper_id()).join(memberships, "openreview_id")
    df = df.withColumn("search", text.search_text("title", "abstract", F.concat_ws(" ", "tags")))
    df = reconcile.routed(df, rules.ARCHETYPES, rules.FALLBACK)
    rows = df.select("archetype", F.col("openreview_id").alias("paper"), "title", "year", "accepted_main", F.posexplode_outer("reviews").alias("pos", "r"))
    rows = rows.withColumn("reviewer", F.when(F.col("r").isNotNull(), F.coalesce("r.reviewer_id", F.lit("None"))))
    same = W.partitionBy("archetype", "paper", "reviewer")
    rows = rows.withColumns({"_last": F.max("pos").over(same), "place": F.min("pos").over(same)}).where("pos is null or pos = _last")
    join = lambda *names: text.joined_fields(*[F.col(f"r.{n}_text") for n in names])
    rows = rows.withColumns({
        "negative": join("weaknesses", "questions", "soundness", "presentation", "contribution"), "positive": join("strengths"),
        "words": text.word_count(join("summary", "strengths", "weaknesses", "questions")), "rating": F.col("r.rating"), "confidence": F.col("r.confidence"),
    })
    return rows.withColumns({"concerns": rules.tags("negative", rules.CONCERNS), "positives": rules.tags("positive", rules.POSITIVES)}).drop("r", "pos", "_last")


def archetype_summary(facts: DataFrame) -> DataFrame:
    """Counts, mean words, confidence label and held-out coverage of each archetype."""
    reviewed = F.col("reviewer").isNotNull()
    base = facts.groupBy("archetype").agg(
        F.count_distinct("paper").alias("paper_count"), F.count_distinct(F.when(F.col("accepted_main"), F.col("paper"))).alias("accepted_paper_count"),
        F.count_if(reviewed).alias("review_count"), F.count_if(reviewed & (F.col("year") == 2024)).alias("training_reviews"),
        F.coalesce(F.bround(F.avg(F.when(reviewed, F.col("words"))), 1), F.lit(0.0)).alias("average_review_words"),
    )
    tags = facts.select("archetype", "year", F.concat_ws("/", "paper", F.lpad(F.coalesce("place", F.lit(0)).cast("string"), 6, "0")).alias("o"), F.explode("concerns").alias("tag"))
    tops = stats.top_tags_by_phase(tags, "year", "tag", "o", 8, ["archetype"])
    year = lambda y: F.flatten(F.collect_list(F.when(F.col("year") == y, F.col("tags"))))
    by_year = tops.groupBy("archetype").agg(*[year(y).alias(f"y{y}") for y in (2024, 2025, 2026)])
    out = base.join(by_year, "archetype", "left").withColumn("coverage", stats.coverage(F.col("y2026"), F.col("y2024"), F.col("y2025")))
    out = out.withColumn("confidence", rules.confidence_label("training_reviews"))
    return out.withColumn("heldout_status", rules.heldout_status("confidence", "coverage")).drop("y2024", "y2025", "y2026")


def concern_examples(facts: DataFrame, most: int = 3) -> DataFrame:
    """The training examples of each archetype's concerns: surest, longest, first."""
    rows = facts.where("year = 2024").select("archetype", "paper", "reviewer", "place", "confidence", text.excerpt("negative").alias("excerpt"), F.explode("concerns").alias("tag"))
    order = [F.expr("try_cast(regexp_extract(confidence, '^-?[0-9.]+', 0) as double)").desc_nulls_last(), F.length("excerpt").desc(), F.asc("paper"), F.asc("place")]
    return ranking.best_per_key(rows, ["archetype", "tag"], order, most, "rank")


def discussion_events(papers: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts of score actions and resolutions by archetype and year, of comments whose
    signature names one of the paper's reviewers."""
    said = readers.discussion(papers.withColumn("openreview_id", readers.paper_id())).where("kind = 'reviewer_comments'")
    said = said.withColumn("reviewer", text.reviewer_of("signature")).where("reviewer is not null").where(text.strip(text.or_empty("text")) != "")
    said = said.select("paper", "msg", "reviewer", rules.score_action("text").alias("score_action"), rules.resolution("text").alias("concern_resolution"))
    keys = facts.where("reviewer is not null").select("archetype", "paper", "year", "reviewer").distinct()
    return said.join(keys, ["paper", "reviewer"]).groupBy("archetype", "year", "score_action", "concern_resolution").agg(F.count("*").alias("events"))


def identity_audit(papers: DataFrame) -> DataFrame:
    """How many papers each short reviewer id occurs in."""
    rows = papers.select(readers.paper_id().alias("paper"), F.explode("reviews").alias("r")).select("paper", F.coalesce("r.reviewer_id", F.lit("None")).alias("reviewer"))
    return stats.count_of_counts(rows, "reviewer", "paper")


# Public catalogue ----------------------------------------------------------------------
def public_catalog(papers: DataFrame) -> DataFrame:
    """Whitelisted public fields of main-track papers, whose ids must be unique."""
    clean = lambda c: text.normalize_space(text.or_empty(c))
    df = readers.main_track(papers).withColumn("openreview_id", clean("openreview_id"))
    slug = text.first_filled(clean("area_dir"), F.lit("unknown"))
    df = ranking.assert_unique(df, "openreview_id")
    return df.select(
        "year", text.first_filled(clean("primary_area"), clean("area_dir"), F.lit("unknown")).alias("topic"), slug.alias("topic_slug"),
        clean("title").alias("title"), clean("abstract").alias("abstract"), "keywords", "openreview_id", clean("openreview_url").alias("openreview_url"),
    )


def public_activity(manifest: DataFrame, papers: DataFrame, results: DataFrame) -> DataFrame:
    """Public fields of analysed papers: no paths, no outcomes, three tags at most."""
    shown = papers.select(readers.paper_id().alias("openreview_id"), "title", "primary_area", "openreview_url")
    tags = results.select("openreview_id", F.filter(F.transform("research_tags", text.tag_name), lambda x: x != "").alias("research_tags"))
    df = manifest.select("openreview_id", "year").join(shown, "openreview_id", "left").join(tags, "openreview_id", "left")
    return df.select(
        "openreview_id", "year", text.first_filled("title", "openreview_id").alias("title"), text.first_filled("primary_area", F.lit("unknown")).alias("primary_topic"),
        text.first_filled("openreview_url", F.concat(F.lit("https://openreview.net/forum?id="), F.col("openreview_id"))).alias("openreview_url"), ranking.truncated("research_tags", 3).alias("research_tags"),
    )


def completed_profiles(evidence: DataFrame, generated: DataFrame) -> DataFrame:
    """Archetypes with their generated texts: defaults where missing, lists and prompt capped."""
    #: The most entries of each list.
    caps = {"priority_checks": 8, "positive_signals": 6, "common_rejection_reasons": 8, "rebuttal_update_conditions": 6, "questions_to_ask": 8, "limitations": 5}
    df = evidence.join(generated, "archetype", "left")
    df = df.withColumns({c: ranking.truncated(c, n) for c, n in caps.items()})
    return df.withColumns({"review_stance": text.first_filled("review_stance", F.lit("Evidence-grounded specialist review.")), "system_prompt": F.substring(text.or_empty("system_prompt"), 1, 5000)})
