"""Driver queries for the review operators themselves, with the domain's own rules.

The driver's texts have none of the domain's words, so each row of a whole table
gets a phrase that does, by its key; the operators then run over all of it.  The
expressions that add them are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import incremental, ranking, reconcile
from ..operators.clean import clean_messages, route_messages
from . import reviews
from .registry import query, t

# Invented phrases that meet the rules, and some that meet none.
PHRASES = (
    "I raised my score after the reply", "I cannot raise the score", "I will raise my rating once this is done", "I keep my score", "I lowered my rating", "All of my concerns are addressed",
    "My concerns were partially addressed but a baseline is missing", "Some of my concerns have been addressed", "Major concerns remain", "Not convinced by the experiment",
    "This is the last day, please actively check the replies", "Could you kindly ask the area chair to update the score", "Looking forward to your response", "Thank you for the kind words", "Dear authors", "The rating remains", "Plain words only",
)
VALUES = (
    "No reaction", "low-partial", "Moderate effect", "ineffective", "Concerns remain", "High", "substantial gain", "a", "D", "speculative", "limited claim", "controlled", "large empirical study", "medium", "theory",
    "will raise", "overall maintained, raised once", "raised", "updated_score", "kept", "lowered", "central", "direct", "adjacent topic", "none",
)
TITLES = ("A survey of LLM agents", "Multi-agent planning", "Agents at work", "An intelligent tutoring system", "Knowledge tracing", "A theorem about graphs", "Teacher model benchmark", "Plain methods")
ABSTRACTS = ("agentic workflow in a classroom", "student learning and student performance", "knowledge distillation with a student network", "web agents with tools", "nothing of note", "personalized education for learners, automated grading")
KEYWORDS = ("embodied agent", "education", "student misconception", "vision")


def pick(values: tuple[str, ...], number: str) -> str:
    """SQL of the value that a number chooses."""
    return f"CASE ({number}) % {len(values)} {' '.join(f'''WHEN {k} THEN '{v}' ''' for k, v in enumerate(values))} END"


def has(value: str, pattern: str, flags: str = "(?i)") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({value}, '{flags}{quoted}')"


def space(value: str) -> str:
    return rf"trim(regexp_replace({value}, '\s+', ' ', 'g'))"


def cases(order: list[tuple[str, str]], default: str) -> str:
    return f"CASE {' '.join(f'''WHEN {test} THEN '{label}' ''' for test, label in order)} ELSE {default} END"


def action_sql(v: str) -> str:
    return cases([(has(v, p, ""), label) for p, label in rules.SCORE_ACTIONS], "'unknown'")


def resolution_sql(v: str) -> str:
    partial = has(v, rules.PARTIAL, "")
    return cases([(f"{partial} AND {has(v, rules.RESIDUAL, '')}", "partial"), (has(v, rules.UNRESOLVED, ""), "unresolved"), (partial, "partial"), (has(v, rules.RESOLVED, ""), "resolved")], "'unknown'")


def terms_sql(v: str, order, default: str) -> str:
    return cases([(" OR ".join(f"contains({v}, '{x}')" for x in terms), label) for terms, label in order], f"'{default}'")


SAID = f"{pick(PHRASES, 'conv_id * 7 + turn')} || '. ' || coalesce(text, '')"
LOWER = f"lower({space('said')})"


@query(f"SELECT conv_id, turn, {action_sql('v')} AS action, {resolution_sql('v')} AS resolution FROM (SELECT *, {LOWER} AS v FROM (SELECT conv_id, turn, {SAID} AS said FROM conversations))")
def message_labels(spark, d):
    """Score action and resolution of every message."""
    said = t(spark, d, "conversations").select("conv_id", "turn", F.expr(SAID).alias("said"))
    return said.select("conv_id", "turn", rules.score_action("said").alias("action"), rules.resolution("said").alias("resolution"))


ROUTES = cases([
    ("said = ''", "empty"), (f"review AND {has('said', rules.REMINDER_TERMS)} AND NOT {has('said', rules.SCORE_TERMS)}", "reminder"),
    (f"NOT review AND {has('said', rules.AUTHOR_NUDGE, '(?is)')} AND NOT {has('said', rules.CONTENT_TERMS)}", "nudge"),
    (f"review AND ({action_sql('v')} <> 'unknown' OR {resolution_sql('v')} <> 'unknown')", "local_event"),
], "'discussion'")


@query(f"SELECT conv_id, turn, {ROUTES} AS route FROM (SELECT *, {LOWER} AS v FROM (SELECT conv_id, turn, role = 'user' AS review, {SAID} AS said FROM conversations))")
def message_routes(spark, d):
    """The route of every message."""
    kind = F.when(F.col("role") == "user", "reviewer_comments").otherwise("rebuttals").alias("kind")
    said = t(spark, d, "conversations").select("conv_id", "turn", kind, F.expr(SAID).alias("cleaned"))
    return route_messages(said).select("conv_id", "turn", "route")


MESSAGE = f"""CASE WHEN turn % 3 = 0 THEN '> earlier words' || chr(10) ELSE '' END || {pick(PHRASES, 'conv_id * 7 + turn')} || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10)
 || CASE WHEN conv_id % 2 = 0 THEN '| name | n |' || chr(10) || '|---|---|' || chr(10) || '| a | 1 |' || chr(10) || '> quoted inside' || chr(10) || '| b | 2 |' || chr(10) || 'after' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN turn % 4 = 1 THEN 'References ' || repeat('of a work ', 50) || chr(10) || chr(10) ELSE '' END || CASE WHEN turn % 4 = 2 THEN '[1] x' || chr(10) || '[2] y' || chr(10) || '3. ' || repeat('z ', 300) || chr(10) || chr(10) ELSE '' END
 || CASE WHEN conv_id % 5 = 0 THEN repeat('long ', 3000) || chr(10) || chr(10) ELSE '' END || 'Thanks for reading.'"""
IS_QUOTED = r"regexp_matches(x, '^\s*>')"


@query(rf"""WITH m AS (SELECT conv_id AS paper, turn AS msg, string_split({MESSAGE}, chr(10)) AS ls FROM conversations),
u AS (SELECT paper, msg, len(list_filter(ls, lambda x: {IS_QUOTED}))::BIGINT AS quoted_lines, list_filter(ls, lambda x: NOT {IS_QUOTED}) AS ls FROM m),
l AS (SELECT paper, msg, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM u),
b AS (SELECT *, contains(line, '|') AS bar, coalesce(regexp_matches(lead(line) OVER w, '\|?\s*:?-{{3,}}:?\s*\|'), false) AS sep FROM l WINDOW w AS (PARTITION BY paper, msg ORDER BY i)),
r AS (SELECT *, sum(CASE WHEN bar THEN 0 ELSE 1 END) OVER (PARTITION BY paper, msg ORDER BY i) AS run FROM b),
f AS (SELECT *, CASE WHEN bar THEN min(CASE WHEN sep THEN i END) OVER (PARTITION BY paper, msg, run, bar) END AS fr, max(i) OVER (PARTITION BY paper, msg, run, bar) AS en FROM r),
c AS (SELECT paper, msg, i, CASE WHEN i = fr THEN '[Markdown table omitted locally: ' || (en - fr - 1) || ' data rows; header: ' || substr({space('line')}, 1, 240) || ']' ELSE line END AS line, CASE WHEN i = fr THEN en - fr + 1 ELSE 0 END AS tl FROM f WHERE fr IS NULL OR i <= fr),
w AS (SELECT paper, msg, string_agg(line, chr(10) ORDER BY i) AS body, sum(tl)::BIGINT AS table_lines FROM c GROUP BY ALL),
s AS (SELECT paper, msg, list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM w),
p AS (SELECT paper, msg, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM s),
k AS (SELECT *, {space('p')} AS compact, len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '^\s*(?:\[\d+\]|\d+[\.\)])\s+'))) AS cites FROM p),
q AS (SELECT *, length(compact) > 400 AND ({has('compact', rules.REFERENCE_HEAD)} OR cites >= 3) AS listed FROM k),
z AS (SELECT *, NOT listed AND row_number() OVER (PARTITION BY paper, listed, lower(compact) ORDER BY msg, j) > 1 AS again FROM q),
y AS (SELECT *, NOT listed AND NOT again AND length(compact) <= 160 AND NOT {has('compact', rules.SCORE_TERMS)} AND NOT {has('compact', rules.CONTENT_TERMS)} AND {has('compact', rules.COURTESY)} AS polite FROM z),
g AS (SELECT paper, msg, coalesce(string_agg(CASE WHEN listed THEN '[Reference list omitted locally: ' || greatest(cites, 1) || ' entries]' ELSE p END, chr(10) || chr(10) ORDER BY j) FILTER (WHERE NOT again AND NOT polite), '') AS joined,
 count(*) FILTER (WHERE listed)::BIGINT AS reference_blocks, count(*) FILTER (WHERE again)::BIGINT AS duplicate_paragraphs, count(*) FILTER (WHERE polite)::BIGINT AS courtesy_paragraphs FROM y GROUP BY ALL)
SELECT paper, msg, sha256(CASE WHEN length(joined) > 12000 THEN substr(joined, 1, 9000) || chr(10) || chr(10) || '[...locally truncated...]' || chr(10) || chr(10) || right(joined, 3000) ELSE joined END) AS digest,
 quoted_lines, table_lines, reference_blocks, duplicate_paragraphs, courtesy_paragraphs, (length(joined) > 12000)::BIGINT AS truncated FROM u JOIN w USING (paper, msg) JOIN g USING (paper, msg)""")
def message_cleaner(spark, d):
    """Every message cleaned, with its counters."""
    said = t(spark, d, "conversations").select(F.col("conv_id").alias("paper"), F.col("turn").alias("msg"), F.expr(MESSAGE).alias("text"))
    return clean_messages(said).withColumn("digest", F.sha2("cleaned", 256)).drop("cleaned")


RAW = f"coalesce({pick(VALUES, 'o_orderkey')}, '')"


@query(f"""SELECT o_orderkey, {terms_sql('v', rules.EFFECTIVENESS, 'unknown')} AS effectiveness,
 {cases([(" OR ".join(f"contains(v, '{x}')" for x in rules.PROMISED), 'promised_increase'), ("contains(v, 'overall maintained')", 'maintained'), (has('v', r"\b(increased|raised|upped)\b", '') + ''.join(f" OR contains(v, '{x}')" for x in rules.RAISED), 'increased'), ("contains(v, 'maintained') OR contains(v, 'kept') OR contains(v, 'unchanged')", 'maintained'), ("contains(v, 'decreased') OR contains(v, 'lowered')", 'decreased')], "'unknown'")} AS action,
 CASE WHEN v IN ('a', 'b', 'c', 'd') THEN upper(v) ELSE {terms_sql('v', rules.GRADES, 'D')} END AS grade, {terms_sql('v', rules.RELEVANCE, 'no')} AS relevance FROM (SELECT o_orderkey, lower({RAW}) AS v FROM orders)""")
def result_normalizers(spark, d):
    """Normalised values of model results."""
    v = t(spark, d, "orders").select("o_orderkey", F.expr(RAW).alias("v"))
    return v.select("o_orderkey", rules.effectiveness("v").alias("effectiveness"), rules.normalized_action("v").alias("action"), rules.grade("v").alias("grade"), rules.relevance("v").alias("relevance"))


PAPER = {"title": pick(TITLES, "doc_id"), "abstract": f"{pick(ABSTRACTS, 'doc_id // 8')} || ' ' || substr(coalesce(text, ''), 1, 400)", "keyword": pick(KEYWORDS, "doc_id // 48")}
FIELDS = ("_t", "_k", "_b")


def _found(pack: dict[str, str], field: str) -> str:
    return f"list_filter([{', '.join(f'''CASE WHEN {has(field, p)} THEN '{n}' END''' for n, p in pack.items())}], lambda x: x IS NOT NULL)"


PACKS = {"ac": rules.AGENT_CORE, "aa": rules.AGENT_ADJACENT, "ec": rules.EDUCATION_CORE, "ea": rules.EDUCATION_ADJACENT}
GONE = f"lambda x: x NOT IN ({', '.join(repr(x) for x in rules.CONTEXT_TAGS)})"
MERGED = {p: f"list_sort(list_distinct({p}_t || {p}_k || {p}_b))" for p in PACKS}


def _score(p: str, *weights: int) -> str:
    return "(" + " + ".join(f"{w} * len({p}{f})" for f, w in zip(FIELDS, weights, strict=True)) + ")::BIGINT"


def _tier(core: str, adjacent: str, generic: str) -> str:
    return f"CASE WHEN {core} >= 2 THEN 'core' WHEN {adjacent} >= 2 THEN 'adjacent' WHEN {generic} THEN 'generic' END"


@query(f"""WITH p AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in PAPER.items())} FROM documents),
f AS (SELECT doc_id, title, abstract, title AS _t, keyword AS _k, abstract || ' ||  || ' AS _b, title || ' || ' || keyword || ' || ' || abstract || ' ||  || ' AS _all FROM p),
g AS (SELECT *, {', '.join(f'{_found(pack, x)} AS {p}{x}' for p, pack in PACKS.items() for x in FIELDS)}, {has('_all', rules.EDUCATION_CONTEXT)} AS ctx, {has('_all', rules.DISTILLATION)} AS dis, {has('_all', rules.GENERIC_AGENT)} AS gen FROM f),
h AS (SELECT *, list_has_any({MERGED['ec']}, ['education', 'tutoring']) AS taught FROM g),
w AS (SELECT * REPLACE ({', '.join(f'CASE WHEN NOT ctx OR (dis AND NOT taught) THEN list_filter(ec{x}, {GONE}) ELSE ec{x} END AS ec{x}' for x in FIELDS)}, CASE WHEN ctx THEN ea_b ELSE [] END AS ea_b) FROM h),
s AS (SELECT *, {_score('ac', 5, 3, 1)} AS sac, {_score('aa', 3, 2, 1)} AS saa, {_score('ec', 5, 3, 1)} AS sec, {_score('ea', 3, 2, 1)} AS sea FROM w),
z AS (SELECT *, {_tier('sac', 'saa', 'sac + saa > 0 OR gen')} AS agent_tier, {_tier('sec', 'sea', 'sec + sea > 0')} AS et FROM s),
y AS (SELECT *, coalesce(et IN ('adjacent', 'generic') AND dis, false) AS lost FROM z)
SELECT doc_id, agent_tier, sac + saa AS agent_score, array_to_string({MERGED['ac']} || {MERGED['aa']}, ',') AS agent_tags, CASE WHEN NOT lost THEN et END AS education_tier, sec + sea AS education_score,
 array_to_string({MERGED['ec']} || CASE WHEN lost THEN [] ELSE {MERGED['ea']} END, ',') AS education_tags,
 {cases([(has("title || ' ' || abstract" if k == 'survey' else 'title', p), k) for k, p in rules.PAPER_TYPES], "'pure method'")} AS paper_type FROM y""")
def paper_topics(spark, d):
    """Tiers, tags, scores and type of every paper."""
    made = {k: F.expr(v.replace("//", "div")) for k, v in PAPER.items()}
    papers = t(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in made.items()]).withColumn("keywords", F.array("keyword"))
    papers = papers.withColumns({"tldr": F.lit(None).cast("string"), "primary_area": F.lit(None).cast("string")})
    joined = lambda c: F.array_join(c, ",").alias(c)
    return reviews.classify_papers(papers).select(
        "doc_id", "agent_tier", F.col("agent_relevance_score").alias("agent_score"), joined("agent_tags"), "education_tier",
        F.col("education_relevance_score").alias("education_score"), joined("education_tags"), "paper_type",
    )


EVIDENCE = pick(PHRASES, "event_id // 2")
OUTCOME = pick(rules.ACTIONS, "event_id // 2")


@query(f"""WITH o AS (SELECT user_id AS paper, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'Reviewer_' ELSE '' END || event_type AS reviewer_id, event_type AS rid, {OUTCOME} AS score_action FROM events WHERE event_id % 2 = 0),
e AS (SELECT user_id AS paper, event_id AS ord, 'Reviewer_' || event_type AS reviewer_id, event_type AS rid, said, lower(said) AS v FROM (SELECT *, {EVIDENCE} AS said FROM events WHERE event_id % 2 = 1)),
x AS (SELECT *, {action_sql('v')} AS score_action, CASE {resolution_sql('v')} WHEN 'resolved' THEN 'strong_success' WHEN 'partial' THEN 'partial_success' WHEN 'unresolved' THEN 'no_effect' ELSE 'unknown' END AS effect FROM e),
g AS (SELECT paper, rid, score_action, min(ord) AS first_ord, count(*) AS n, arg_min(reviewer_id, ord) AS raw, arg_max(effect, ord) AS effect, arg_max(said, ord) AS said, max(ord) AS last_ord FROM x GROUP BY ALL),
l AS (SELECT *, pos = max(pos) OVER (PARTITION BY paper, rid, score_action) AS last FROM o)
SELECT coalesce(l.paper, g.paper) AS paper, l.pos, CASE WHEN l.pos IS NULL THEN g.first_ord END AS event_ord, coalesce(l.reviewer_id, g.raw) AS reviewer_id, coalesce(l.score_action, g.score_action) AS score_action,
 CASE WHEN l.pos IS NULL OR (l.last AND g.n IS NOT NULL) THEN g.effect ELSE 'raw' END AS effectiveness, CASE WHEN l.pos IS NULL THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN l.pos IS NULL THEN 'python_filter' END AS source,
 CASE WHEN l.pos IS NULL OR (l.last AND g.n IS NOT NULL) THEN 'm' || g.last_ord END AS source_message_id, CASE WHEN l.pos IS NULL OR (l.last AND g.n IS NOT NULL) THEN g.said END AS evidence_excerpt,
 coalesce(l.last AND g.n IS NOT NULL, false) OR (l.pos IS NULL AND g.n > 1) AS local_reconciled
FROM l FULL JOIN g ON l.paper = g.paper AND l.rid = g.rid AND l.score_action = g.score_action""")
def outcome_merge(spark, d):
    """Local events merged into the outcomes of their key, or added."""
    e = t(spark, d, "events")
    div = lambda x: F.expr(x.replace("//", "div"))
    named = F.concat(F.when(F.col("event_id") % 4 == 0, "Reviewer_").otherwise(""), "event_type").alias("reviewer_id")
    outcomes = e.where("event_id % 2 = 0").select(F.col("user_id").alias("paper"), F.col("event_id").alias("pos"), named, F.lit("raw").alias("effectiveness"), div(OUTCOME).alias("score_action"), F.lit(0.5).alias("confidence"))
    said = e.where("event_id % 2 = 1").select(F.col("user_id").alias("paper"), F.col("event_id").alias("ord"), F.concat(F.lit("Reviewer_"), "event_type").alias("reviewer_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("source_message_id"), div(EVIDENCE).alias("evidence"))
    return reconcile.merge_events(outcomes, said)


@query("""WITH i AS (SELECT o_custkey AS id, o_orderkey AS ordinal, CASE WHEN o_orderkey % 3 > 0 THEN [o_orderpriority] END AS tags, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus, o_orderpriority] ELSE [] END AS factors FROM orders),
n AS (SELECT *, min(ordinal) OVER (PARTITION BY id) AS first_seen, coalesce(len(tags) > 0, false)::INT + (len(factors) > 0)::INT AS filled, length(to_json({'factors': factors, 'id': id, 'tags': tags})::VARCHAR) AS size FROM i)
SELECT id, ordinal, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY filled DESC, size DESC, ordinal) AS r FROM n) WHERE r = 1""")
def most_complete(spark, d):
    """Of each id the item with most filled lists, then the longest, then the first."""
    none = F.array().cast("array<string>")
    items = t(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 3 > 0, F.array("o_orderpriority")).alias("tags"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(none).alias("factors"),
    )
    return ranking.keep_most_complete(items, "id", ["tags", "factors"], "ordinal").select("id", "ordinal", "first_seen")


@query("""WITH n AS (SELECT source, count(*) AS c, count(*) FILTER (WHERE lang = 'en') / count(*) AS share FROM documents GROUP BY source)
SELECT source, CASE WHEN c >= 300 THEN 'high' WHEN c >= 80 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN share >= 0.75 THEN 'taxonomy_coverage_pass' ELSE 'coverage_warning' END AS status FROM n""")
def evidence_labels(spark, d):
    """Confidence by the number of documents, status by a share."""
    n = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("c"), (F.count_if(F.col("lang") == "en") / F.count("*")).alias("share"))
    n = n.withColumn("confidence", rules.confidence_label("c"))
    return n.select("source", "confidence", rules.heldout_status("confidence", "share").alias("status"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '([^/]*)$', 1), '') AS last_part, nullif(regexp_extract(s, '/Reviewer_([^/]+)$', 1), '') AS reviewer, regexp_replace(r, '^Reviewer_', '') AS short, coalesce(nullif(e, ''), nullif(url, '')) AS filled, regexp_replace(j, '^\s+|\s+$', '', 'g') AS joined
FROM (SELECT page_id, url, CASE WHEN page_id % 3 > 0 THEN 'x/Reviewer_' || page_id ELSE 'x/Area_' || page_id END AS s, CASE WHEN page_id % 2 = 0 THEN 'Reviewer_' ELSE '' END || page_id AS r, CASE WHEN page_id % 4 = 0 THEN 'e' WHEN page_id % 4 = 1 THEN '' END AS e,
 CASE WHEN page_id % 2 = 0 THEN url ELSE '' END || chr(10) || CASE WHEN page_id % 3 = 0 THEN ' z ' ELSE '' END AS j FROM pages)""")
def text_scalars(spark, d):
    """Parts of signatures, first filled values, joined fields."""
    i = F.col("page_id").cast("string")
    p = t(spark, d, "pages").select(
        "page_id", "url", F.concat(F.when(F.col("page_id") % 3 > 0, "x/Reviewer_").otherwise("x/Area_"), i).alias("s"), F.concat(F.when(F.col("page_id") % 2 == 0, "Reviewer_").otherwise(""), i).alias("r"),
        F.when(F.col("page_id") % 4 == 0, "e").when(F.col("page_id") % 4 == 1, "").alias("e"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("a"), F.when(F.col("page_id") % 3 == 0, " z ").alias("b"),
    )
    return p.select("page_id", text.last_part("url").alias("last_part"), text.reviewer_of("s").alias("reviewer"), text.without_reviewer("r").alias("short"), text.first_filled("e", "url").alias("filled"), text.joined_fields("a", "b").alias("joined"))


@query("""WITH a AS (SELECT max(ts)::DATE AS d FROM events), w AS (SELECT d, (date_trunc('week', d) - INTERVAL 7 DAY)::DATE AS s FROM a)
SELECT event_id, ts::DATE >= d - 30 AS recent, ts::DATE BETWEEN d - 2 AND d OR ts::DATE BETWEEN s AND s + 6 AS reported FROM events, w""")
def report_days(spark, d):
    """Events of the last thirty days, and of the days a report shows."""
    e = t(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    last = e.agg(F.max("day")).scalar()
    return e.select("event_id", incremental.recent("day", last).alias("recent"), incremental.in_report("day", last).alias("reported"))


@query("SELECT user_id, arg_max(event_id, (day, event_id)) AS event_id, max(day) AS run_date FROM (SELECT user_id, event_id, ts::DATE AS day FROM events) GROUP BY user_id")
def run_snapshot(spark, d):
    """A baseline of all ids replaced by the latest run's rows."""
    e = t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("run_date")).agg(F.max("event_id").alias("event_id"))
    baseline = e.select("user_id").distinct().withColumn("event_id", F.lit(-1).cast("long"))
    return incremental.snapshot(baseline, e, "user_id", "run_date").select("user_id", "event_id", "run_date")


@query("""WITH r AS (SELECT o_custkey AS id FROM orders), n AS (SELECT id, count(*) AS n FROM r GROUP BY id), e AS (SELECT DISTINCT c_custkey AS id FROM customer),
c AS (SELECT (SELECT count(*) FROM e) AS expected_papers, (SELECT count(*) FROM n) AS unique_papers, (SELECT count(*) FROM e ANTI JOIN n USING (id)) AS missing, (SELECT count(*) FROM n ANTI JOIN e USING (id)) AS extra, (SELECT count(*) FROM r) AS returned_papers, (SELECT count(*) FROM n WHERE n > 1) AS duplicate_ids)
SELECT * REPLACE (expected_papers::BIGINT AS expected_papers, returned_papers::BIGINT AS returned_papers), CASE WHEN missing + extra > 0 THEN 'id_mismatch' ELSE '' END AS errors, CASE WHEN duplicate_ids > 0 THEN 'duplicate_id_deduplicated' ELSE '' END AS warnings FROM c""")
def quality_report(spark, d):
    """V1 V2: returned ids against expected ones, with errors and warnings."""
    expected, returned = t(spark, d, "customer").select(F.col("c_custkey").alias("id")), t(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    report = reconcile.qa_report(expected, returned, "id")
    return report.withColumns({c: F.array_join(c, ",") for c in ("errors", "warnings")})


PROGRESS = f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS tag, {pick(rules.EFFECTS, 'o_orderkey')} AS effect, {pick(rules.ACTIONS, 'o_orderkey // 3')} AS act FROM orders"


@query(f"""WITH i AS ({PROGRESS}), n AS (SELECT count(*) AS n FROM i)
SELECT 'analyzed_papers' AS metric, NULL AS key, n::DOUBLE AS value FROM n UNION ALL SELECT 'coverage_percent', NULL, round_even(n / 1000000.0::DOUBLE * 100, 4) FROM n
UNION ALL SELECT 'response_effectiveness', effect, count(*) FROM i GROUP BY effect UNION ALL SELECT 'score_actions', act, count(*) FROM i GROUP BY act
UNION ALL SELECT * FROM (SELECT 'top_research_tags', tag, count(*) AS n FROM i WHERE tag <> '' GROUP BY tag ORDER BY n DESC, tag LIMIT 20)""")
def progress_metrics(spark, d):
    """I4: coverage, outcomes by effect and action, and the top tags."""
    o = t(spark, d, "orders")
    picked = lambda values, number: F.expr(pick(values, number).replace("//", "div"))
    outcome = F.struct(picked(rules.EFFECTS, "o_orderkey").alias("effectiveness"), picked(rules.ACTIONS, "o_orderkey // 3").alias("score_action"))
    items = o.select(F.array(F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority"))).alias("research_tags"), F.array(outcome).alias("response_outcomes"))
    return incremental.progress(items, 1_000_000)


@query("SELECT members, count(*)::BIGINT AS n_keys FROM (SELECT l_suppkey, count(DISTINCT l_orderkey)::BIGINT AS members FROM lineitem GROUP BY 1) GROUP BY 1")
def identity_audit(spark, d):
    """In how many papers a short id occurs, by nested reviews."""
    papers = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("openreview_id")).agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("reviewer_id"))).alias("reviews"))
    return reviews.identity_audit(papers.withColumn("forum", F.lit(None).cast("string")))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'named' WHEN 2 THEN 'valued' ELSE '' END || CASE WHEN page_id % 4 < 3 THEN page_id::VARCHAR ELSE '' END AS tag, CASE WHEN page_id % 4 = 1 OR page_id % 4 = 2 THEN 2 END::INT AS entries FROM pages""")
def json_fields(spark, d):
    """Names of tags and lengths of arrays in JSON."""
    i = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('"plain'), i, F.lit('"'))).when(F.col("page_id") % 4 == 1, F.concat(F.lit('{"name":"named'), i, F.lit('","items":[1,2]}')))
    raw = raw.when(F.col("page_id") % 4 == 2, F.concat(F.lit('{"tag":"","items":[{},{}],"value":" valued'), i, F.lit('"}'))).otherwise("not json")
    return t(spark, d, "pages").select("page_id", raw.alias("raw")).select("page_id", text.tag_name("raw").alias("tag"), text.json_length("raw", "$.items").cast("int").alias("entries"))


@query("SELECT n_nationkey, 'a' || chr(10) || '<!-- N:START -->' || chr(10) || n_name || chr(10) || '<!-- N:END -->' || chr(10) || 'b' AS page FROM nation")
def marked_block(spark, d):
    """The text between two markers replaced."""
    page = F.concat(F.lit("a\n<!-- N:START -->\nold\n"), "n_name", F.lit("\n<!-- N:END -->\nb"))
    return t(spark, d, "nation").select("n_nationkey", incremental.replace_block(page, "N", F.concat(F.col("n_name"), F.lit(" \n"))).alias("page"))
