"""Driver queries for the review-corpus operators, each with DuckDB SQL of the same result.

The driver's tables stand in for the review corpus: documents for papers,
conversations (by turn) for messages, labels for review labels, events for runs
and activity, orders for manifests, nation and region for the agent registry.
Their texts have none of the domain's words, so queries that need matches take
the packs below.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import incremental, packing, ranking, reconcile, sampling, stats
from ..operators.clean import collapse_tables, first_occurrence
from . import review_queries  # noqa: F401  registers its queries
from .registry import ORACLES, QUERIES, long, query, t  # noqa: F401

# Packs for the driver's texts.
CORE = {"thing": r"\bthing", "order": r"\bor", "between": r"entre"}
ADJACENT = {"from": r"\bfrom\b", "with": r"\bwith\b", "which": r"\bwh"}
LICENCE = {"licence": r"licen[cs]e", "copyright": r"copyright", "email": r"@", "link": r"https?://"}
ROUTES = [("r_the", "en", "The", r"\bthe\b"), ("r_and", "en", "And", r"\band\b"), ("r_der", "de", "Der", r"\bder\b"), ("r_les", "fr", "Les", r"\bles\b"), ("r_que", "es", "Que", r" que ")]
ROUTE_ELSE = {"en": "r_and", "de": "r_der", "fr": "r_les", "es": "r_que"}


LINES = r"""lines AS (SELECT doc_id, i, trim(regexp_replace(l, '\s+', ' ', 'g')) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


@query(f"""WITH {LINES}, k AS (SELECT doc_id, i, lower(line) AS f, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY i) AS r FROM lines WHERE line <> '')
SELECT doc_id, count(*) FILTER (WHERE r = 1)::BIGINT AS kept, count(*) FILTER (WHERE r > 1)::BIGINT AS dropped FROM k GROUP BY doc_id""")
def line_dedup_stats(spark, d):
    """First occurrences and repeats of each document's lines."""
    lines = F.filter(F.transform(text.split_lines("text"), lambda x: F.lower(text.normalize_space(x))), lambda x: x != "")
    made = F.explode(F.array(F.struct(F.size(lines).alias("all"), F.size(F.array_distinct(lines)).alias("kept")))).alias("n")  # in the row: no shuffle
    rows = t(spark, d, "documents").select("doc_id", made).where("n.all > 0")
    return rows.select("doc_id", long("n.kept").alias("kept"), long(F.col("n.all") - F.col("n.kept")).alias("dropped"))


@query(f"""WITH {LINES} SELECT doc_id, i::BIGINT - 1 AS pos, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY i) > 1 AS repeat FROM lines WHERE line <> ''""")
def line_first_occurrence(spark, d):
    """Every line with whether an earlier one of its document is equal."""
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(text.split_lines("text")).alias("i", "line"))
    rows = rows.withColumn("line", F.lower(text.normalize_space("line"))).where("line <> ''")
    return first_occurrence(rows, ["doc_id"], "line", ["i"]).select("doc_id", long("i").alias("pos"), "repeat")


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies, sha256(text) AS digest FROM documents GROUP BY text")
def doc_exact_dedup(spark, d):
    """The first document of each text."""
    rows = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""WITH n AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM documents),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS r, min(doc_id) OVER (PARTITION BY k) AS first_seen FROM n)
SELECT doc_id, first_seen FROM r WHERE r = 1""")
def best_duplicate(spark, d):
    """The longest of each group of texts equal but for space and case."""
    rows = t(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.lower(text.normalize_space("text")), 256).alias("k"))
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("id"))).alias("best")
    return rows.groupBy("k").agg(best, F.min("doc_id").alias("first_seen")).select((-F.col("best.id")).alias("doc_id"), "first_seen")


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    """Keys that occur more than once."""
    return ranking.duplicate_keys(t(spark, d, "orders"), "o_custkey")


@query("""SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([
 CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i)copyright') THEN 'copyright' END,
 CASE WHEN regexp_matches(text, '@') THEN 'email' END, CASE WHEN regexp_matches(text, '(?i)https?://') THEN 'link' END], lambda x: x IS NOT NULL)) AS tag FROM documents) GROUP BY tag""")
def license_tags(spark, d):
    """Document frequency of pattern tags."""
    return stats.tag_frequency(t(spark, d, "documents").select(rules.tags("text", LICENCE).alias("tags")), "tags")


def _sum_sql(field: str, weight: int, pack: dict) -> str:
    return " + ".join(f"{weight} * regexp_matches({field}, '(?i){p}')::INT" for p in pack.values())


@query(f"""WITH p AS (SELECT doc_id, substr(text, 1, 80) AS title, substr(text, 81, 200) AS kw, substr(text, 281) AS body FROM documents),
s AS (SELECT doc_id, ({_sum_sql('title', 5, CORE)} + {_sum_sql('kw', 3, CORE)} + {_sum_sql('body', 1, CORE)})::BIGINT AS core_score,
 ({_sum_sql('title', 3, ADJACENT)} + {_sum_sql('kw', 2, ADJACENT)} + {_sum_sql('body', 1, ADJACENT)})::BIGINT AS adjacent_score FROM p)
SELECT *, CASE WHEN core_score >= 2 THEN 'core' WHEN adjacent_score >= 2 THEN 'adjacent' WHEN core_score + adjacent_score > 0 THEN 'generic' END AS tier FROM s""")
def weighted_tier(spark, d):
    """weighted tiers over title, keywords and body."""
    p = t(spark, d, "documents").select("doc_id", F.expr("substring(text, 1, 80) title"), F.expr("substring(text, 81, 200) kw"), F.expr("substring(text, 281) body"))
    s = p.select("doc_id", rules.weighted_score([("title", 5), ("kw", 3), ("body", 1)], CORE).alias("core_score"), rules.weighted_score([("title", 3), ("kw", 2), ("body", 1)], ADJACENT).alias("adjacent_score"))
    tier = rules.first_label([(F.col("core_score") >= 2, "core"), (F.col("adjacent_score") >= 2, "adjacent"), (F.col("core_score") + F.col("adjacent_score") > 0, "generic")], None)
    return s.withColumn("tier", tier)


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(v, '\bnot\b|\bfrom\b') THEN 'from' WHEN regexp_matches(v, '^the\b') THEN 'head' WHEN regexp_matches(v, '\bwhich\b|\bwith\b') THEN 'with' ELSE 'unknown' END AS label
FROM (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS v FROM conversations)""")
def ordered_rule_label(spark, d):
    """Ordered classification of messages."""
    v = F.lower(text.normalize_space("text"))
    order = [(rules.matches(v, r"\bnot\b|\bfrom\b", "U"), "from"), (rules.matches(v, r"^the\b", "U"), "head"), (rules.matches(v, r"\bwhich\b|\bwith\b", "U"), "with")]
    return t(spark, d, "conversations").select("conv_id", "turn", rules.first_label(order, "unknown").alias("label"))


@query("""SELECT o_orderpriority, CASE WHEN contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'urgent') THEN 'strong' WHEN contains(lower(o_orderpriority), 'medium') THEN 'partial' WHEN contains(lower(o_orderpriority), 'low') THEN 'none' ELSE 'unknown' END AS label, count(*)::BIGINT AS n FROM orders GROUP BY ALL""")
def substring_enum(spark, d):
    """Ordered substring normaliser."""
    order = [(("high", "urgent"), "strong"), (("medium",), "partial"), (("low",), "none")]
    return t(spark, d, "orders").groupBy("o_orderpriority", rules.by_terms("o_orderpriority", order, "unknown").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, ((strlen(text) + 2) // 3)::BIGINT AS tokens FROM documents")
def token_count(spark, d):
    """estimated tokens."""
    return t(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("tokens"))


def _rank_sql(value: str, source: str, key: str) -> str:
    at = lambda f: f"max(v) FILTER (WHERE i = round_even((n - 1) * {f}, 0)) AS p{round(f * 100)}"
    return f"""WITH s AS (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source})
SELECT k AS {key}, max(n)::BIGINT AS n, {at(0.5)}, {at(0.9)}, {at(0.95)}, {at(0.99)} FROM s GROUP BY k"""


@query(_rank_sql("n_chars", "documents", "lang"))
def nearest_rank_quantiles(spark, d):
    """Nearest-rank quantiles with a half-even index."""
    return stats.nearest_rank(t(spark, d, "documents"), "n_chars", [0.5, 0.9, 0.95, 0.99], ["lang"])


@query("SELECT count(*)::BIGINT AS papers, min(n_chars) AS least, max(n_chars) AS most, round_even(avg(n_chars), 2) AS mean FROM documents")
def length_summary(spark, d):
    """Mean, least and greatest."""
    return t(spark, d, "documents").agg(F.count("*").alias("papers"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), stats.mean_or_zero("n_chars", 2).alias("mean"))


@query("SELECT source, coalesce(lang, 'None') AS value, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def lang_histogram(spark, d):
    """Value histogram by group."""
    return stats.histogram(t(spark, d, "documents"), ["source"], "lang")


@query("""SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 1)::BIGINT AS good, count(*) FILTER (WHERE toxic = 1)::BIGINT AS toxic, round_even(count(*) FILTER (WHERE toxic = 1) / count(*) * 100, 2) AS toxic_percent
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def conditional_counts(spark, d):
    """Conditional counts and a ratio."""
    j = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), stats.percent(F.count_if(F.col("toxic") == 1), F.count("*")).alias("toxic_percent"))


@query("SELECT members, count(*)::BIGINT AS n_keys FROM (SELECT user_id, count(DISTINCT event_type)::BIGINT AS members FROM events GROUP BY 1) GROUP BY 1")
def count_of_counts(spark, d):
    """Histogram of a distinct count."""
    return stats.count_of_counts(t(spark, d, "events"), "user_id", "event_type")


@query("""WITH w AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w, generate_subscripts(string_split_regex(lower(text), '\\s+'), 1) AS i FROM documents) WHERE w <> ''),
c AS (SELECT w AS value, count(*)::BIGINT AS n, min(doc_id * 1000000 + i - 1) AS first_seen FROM w GROUP BY w)
SELECT * FROM c ORDER BY n DESC, first_seen LIMIT 20""".replace("\\\\", "\\"))
def tag_frequency_topk(spark, d):
    """A10 T4: the most common words, ties by first appearance."""
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(text.words(F.lower("text"))).alias("i", "w"))
    top = ranking.most_common(rows.withColumn("o", F.struct("doc_id", "i")), "w", "o", 20)
    return top.withColumn("first_seen", F.col("first_seen.doc_id") * 1_000_000 + F.col("first_seen.i"))


@query(r"""SELECT role, count(*)::BIGINT AS n, round_even(avg(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))), 1) AS mean_words FROM conversations GROUP BY role""")
def mean_words_by_role(spark, d):
    """Mean words of messages."""
    return t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), stats.mean_or_zero(text.word_count("text"), 1).alias("mean_words"))


PHASE_SQL = "CASE WHEN day(ts) <= 10 THEN 'training' WHEN day(ts) <= 20 THEN 'calibration' ELSE 'heldout_test' END"


def _phase():
    n = F.dayofmonth("ts")
    return F.when(n <= 10, "training").when(n <= 20, "calibration").otherwise("heldout_test")


@query(f"SELECT event_type, count(*)::BIGINT AS n, {', '.join(f'''count(*) FILTER (WHERE p = '{p}')::BIGINT AS {p}''' for p in ('training', 'calibration', 'heldout_test'))} FROM (SELECT *, {PHASE_SQL} AS p FROM events) GROUP BY 1")
def phase_split(spark, d):
    """Counts by phase."""
    e = t(spark, d, "events").withColumn("p", _phase())
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *[F.count_if(F.col("p") == p).alias(p) for p in ("training", "calibration", "heldout_test")])


@query(f"""WITH e AS (SELECT *, {PHASE_SQL} AS p, event_type || '/' || (user_id % 7) AS tag FROM events),
c AS (SELECT user_id % 5 AS g, p, tag, count(*) AS n, min(event_id) AS o FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY n DESC, o) AS r FROM c),
s AS (SELECT g, list(tag) FILTER (WHERE p = 'heldout_test') AS test, list(tag) FILTER (WHERE p <> 'heldout_test') AS known FROM r WHERE r <= 8 GROUP BY g)
SELECT g AS grp, round_even(len(list_filter(test, lambda x: list_contains(known, x))) / len(test), 3) AS coverage FROM s""")
def tag_coverage(spark, d):
    """Share of held-out top tags that earlier phases know."""
    e = t(spark, d, "events").withColumns({"p": _phase(), "grp": F.col("user_id") % 5, "tag": F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string"))})
    tops = stats.top_tags_by_phase(e, "p", "tag", "event_id", 8, ["grp"])
    one = lambda p: F.flatten(F.collect_list(F.when(F.col("p") == p, F.col("tags"))))
    return tops.groupBy("grp").agg(one("training").alias("a"), one("calibration").alias("b"), one("heldout_test").alias("c")).select("grp", stats.coverage(F.col("c"), F.col("a"), F.col("b")).alias("coverage"))


@query("SELECT event_type, event_id, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, length(props) DESC, event_id) AS r FROM events) WHERE r <= 3")
def topk_examples(spark, d):
    """Three examples of each key."""
    order = [F.desc("value"), F.length("props").desc(), F.asc("event_id")]
    return ranking.best_per_key(t(spark, d, "events"), ["event_type"], order, 3, "place").select("event_type", "event_id", long("place").alias("place"))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'adjacent' WHEN 2 THEN 'generic' END AS tier, p_size, p_name FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN tier = 'core' THEN 0 WHEN tier = 'adjacent' THEN 1 WHEN tier IS NULL THEN 2 ELSE 3 END, p_size DESC, lower(p_name), p_partkey)::BIGINT AS place FROM p""")
def tier_sort(spark, d):
    """Custom tier order: the place of every row in the report."""
    p = t(spark, d, "part").withColumn("tier", F.expr("case p_size % 4 when 0 then 'core' when 1 then 'adjacent' when 2 then 'generic' end"))
    order = [ranking.tier_rank("tier"), F.desc("p_size"), F.lower("p_name"), F.asc("p_partkey")]
    coarse = {"tier_place": F.coalesce(ranking.tier_rank("tier"), F.lit(3)), "by_size": -F.col("p_size"), "letters": F.substring(F.lower("p_name"), 1, 2)}
    return ranking.places(p, coarse, order).select("p_partkey", long("place").alias("place"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC)::BIGINT AS place FROM orders")
def newest_first(spark, d):
    """Reverse sort by date and id: the place of every row."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    coarse = {"day": F.datediff(F.lit("2100-01-01").cast("date"), F.col("o_orderdate").cast("date"))}
    return ranking.places(o, coarse, ranking.newest_first("o_orderdate", "o_orderkey")).select("o_orderkey", long("place").alias("place"))


@query("""WITH b AS (SELECT doc_id, n_chars, lang = 'en' AS one, n_chars > 5000 AS two FROM documents)
SELECT doc_id, 'both' AS part FROM b WHERE one AND two UNION ALL SELECT * FROM (SELECT doc_id, 'one' FROM b WHERE one AND NOT two ORDER BY n_chars DESC, doc_id LIMIT 30)
UNION ALL SELECT * FROM (SELECT doc_id, 'two' FROM b WHERE two AND NOT one ORDER BY n_chars DESC, doc_id LIMIT 30)""")
def preview_union(spark, d):
    """The intersection and a preview of 30 of either list."""
    docs, one, two = t(spark, d, "documents").select("doc_id", "n_chars", "lang"), F.col("lang") == "en", F.col("n_chars") > 5000
    part = lambda where, name: docs.where(where).withColumn("part", F.lit(name))
    return ranking.preview(part(one & two, "both"), part(one & ~two, "one"), part(two & ~one, "two"), [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "part")


@query("SELECT p_brand AS batch, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 3")
def first_batches(spark, d):
    """The first three prepared batches by name."""
    return ranking.first_batches(t(spark, d, "part").groupBy(F.col("p_brand").alias("batch")).agg(F.count("*").alias("n")), "batch", 3)


@query("""WITH m AS (SELECT o_custkey, arg_max(year(o_orderdate), o_orderkey) AS y FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, o_custkey) AS paper, coalesce(y, 2000 + c_nationkey)::INT AS year FROM customer FULL JOIN m ON c_custkey = o_custkey""")
def year_attribution(spark, d):
    """The inventory's year of each paper, replaced by the last manifest that has it."""
    base = t(spark, d, "customer").select(F.col("c_custkey").alias("paper"), (2000 + F.col("c_nationkey")).cast("int").alias("year"))
    later = t(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.year("o_orderdate").cast("int").alias("year"), "o_orderkey")
    return reconcile.attributed(base, later, "paper", "year", "o_orderkey")


LABELS = {"ASIA": "Asia / 亚洲", "EUROPE": "Europe / 欧洲", "AFRICA": "Africa / 非洲"}


@query("SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'Asia / 亚洲' WHEN 'EUROPE' THEN 'Europe / 欧洲' WHEN 'AFRICA' THEN 'Africa / 非洲' ELSE r_name END AS label FROM region")
def bilingual_labels(spark, d):
    """labels by a literal map."""
    return t(spark, d, "region").select("r_regionkey", rules.label_of("r_name", LABELS).alias("label"))


STRATA = "c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n, 137 * n / sum(n) OVER () AS x FROM c), f AS (SELECT *, floor(x) AS fl FROM q), k AS (SELECT *, row_number() OVER (ORDER BY x - fl DESC, n DESC, lang) AS r, 137 - sum(fl) OVER () AS rest FROM f), z AS (SELECT lang, n::BIGINT AS n, (fl + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM k)"


def _strata(spark, d):
    counts = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.quotas(counts, 137, [F.desc("n"), F.asc("lang")])


@query(f"WITH {STRATA} SELECT * FROM z")
def largest_remainder(spark, d):
    """Q1: largest-remainder quotas."""
    return _strata(spark, d)


@query(f"WITH {STRATA}, o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS r FROM documents) SELECT doc_id, lang FROM o JOIN z USING (lang) WHERE r <= quota")
def hash_order_sample(spark, d):
    """Each stratum's first rows in hash order."""
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return sampling.take_quota(docs, _strata(spark, d), "lang", [F.sha2(F.col("doc_id").cast("string"), 256)]).select("doc_id", "lang")


@query(f"""WITH {STRATA}, o AS (SELECT doc_id, lang, n, quota, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i FROM documents JOIN z USING (lang)),
s AS (SELECT *, CASE WHEN quota >= n THEN i ELSE ((i + 1) * quota - 1) // n END AS slice FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, slice ORDER BY sha256('20260720' || doc_id::VARCHAR), doc_id) AS p FROM s WHERE quota > 0) SELECT doc_id, lang, slice::BIGINT AS slice FROM p WHERE p = 1""")
def quantile_sample(spark, d):
    """Q3: one pick in each size slice."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(F.broadcast(_strata(spark, d).drop("n")), "lang")
    return sampling.quantile_sample(docs, "lang", "n_chars", "doc_id", "20260720").select("doc_id", "lang", long("slice").alias("slice"))


@query("""WITH RECURSIVE d AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
f(lang, i, doc_id, bin, used) AS (SELECT lang, i, doc_id, 0::BIGINT, 100 + n_chars FROM d WHERE i = 1
 UNION ALL SELECT d.lang, d.i, d.doc_id, CASE WHEN used + n_chars > 20000 THEN bin + 1 ELSE bin END, CASE WHEN used + n_chars > 20000 THEN 100 + n_chars ELSE used + n_chars END FROM f JOIN d ON d.lang = f.lang AND d.i = f.i + 1)
SELECT lang, doc_id, bin FROM f""")
def pack_next_fit(spark, d):
    """B2: next-fit packing with a base cost."""
    return packing.pack(t(spark, d, "documents"), "lang", "doc_id", "n_chars", "next_fit", 20_000, 100).select("lang", "doc_id", "bin")


@query()
def pack_ffd(spark, d):
    """B1: first-fit-decreasing packing."""
    return packing.pack(t(spark, d, "documents"), "lang", "doc_id", "n_chars", "ffd", 20_000)


@query()
def pack_lpt(spark, d):
    """Longest processing time into 8 bins."""
    return packing.pack(t(spark, d, "documents"), "lang", "doc_id", "n_chars", "lpt", 8)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def anti_join_remaining(spark, d):
    """What is not processed yet."""
    return incremental.remaining(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def semi_join_expected(spark, d):
    """Rows whose id is expected."""
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id, coalesce(quality, -1)::INT AS quality, coalesce(toxic, -1)::INT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_default(spark, d):
    """Left join with defaults."""
    return reconcile.left_default(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": -1}).select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS status
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""")
def id_reconciliation(spark, d):
    """Ids on either side, of all documents and all labels."""
    return reconcile.reconcile_ids(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


MERGE = """WITH o AS (SELECT user_id AS paper, event_id AS pos, event_type AS act, 'model' AS effect FROM events WHERE event_id % 2 = 0),
e AS (SELECT user_id AS paper, event_id AS ord, event_type AS act, CAST(value AS VARCHAR) AS ev FROM events WHERE event_id % 2 = 1),
g AS (SELECT paper, act, min(ord) AS first_ord, count(*) AS n, max(ord) AS last_ord FROM e GROUP BY ALL),
l AS (SELECT *, pos = max(pos) OVER (PARTITION BY paper, act) AS last FROM o)
SELECT coalesce(l.paper, g.paper) AS paper, coalesce(l.act, g.act) AS act, l.pos, CASE WHEN l.pos IS NULL THEN g.first_ord END AS event_ord,
 CASE WHEN l.pos IS NULL OR (l.last AND g.n IS NOT NULL) THEN g.last_ord END AS merged_from, (coalesce(l.last AND g.n IS NOT NULL, false) OR (l.pos IS NULL AND g.n > 1)) AS reconciled
FROM l FULL JOIN g ON l.paper = g.paper AND l.act = g.act"""


@query(MERGE)
def composite_merge(spark, d):
    """Events merged into the last outcome of their key, or added."""
    e = t(spark, d, "events")
    o = e.where("event_id % 2 = 0").select(F.col("user_id").alias("paper"), F.col("event_id").alias("pos"), F.col("event_type").alias("act"))
    g = e.where("event_id % 2 = 1").groupBy(F.col("user_id").alias("paper"), F.col("event_type").alias("act")).agg(F.min("event_id").alias("first_ord"), F.max("event_id").alias("last_ord"), F.count("*").alias("n"))
    o = o.withColumn("last", F.col("pos") == F.max("pos").over(W.partitionBy("paper", "act")))
    j = o.join(g, ["paper", "act"], "full_outer")
    new, hit = F.col("pos").isNull(), F.coalesce(F.col("last") & F.col("n").isNotNull(), F.lit(False))
    return j.select("paper", "act", "pos", F.when(new, F.col("first_ord")).alias("event_ord"), F.when(new | hit, F.col("last_ord")).alias("merged_from"), (hit | (new & F.coalesce(F.col("n") > 1, F.lit(False)))).alias("reconciled"))


@query(f"SELECT act, count(*)::BIGINT AS n, count(merged_from)::BIGINT AS merged, count(*) FILTER (WHERE reconciled)::BIGINT AS reconciled FROM ({MERGE}) GROUP BY act")
def provenance_counts(spark, d):
    """V4: outcomes that events were merged into, and reconciled ones."""
    return reconcile.provenance_counts(composite_merge(spark, d), ["act"])


@query(f"""WITH r(id, pattern) AS (VALUES {', '.join(f"('{i}', '{p}')" for i, _, _, p in ROUTES)}) SELECT id AS rule, count(*)::BIGINT AS n FROM documents JOIN r ON regexp_matches(text, '(?i)' || pattern) GROUP BY id""")
def regex_theta_join(spark, d):
    """Theta join with a literal rule table."""
    found = reconcile.regex_join(t(spark, d, "documents").select("text"), "text", {i: p for i, _, _, p in ROUTES})
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN list_filter([CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'r_the' END, CASE WHEN regexp_matches(text, '(?i)\\band\\b') THEN 'r_and' END], lambda x: x IS NOT NULL)
 WHEN 'de' THEN list_filter([CASE WHEN regexp_matches(text, '(?i)\\bder\\b') THEN 'r_der' END], lambda x: x IS NOT NULL) WHEN 'fr' THEN list_filter([CASE WHEN regexp_matches(text, '(?i)\\bles\\b') THEN 'r_les' END], lambda x: x IS NOT NULL)
 ELSE list_filter([CASE WHEN regexp_matches(text, '(?i) que ') THEN 'r_que' END], lambda x: x IS NOT NULL) END AS h FROM documents)
SELECT doc_id, unnest(CASE WHEN len(h) > 0 THEN h WHEN lang = 'en' THEN ['r_and'] WHEN lang = 'de' THEN ['r_der'] WHEN lang = 'fr' THEN ['r_les'] ELSE ['r_que'] END) AS archetype FROM x""".replace("\\\\", "\\"))
def archetype_routing(spark, d):
    """Unrolled routing with a fallback for each domain."""
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("search"), F.array("lang").alias("domains"))
    return reconcile.routed(docs, ROUTES, ROUTE_ELSE).select("doc_id", "archetype")


@query(r"""WITH p AS (SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)$', 1), '') AS suffix FROM pages) SELECT page_id, doc_id FROM p JOIN documents ON suffix = doc_id::VARCHAR""")
def signature_join(spark, d):
    """Join by an extracted suffix; rows without one are dropped."""
    p = t(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"/([0-9]+)$", 1), F.lit("")).alias("suffix"))
    docs = t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("suffix"))
    return p.join(docs, "suffix").select("page_id", "doc_id")


@query("SELECT n_name AS member, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey")
def group_membership(spark, d):
    """Inverted membership lists."""
    groups = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("members"))
    return reconcile.membership(groups, "r_name", "members").withColumnRenamed("group", "grp")


@query("""SELECT route, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 2000 AND lang = 'en' THEN 'both' END, CASE WHEN NOT (n_chars > 2000) AND lang <> 'en' THEN 'rest' END], lambda x: x IS NOT NULL)) AS route FROM documents) GROUP BY route""")
def routed_split(spark, d):
    """One pass, several routes."""
    big, en = F.col("n_chars") > 2000, F.col("lang") == "en"
    routes = {"long": big, "english": en, "both": big & en, "rest": ~big & ~en}
    hits = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in routes.items()]), lambda x: x.isNotNull())
    return t(spark, d, "documents").select(F.explode(hits).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES.replace("trim(regexp_replace(l, '\\s+', ' ', 'g'))", "CASE WHEN i % 7 = 2 THEN '|---|' WHEN i % 7 IN (1, 3, 4) THEN '| a |' ELSE l END")},
b AS (SELECT *, contains(line, '|') AS bar FROM lines), r AS (SELECT *, sum(CASE WHEN bar THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run, bar AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY i), '\\|?\\s*:?-{{3,}}:?\\s*\\|'), false) AS st FROM b),
f AS (SELECT *, CASE WHEN bar THEN min(CASE WHEN st THEN i END) OVER (PARTITION BY doc_id, run, bar) END AS fr, max(i) OVER (PARTITION BY doc_id, run, bar) AS en FROM r)
SELECT doc_id, count(*) FILTER (WHERE fr IS NULL OR i <= fr)::BIGINT AS lines_left, coalesce(sum(en - fr + 1) FILTER (WHERE i = fr), 0)::BIGINT AS table_lines FROM f GROUP BY doc_id""".replace("\\\\", "\\"))
def table_run_collapse(spark, d):
    """Markdown tables (made from every document's lines) collapse."""
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(text.split_lines("text")).alias("line_pos", "line"))
    k = (F.col("line_pos") + 1) % 7
    rows = rows.withColumn("line", F.when(k == 2, "|---|").when(k.isin(1, 3, 4), "| a |").otherwise(F.col("line")))
    return collapse_tables(rows, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("lines_left"), F.sum("table_lines").alias("table_lines"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 12000 THEN substr(text, 1, 9000) || chr(10) || chr(10) || '[...locally truncated...]' || chr(10) || chr(10) || right(text, 3000) ELSE text END) AS digest FROM documents")
def head_tail_truncate(spark, d):
    """head and tail of long texts."""
    return t(spark, d, "documents").select("doc_id", F.sha2(text.head_tail("text"), 256).alias("digest"))


@query("""WITH a AS (SELECT max(ts)::DATE AS d FROM events), days AS (SELECT unnest([d, d - 1, d - 2]) AS day FROM a)
SELECT day::DATE AS day, count(event_id)::BIGINT AS n FROM days LEFT JOIN events ON ts::DATE = day::DATE GROUP BY 1""")
def trailing_days(spark, d):
    """The last three days, empty ones included."""
    e = t(spark, d, "events").select(F.to_date("ts").alias("day"))
    days = e.agg(F.max("day").alias("d")).select(F.explode(incremental.trailing_days(F.col("d"))).alias("day"))
    counts = e.groupBy("day").agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH a AS (SELECT (date_trunc('week', max(ts)) - INTERVAL 7 DAY)::DATE AS s FROM events)
SELECT event_type, min(s) AS week_start, count(*)::BIGINT AS n FROM events, a WHERE ts::DATE BETWEEN s AND s + 6 GROUP BY event_type""")
def previous_week(spark, d):
    """The ISO week before the last event's."""
    e = t(spark, d, "events").select("event_type", F.to_date("ts").alias("day"))
    start, end = incremental.previous_week(F.col("d"))
    week = F.broadcast(e.agg(F.max("day").alias("d")).select(start.alias("week_start"), end.alias("week_end")))  # one row
    return e.join(week, F.col("day").between(F.col("week_start"), F.col("week_end"))).groupBy("event_type").agg(F.min("week_start").alias("week_start"), F.count("*").alias("n"))


@query("SELECT k::INT AS run, greatest(1, round_even(38890 * 0.0005 * (k + 1), 0) - round_even(38890 * 0.0005 * k, 0))::BIGINT AS papers FROM range(30) r(k)")
def daily_targets(spark, d):
    """Steps of the cumulative target."""
    return sampling.daily_targets(38_890, 0.0005, spark.range(30).select(F.col("id").cast("int").alias("run")))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    """The last write of each key."""
    return ranking.upsert_latest(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT v AS event_type, count(event_id)::BIGINT AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('refund'), ('signup'), ('never')) d(v) LEFT JOIN events ON event_type = v GROUP BY v")
def enum_counts_with_zeros(spark, d):
    """V3: counts of a fixed domain."""
    return reconcile.enum_counts(t(spark, d, "events"), "event_type", ("click", "view", "purchase", "refund", "signup", "never"))


@query(r"""SELECT conv_id, turn, len(w[1:12])::BIGINT AS kept, len(w) > 12 AS violation FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations)""")
def list_limit_violations(spark, d):
    """T5 V2: truncation with violation flags."""
    c = t(spark, d, "conversations").withColumn("w", text.words("text"))
    return c.select("conv_id", "turn", long(F.size(ranking.truncated("w", 12))).alias("kept"), ranking.too_long("w", 12).alias("violation"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, replace(replace(url, '|', '\\|'), chr(10), ' ') AS cell FROM pages""".replace("\\\\", "\\"))
def markup_escapes(spark, d):
    """HTML and Markdown escapes."""
    return t(spark, d, "pages").select("page_id", text.html_escape("html").alias("escaped"), text.markdown_cell("url").alias("cell"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS slug, lower(url) AS k FROM pages)
SELECT slug, count(*)::BIGINT AS papers, string_agg(page_id::VARCHAR, ',' ORDER BY k, page_id) AS pages FROM p GROUP BY slug""")
def topic_catalog(spark, d):
    """Pages by topic in title order."""
    p = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("slug"), F.lower("url").alias("k"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "page_id"))), lambda x: x["page_id"].cast("string")), ",")
    return p.groupBy("slug").agg(F.count("*").alias("papers"), ids.alias("pages"))


@query("""SELECT k AS key, sum(v)::DOUBLE AS total FROM (SELECT unnest(json_keys(props)) AS k, unnest(list_transform(json_keys(props), lambda x: try_cast(json_extract_string(props, '$.' || x) AS DOUBLE))) AS v FROM events) WHERE v IS NOT NULL GROUP BY k""")
def dynamic_key_sums(spark, d):
    """A3 A4: sums by a dynamic key, numeric values only."""
    usage = t(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("u"))
    return stats.sum_by_dynamic_key(usage, "u")


@query("""SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'both' ELSE lang END AS grp FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, lang FROM documents WHERE n_chars > 20000""")
def union_append(spark, d):
    """Append of record lists."""
    docs = t(spark, d, "documents")
    a = docs.where(F.col("lang").isin("en", "de")).select("doc_id", F.when(F.col("n_chars") > 5000, "both").otherwise(F.col("lang")).alias("grp"))
    return a.unionByName(docs.where("n_chars > 20000").select("doc_id", F.col("lang").alias("grp")), allowMissingColumns=True)


@query("""WITH a AS (SELECT (SELECT count(*) FROM documents) AS total), l AS (SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)), n AS (SELECT count(*) AS have FROM l),
c AS (SELECT lang, count(*) AS n FROM l GROUP BY lang), g AS (SELECT least(have, greatest(1, round_even(total * 0.05 * 3, 0) - round_even(total * 0.05 * 2, 0))) AS target FROM a, n),
q AS (SELECT lang, target, target * n / sum(n) OVER () AS x FROM c, g), f AS (SELECT *, floor(x) AS fl FROM q), k AS (SELECT *, row_number() OVER (ORDER BY x - fl DESC, lang) AS r, target - sum(fl) OVER () AS rest FROM f),
o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS i FROM l)
SELECT doc_id, lang FROM o JOIN k USING (lang) WHERE i <= fl + CASE WHEN r <= rest THEN 1 ELSE 0 END""")
def incremental_day(spark, d):
    """The selection of the third daily run (labelled documents are done)."""
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return incremental.daily_selection(docs, t(spark, d, "labels"), 2, 0.05, "doc_id", "lang").select("doc_id", "lang")
