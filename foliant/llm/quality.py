"""Op 6: quality rules, a decision list learned by sequential covering.

Statistics of each text are Spark expressions.  The learner bins the labelled
rows' statistics at quantiles, and grows one rule after another: to a rule's
conjunction it adds the threshold of greatest FOIL gain on the growing rows,
until no good row is left in it; the pruning rows decide how many of the last
conditions go; rows that the rule covers leave, and the next rule starts.  Every
step is one grouped count over the labelled rows (all of them), of at most
features x bins rows.  The list comes out as an ordered Spark conditional.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Distinct repeated windows up to which positions are looked up one by one.
FEW = 64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five base counts, ``base_failed`` and ``x_`` rates for the rules.

    A null text counts as empty; all counts are then 0.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", F.expr(f"filter(split(coalesce(`{text}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_t", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    # Hashes of windows that occur twice or more: neighbours in sorted order that are equal.
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_t)) = size(_t), cast(array() as array<bigint>), sort_array(_t))"))
    df = df.withColumn("_d", F.expr("if(size(_s) < 2, _s, array_distinct(filter(_s, (x, i) -> i > 0 and x = _s[greatest(i - 1, 0)])))"))
    few = "filter(sequence(0, size(_t) - 1), i -> array_contains(_d, _t[i]))"
    df = df.withColumn("_p", F.expr(f"case when size(_d) = 0 then cast(array() as array<int>) when size(_d) <= {FEW} then {few} end"))
    df = df.withColumn("_z", F.expr("if(_p is null, sort_array(transform(_t, (x, i) -> struct(x as h, i as p))), null)"))
    near = "(i > 0 and z.h = _z[greatest(i - 1, 0)].h) or (i < size(_z) - 1 and z.h = _z[least(i + 1, size(_z) - 1)].h)"
    df = df.withColumn("_p", F.expr(f"coalesce(_p, sort_array(transform(filter(_z, (z, i) -> {near}), z -> z.p)))"))
    # Windows are three words long: a position adds its distance to the next one, three at most.
    covered = "if(size(_p) = 0, 0L, aggregate(transform(_p, (p, i) -> if(i = size(_p) - 1, 3, least(3, _p[least(i + 1, size(_p) - 1)] - p))), 0L, (a, x) -> a + x))"
    df = df.withColumn("n_repeat_words", F.expr(covered))
    df = df.withColumn("_l", F.expr(f"filter(split(coalesce(`{text}`, ''), '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    gone = lambda letters: (F.length(whole) - F.length(F.translate(whole, letters, ""))).cast("long")
    df = df.withColumns({
        "word_chars": F.length(F.translate(whole, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long"),
        "n_symbols": gone(SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_upper": gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "_bang": gone("!?"),
        "_lines": F.size("_l"),
    })
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rates = {
        "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        "x_n_words": F.col("n_words").cast("double"),
        "x_word_length": F.col("word_chars") / words,
        "x_symbol_rate": F.col("n_symbols") / words,
        "x_dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)).cast("double"),
        "x_repeat_rate": F.col("n_repeat_words") / words,
        "x_upper_rate": F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "x_bang_rate": F.col("_bang") / words,
    }
    # A generator of one row: later filters on the statistics stay above it.  Pushed
    # below, each would repeat the whole chain of array expressions many times over.
    made = F.struct(*[F.col(c) for c in BASE], *[v.alias(k) for k, v in rates.items()])
    kept = [c for c in docs.columns if c not in BASE and c not in rates]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(made)).alias("_made")).select(*kept, "_made.*")


FEATURES = ("x_n_words", "x_word_length", "x_symbol_rate", "x_dup_line_rate", "x_repeat_rate", "x_upper_rate", "x_bang_rate")


@dataclass
class Rule:
    """A conjunction of (feature, ``>`` or ``<=``, threshold) whose rows are rejected."""

    parts: list[tuple[str, str, float]]
    bad: int = 0
    good: int = 0

    def sql(self) -> str:
        return " and ".join(f"`{f}` {op} {cut!r}D" for f, op, cut in self.parts)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """Ordered conditional: the number of the first rule that holds, else 0."""
        if not self.rules:
            return F.lit(0)
        return F.expr("case " + " ".join(f"when {r.sql()} then {k}" for k, r in enumerate(self.rules, 1)) + " else 0 end")


def learn(labelled: DataFrame, bins: int = 12, most_rules: int = 12, most_parts: int = 3, precision: float = 0.9, least: int = 3) -> DecisionList:
    """Learn a list from ``FEATURES``, ``doc_id`` and ``bad`` (1: reject) of labelled rows.

    Rows whose hash of doc_id falls in the last third prune, the others grow.
    Null labels are left out.  With no labels, or none of one kind, the list is empty.
    """
    rows = labelled.where("bad is not null").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).alias("prune"), *FEATURES)
    rows = common.cut(rows)
    marks = [k / bins for k in range(1, bins)]
    sides = rows.groupBy("bad").agg(*[F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES]).collect()
    if len(sides) < 2:
        return DecisionList()
    cuts = {}
    for f in FEATURES:  # quantiles of either label's rows, and the middles between them
        marks_f = sorted({float(v) for r in sides for v in r[f]} | {0.0})
        cuts[f] = sorted({*marks_f, *((a + b) / 2 for a, b in zip(marks_f, marks_f[1:], strict=False))})
    # A value's bin: how many thresholds lie below it.
    binned = F.array(*[F.struct(F.lit(k).alias("f"), reduce(lambda a, b: a + b, [(F.col(f) > c).cast("int") for c in cuts[f]]).alias("b")) for k, f in enumerate(FEATURES)])
    rows = common.cut(rows.withColumn("bins", binned))

    def table(where: Column) -> tuple[dict, list[int], list[int]]:
        """Of the growing rows (feature, bin) -> [good, bad] and [good, bad]; of the pruning rows [good, bad]."""
        found = rows.where(where).select("bad", "prune", F.explode("bins").alias("x"))
        counts: dict = {}
        sums = {False: [0, 0], True: [0, 0]}
        for f, b, bad, prune, n in found.groupBy("x.f", "x.b", "bad", "prune").count().collect():
            if f == 0:
                sums[prune][bad] += n
            if not prune:
                counts.setdefault((f, b), [0, 0])[bad] += n
        return counts, sums[False], sums[True]

    def best(counts: dict, bad: int, good: int) -> tuple | None:
        """The threshold of greatest FOIL gain; of equal ones of a statistic, the middle."""
        before, top, tied = math.log2(bad / (bad + good)), 0.0, []
        for f, name in enumerate(FEATURES):
            low_good = low_bad = 0
            for b, c in enumerate(cuts[name]):  # bins 0..b hold values <= c
                g, p = counts.get((f, b), (0, 0))
                low_good, low_bad = low_good + g, low_bad + p
                for op, p_in, g_in in (("<=", low_bad, low_good), (">", bad - low_bad, good - low_good)):
                    if p_in >= least and (g_in < good):
                        gain = p_in * (math.log2(p_in / (p_in + g_in)) - before)
                        if gain > top + 1e-9:
                            top, tied = gain, []
                        if gain > top - 1e-9 and (not tied or tied[0][:2] == (name, op)):
                            tied.append((name, op, c))
        return tied[len(tied) // 2] if tied else None

    rules, left = [], F.lit(True)
    start = table(left)
    while len(rules) < most_rules and start[1][1] >= least:
        parts, steps, now = [], [], start
        while now[1][0] and len(parts) < most_parts and (found := best(now[0], now[1][1], now[1][0])):
            parts.append(found)
            now = table(left & F.expr(Rule(parts).sql()))
            steps.append(now)
        if not parts:
            break
        # Prune: the shortest beginning of the conjunction with the best worth on the other rows.
        worth = lambda k: (lambda g, p: (p - g) / (p + g) if p + g else 0.0)(*steps[k][2])
        k = max(range(len(parts)), key=lambda k: (worth(k), -k))
        good, bad = (steps[k][1][v] + steps[k][2][v] for v in (0, 1))
        if bad < precision * (bad + good):
            break
        rules.append(Rule(parts[: k + 1], bad, good))
        left = left & ~F.expr(rules[-1].sql())
        start = table(left)
    return DecisionList(rules)


def learned(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """The statistics of ``docs`` (doc_id, text) and their texts' hashes (``body``), written
    without the texts, and a list learned from those of the documents that pass the
    base test and have a label.

    Only these few numbers of each document meet the labels.  Labels other than
    0 and 1 are left out; a doc_id that is labelled more than once counts as bad if
    any of its labels does, and rows that repeat a doc_id are learned each.  Other
    columns of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select("doc_id", "text").withColumn("body", common.body_of(docs))
    stats = common.stored(with_statistics(rows).drop("text"), "statistics")
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"))
    return stats, learn(stats.where("not base_failed").join(marked, "doc_id"))


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with ``rule`` (the first that holds, 0: none) and ``kept``.

    Null and empty texts fail the base test and are not kept.
    """
    return stats.withColumn("rule", rules.column()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any columns) that pass the base test and the
    rules learned from them; statistics are computed once, and the verdicts, which
    follow from the text alone, come back by doc_id and text hash.
    """
    verdicts = judged(*learned(docs, labels))
    gone = common.stored(verdicts.where("not kept").select(F.col("doc_id").cast("long").alias("own_id"), F.col("body").alias("own_body")).distinct(), "rejected")
    return common.among(docs, gone, "left_anti")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return judged(*learned(docs, labels)).select("doc_id", *BASE, "base_failed", "kept", "rule")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_quality_rules": op6_quality_rules}
