"""Cleaning, merging, packing, sampling, sinks and increments on small fixtures."""

import gzip
import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from foliant.operators import incremental, packing, ranking, reconcile, sampling, stats
from foliant.operators.clean import clean_messages, route_messages
from foliant.sources import readers, writers
from foliant.streaming.daily import run_increments


def test_clean_messages(spark):
    refs = "References\n" + "\n".join(f"[{k}] " + "word " * 30 for k in range(4))
    rows = [
        ("p", 0, "> quoted\nDear reviewer\n\nMain point stands.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\nafter"),
        ("p", 1, "Main  POINT stands.\n\nDear reviewer\n\n" + refs + "\n\n" + refs),
        ("q", 0, "Main point stands."),
        ("q", 1, None),
        ("q", 2, "x" * 13_000),
    ]
    got = {(r["paper"], r["msg"]): r for r in clean_messages(spark.createDataFrame(rows, "paper string, msg int, text string")).collect()}
    first = got["p", 0]
    assert first["cleaned"] == "Main point stands.\n\n[Markdown table omitted locally: 2 data rows; header: | a | b |]\nafter"
    assert (first["quoted_lines"], first["table_lines"], first["courtesy_paragraphs"]) == (1, 4, 1)
    second = got["p", 1]
    assert second["cleaned"] == "\n\n".join(["[Reference list omitted locally: 4 entries]"] * 2)
    assert (second["duplicate_paragraphs"], second["reference_blocks"], second["courtesy_paragraphs"]) == (2, 2, 0)
    assert got["q", 0]["cleaned"] == "Main point stands."
    assert got["q", 1]["cleaned"] == ""
    assert got["q", 2]["truncated"] == 1


def test_routes(spark):
    rows = [("reviewer_comments", "last day of the discussion period"), ("rebuttals", "Looking forward to your response"), ("reviewer_comments", "I raised my score"), ("rebuttals", "I raised my score"), ("rebuttals", "")]
    got = [r["route"] for r in route_messages(spark.createDataFrame(rows, "kind string, cleaned string")).collect()]
    assert got == ["reminder", "nudge", "local_event", "discussion", "empty"]


def merged_by_hand(outcomes, events):
    out = [dict(o, local_reconciled=False, source=None) for o in outcomes]
    known = {(o["reviewer_id"].removeprefix("Reviewer_"), o["score_action"]): o for o in out}
    for e in events:
        action = {"raised my score": "increased", "keep my score": "maintained"}.get(e["evidence"], "unknown")
        key = (e["reviewer_id"].removeprefix("Reviewer_"), action)
        if key in known:
            known[key].update(local_reconciled=True, msg=e["source_message_id"])
        else:
            known[key] = {"reviewer_id": e["reviewer_id"], "score_action": action, "local_reconciled": False, "source": "python_filter", "msg": e["source_message_id"]}
            out.append(known[key])
    return sorted((o["reviewer_id"], o["score_action"], o["local_reconciled"], o["source"] or "", o.get("msg") or "") for o in out)


def test_merge_events(spark):
    rng = random.Random(5)
    for _ in range(4):
        outcomes = [{"paper": "p", "pos": k, "reviewer_id": rng.choice(["a", "Reviewer_a", "b"]), "effectiveness": "x", "score_action": rng.choice(["increased", "maintained", "unknown"]), "confidence": 0.5} for k in range(rng.randint(0, 4))]
        events = [{"paper": "p", "ord": k, "reviewer_id": rng.choice(["a", "Reviewer_b", "c"]), "source_message_id": f"m{k}", "evidence": rng.choice(["raised my score", "keep my score", "hello"])} for k in range(rng.randint(1, 6))]
        o = spark.createDataFrame([tuple(x.values()) for x in outcomes], "paper string, pos int, reviewer_id string, effectiveness string, score_action string, confidence double")
        e = spark.createDataFrame([tuple(x.values()) for x in events], "paper string, ord int, reviewer_id string, source_message_id string, evidence string")
        got = sorted((r["reviewer_id"], r["score_action"], bool(r["local_reconciled"]), r["source"] or "", r["source_message_id"] or "") for r in reconcile.merge_events(o, e).collect())
        assert got == merged_by_hand(outcomes, events)


def test_packing():
    rng = random.Random(7)
    for _ in range(50):
        sizes = sorted((rng.randint(0, 120) for _ in range(rng.randint(0, 60))), reverse=True)
        bins, want = [], []
        for s in sizes:
            k = next((i for i, b in enumerate(bins) if b + s <= 100), len(bins))
            bins += [0] if k == len(bins) else []
            bins[k] += s
            want.append(k)
        assert packing.first_fit_decreasing(sizes, 100) == want
        loads, lpt = [0] * 4, []
        for s in sizes:
            k = loads.index(min(loads))
            loads[k] += s
            lpt.append(k)
        assert packing.least_loaded(sizes, 4) == lpt
    assert packing.next_fit([60, 50, 200, 1], 110, 10) == [0, 1, 2, 3]


def test_quotas_quantiles_targets(spark):
    counts = spark.createDataFrame([(2024, 7404), (2025, 11672), (2026, 19814)], "year int, n long")
    got = {r["year"]: r["quota"] for r in sampling.quotas(counts, 389, [F.desc("n")]).collect()}
    assert got == {2024: 74, 2025: 117, 2026: 198}
    values = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert stats.nearest_rank(values, "v", [0.5]).first()["p50"] == 3
    runs = spark.createDataFrame([(0,), (1,)], "run int")
    assert [r["papers"] for r in sampling.daily_targets(38_890, 0.0005, runs).orderBy("run").collect()] == [19, 20]
    inventory = spark.createDataFrame([(2024, f"a{i}") for i in range(4)] + [(2025, f"b{i}") for i in range(6)], "year int, openreview_id string")
    done = spark.createDataFrame([], "openreview_id string")
    rows = incremental.daily_selection(inventory, done, 0, 0.5, "openreview_id", "year").collect()
    assert sorted(r["year"] for r in rows) == [2024] * 2 + [2025] * 3


def test_keep_most_complete_and_unique(spark):
    rows = [("p1", 0, None, "x"), ("p2", 1, ["t"], "x"), ("p1", 2, ["t"], "x"), ("p2", 3, ["t"], "x")]
    items = spark.createDataFrame(rows, "id string, o int, tags array<string>, s string")
    got = ranking.keep_most_complete(items, "id", ["tags"], "o").orderBy("first_seen").collect()
    assert [(r["id"], r["o"]) for r in got] == [("p1", 2), ("p2", 1)]
    with pytest.raises(Exception, match="missing or duplicate"):
        ranking.assert_unique(items, "id").collect()
    report = reconcile.qa_report(items.select("id"), items.where("id = 'p1'").select("id"), "id").first()
    assert (report["expected_papers"], report["missing"], report["duplicate_ids"], report["errors"]) == (2, 1, 1, ["id_mismatch"])


def test_blocks_and_weeks(spark):
    df = spark.createDataFrame([("before\n<!-- X:START -->\nold\n<!-- X:END -->\nafter", date(2026, 7, 26))], "t string, d date")
    start, end = incremental.previous_week(F.col("d"))
    r = df.select(incremental.replace_block("t", "X", "new \n").alias("t"), start.alias("s"), end.alias("e")).first()
    assert r["t"] == "before\n<!-- X:START -->\nnew\n<!-- X:END -->\nafter"
    assert (r["s"], r["e"]) == (date(2026, 7, 13), date(2026, 7, 19))
    with pytest.raises(Exception, match="markers missing"):
        df.select(incremental.replace_block("t", "Y", "new")).collect()


def test_sources_and_sinks(spark, tmp_path):
    paper = {"openreview_id": "", "forum": "f1", "year": 2024, "track": "main", "title": "T|1", "keywords": "one", "reviews": [], "rebuttals": [{"id": "m1", "comment": "hi"}], "reviewer_comments": None}
    other = dict(paper, openreview_id="o2", track="workshop", keywords=["a", "b"])
    folder = tmp_path / "2024" / "x"
    folder.mkdir(parents=True)
    for name, value in (("a.json", paper), ("b.json", other), ("index.json", {})):
        (folder / name).write_text(json.dumps(value))
    df = readers.papers(spark, str(tmp_path))
    assert sorted((r["openreview_id"], r["keywords"]) for r in df.collect()) == [("", ["one"]), ("o2", ["a", "b"])]
    assert [r["openreview_id"] for r in readers.inventory(df).collect()] == ["f1"]
    assert [(r["paper"], r["kind"], r["text"]) for r in readers.discussion(readers.main_track(df)).collect()] == [("f1", "rebuttals", "hi")]
    (tmp_path / "batch_1_result.json").write_text(json.dumps({"papers": [{"openreview_id": "z"}]}))
    assert [r["openreview_id"] for r in readers.batch_results(spark, str(tmp_path)).collect()] == ["z"]
    data, digest, n = writers.deterministic_gzip(df.select("forum", "title"), ["forum", "title"])
    assert n == 2 and data == writers.deterministic_gzip(df.select("forum", "title"), ["forum", "title"])[0] and len(digest) == 64
    assert b"T|1" in gzip.decompress(data)
    assert writers.markdown_table(df.where("track='main'"), ["title"], ["title"]).endswith("| T\\|1 |")
    rows = writers.csv_ready(df.select("keywords", F.lit(True).alias("b"), "tldr"), ["keywords", "b", "tldr"]).collect()
    assert sorted(tuple(r) for r in rows) == [("a;b", "True", ""), ("one", "True", "")]


def test_increments_are_idempotent(spark, tmp_path):
    incoming, root = tmp_path / "in", str(tmp_path / "out")
    incoming.mkdir()
    (incoming / "1.json").write_text('{"id":"a"}\n{"id":"a"}\n{"id":"b"}\n')
    assert run_increments(spark, str(incoming), "id string", root, "id") == 1
    assert run_increments(spark, str(incoming), "id string", root, "id") == 0
    (incoming / "2.json").write_text('{"id":"c"}\n')
    assert run_increments(spark, str(incoming), "id string", root, "id") == 1
    assert spark.read.parquet(f"{root}/ledger").count() == 3


def test_progress_counts_effects_actions_and_tags(spark):
    from foliant.operators import incremental

    rows = [("a", ["x", "y"], [("resolved", "raised"), (None, "")]), ("b", ["x", ""], [("resolved", "kept")]), ("c", None, None)]
    items = spark.createDataFrame(rows, "id string, research_tags array<string>, response_outcomes array<struct<effectiveness:string,score_action:string>>")
    got = {(r["metric"], r["key"]): r["value"] for r in incremental.progress(items, 8).collect()}
    assert got == {
        ("analyzed_papers", None): 3.0, ("coverage_percent", None): 37.5, ("response_effectiveness", "resolved"): 2.0, ("response_effectiveness", "unknown"): 1.0,
        ("score_actions", "raised"): 1.0, ("score_actions", "kept"): 1.0, ("score_actions", "unknown"): 1.0, ("top_research_tags", "x"): 2.0, ("top_research_tags", "y"): 1.0,
    }


def test_places_and_reconciled_ids(spark):
    from foliant.operators import ranking, reconcile
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, 3), (2, 1), (2, 0), (1, 5), (None, 1)], "a int, b int")
    got = ranking.places(df, {"a_": F.col("a")}, [F.asc_nulls_first("a"), F.asc("b")]).collect()
    assert sorted((r["place"], r["a"], r["b"]) for r in got) == [(1, None, 1), (2, None, 3), (3, 1, 5), (4, 2, 0), (5, 2, 1)]
    left, right = (spark.createDataFrame([(x,) for x in ids], "id long") for ids in ([1, 2, 2], [2, 3]))
    assert {(r["id"], r["status"]) for r in reconcile.reconcile_ids(left, right, "id").collect()} == {(1, "missing"), (2, "both"), (3, "extra")}
