"""Op 2, 5, 7, 9 and 10 against brute force or held-out rows."""

import base64
import gzip
import hashlib
import io
import random
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import common, jaccard, pseudo, tiling, toxicity, warc
from tests.conftest import DATA


def components(rows, k, per_cent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("words", "per_cent"), [(4, 85), (5, 80)])
def test_jaccard(spark, words, per_cent):
    rng = random.Random(words)
    rows = []
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 9, 40, 120]))] for _ in range(12)]
    for k in range(220):
        w = list(rng.choice(base)) if k % 3 else [f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 3, 4, 30]))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        rows.append((k, " ".join(w).upper() if k % 5 == 0 else "\n".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " ")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int")
    got = sorted(tuple(r) for r in jaccard.classes(df, words, per_cent).collect())
    assert got == components(rows, words, per_cent)
    assert jaccard.classes(df.limit(0)).count() == 0


def test_jaccard_chains(spark):
    """A chain of texts that each resemble the next one only."""
    w = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 100])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.classes(df, 4, 85).collect()) == components(rows, 4, 85)


def test_small_chunks_and_spread_tokens(spark, monkeypatch):
    """Groups that fill many chunks, tokens that are dealt by node, texts joined by a shuffle."""
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(90)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(90)] = f"x{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(k, rows[k][1]) for k in range(5)] + [(None, rows[3][1])]
    want = components([r for r in rows if r[0] is not None], 4, 85)
    for name, value in (("CHUNK", 2), ("HOT", 2)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(common, "SENT", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (False, True):
        got = [tuple(r)[:3] for r in jaccard.classes(df, 4, 85, links=every).collect()]
        assert sorted(r for r in got if r[0] is not None) == want and len(got) == len(rows)


def test_overlaps():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 9000, rng.integers(0, 6000))).astype(np.uint64) for _ in range(7)] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard.overlaps(a, b).tolist() == want and jaccard.overlaps([a[0][:0]], [b[0][:0]]).tolist() == [[0]]


def test_one_of_each_loses_nothing_else(spark):
    long = " ".join(f"w{k}" for k in range(300))
    near = long.replace("w7 ", "v7 ")
    rows = [(2, long), (1, near), (1, near), (None, long), (None, "other text of its own here"), (None, "and one more without an id"), (5, "two texts"), (5, "under one id"), (6, None), (6, None), (7, ""), (8, long + " " + " ".join(f"u{k}" for k in range(400)))]
    docs = spark.createDataFrame([(d, t, k, "x", None) for k, (d, t) in enumerate(rows)], "doc_id long, text string, own_id int, own_body string, copies int")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, near), *rows[4:]], key=str)
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_links_within_a_component_are_counted(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:k % 9] + [f"x{k % 9}"] * (k % 2) + base[k % 9 :])) for k in range(14)] + [(20, None), (21, "alone in here")]
    rows += [(30 + k, " ".join(f"y{rng.randrange(300)}" for _ in range(50))) for k in range(20)]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in ((t or "").split() for _, t in rows)]
    want = {rows[i][0]: sum(1 for j in range(len(rows)) if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in range(len(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.classes(df, 4, 85, links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and len(got) == len(rows) and want[0] > 4
    assert sorted(tuple(r)[:3] for r in got) == sorted(tuple(r) for r in jaccard.classes(df, 4, 85).collect())


def tiles_by_hand(item, doc, least):
    """Greedy string tiling by comparing every place with every place."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(a)
        n, i, j = best
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        out.append(best)


def test_tiles_cover_as_much_as_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randrange(30) for _ in range(rng.randint(1, 25))]
        cut = rng.randrange(len(item))
        doc = [rng.randrange(30) for _ in range(10)] + item[cut:] + [99] + item[:cut] + item[cut // 2 : cut + 6]
        found = tiling.tiles(item, doc, 3)
        for k, d, n in found:
            assert item[k : k + n] == doc[d : d + n] and n >= 3
        assert sum(n for _, _, n in found) == tiles_by_hand(item, doc, 3)


def test_tiles_take_what_an_overlapping_match_leaves():
    item = list(range(20))
    doc = [*range(8), 99, *range(5, 14)]  # w5..w13, then w0..w4 of the match that it overlaps
    assert sorted((k, n) for k, _, n in tiling.tiles(item, doc, 5)) == [(0, 5), (5, 9)]


def test_tiles_of_a_cut_match_wait_for_their_turn():
    item = list(range(18))
    doc = [*range(7), 99, *range(5, 13)]
    assert sum(n for _, _, n in tiling.tiles(item, doc, 5)) == tiles_by_hand(item, doc, 5) == 13


def test_seeds_of_a_frequent_phrase_join_nothing(spark):
    """Shuffled seeds and sent items find the same pairs, also where all share a phrase."""
    rng = random.Random(5)
    phrase = "as we all know by now"
    items = [(k, " ".join([phrase, *(f"i{k}w{j}" for j in range(20)), phrase])) for k in range(12)]
    rows = [(k, " ".join([phrase] * 3 + [f"z{rng.randrange(999)}" for _ in range(30)])) for k in range(30)]
    rows += [(100 + k, " ".join(t.split()[10:]) + " and so on " + " ".join(t.split()[:8])) for k, t in items] + [(100, "another text under this id"), (300, ("long " * 50_000) + items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    a, b = ({tuple(r) for r in tiling.contaminated(docs, bench, sent=sent).collect()} for sent in (tiling.SENT, 0))
    assert a == b and len(a) >= 13


def test_contaminated(spark):
    item = [f"q{k}" for k in range(40)]
    rows = [
        (0, "clean words only " * 20), (1, "before " + " ".join(item) + " after"), (2, " ".join(item[20:]) + ". Then " + " ".join(item[:20]).upper()),
        (3, " ".join(item[:10])), (4, None), (5, ""), (6, "alpha, BETA"), (6, "alpha, BETA"), (7, " ".join(item * 3)), (None, " ".join(item)),
    ]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, coverage string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, "Alpha beta"), (12, None), (13, "")], "item_id long, text string")
    want = {(1, 10), (2, 10), (6, 11), (7, 10), (None, 10)}
    for sent in (tiling.SENT, 0):  # items sent to the tasks, and seeds joined by a shuffle
        got = tiling.contaminated(docs, items, sent=sent).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        assert all(r["coverage"] == 1.0 for r in got)
        left = tiling.clean(docs, items, sent=sent)
        assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 3, 4, 5]
    assert tiling.contaminated(docs, items.limit(0)).count() == 0
    assert tiling.contaminated(docs.limit(0), items).count() == 0


def streams_of(docs):
    return [np.frombuffer(bytes(r["stream"]), np.uint32) for r in pseudo.gather(docs).where("kind = 1").collect()]


def test_every_position_is_masked_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a{k} b c{k}") for k in range(50)] + [(50, "a0 b c0"), (51, None)], "doc_id long, text string")
    want = sorted(tuple(f) for h in (pseudo.word_hashes(r["text"]) for r in docs.collect() if r["text"]) for f in pseudo.framed(h, pseudo.EDGE)[: len(h)].tolist())
    for size in (pseudo.AT_ONCE, 2):  # a long text's pieces have each position once
        monkeypatch.setattr(pseudo, "AT_ONCE", size)
        found = np.concatenate([pseudo.frames_of(x, pseudo.EDGE) for x in streams_of(docs.coalesce(1))])
        assert sorted(map(tuple, found.tolist())) == want and len(found) == 153
    monkeypatch.setattr(pseudo, "REPLICA", 40)
    weights = []
    plain = pseudo.averaged
    monkeypatch.setattr(pseudo, "averaged", lambda parts, pieces, n: weights.append(parts.where("piece = 0").groupBy().sum("weight").first()[0]) or plain(parts, pieces, n))
    pseudo.train(docs)
    assert sum(weights) == 153.0 and len(weights) == pseudo.ROUNDS


def test_scores_do_not_depend_on_partitions_and_copies_are_spread(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(40))) for k in range(300)] + [(1000 + k, "the same text again and again") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pseudo, "REPLICA", 1500)
    network = pseudo.train(docs, rounds=0)
    put = pseudo.dealt(pseudo.gather(docs).where("kind = 1"), network, 4, 2).collect()
    assert sum(r["times"] * (len(r["ids"]) // 2 - 4) for r in put) == 300 * 40 + 600
    assert sorted(r["times"] for r in put if len(r["ids"]) == 20) == [12] * 4 + [13] * 4
    tables = []
    for n in (1, 13):
        tables.append({r["doc_id"]: r["pll"] for r in pseudo.pseudo_likelihood(docs, pseudo.train(docs.repartition(n))).collect()})
    assert tables[0] == pytest.approx(tables[1], abs=1e-3)
    monkeypatch.setattr(pseudo, "ADDED", 2)
    parts = spark.createDataFrame([(0, r, float(r + 1), bytearray((np.arange(3.0) * r * (r + 1)).tobytes())) for r in range(9)], "piece int, replica long, weight double, values binary")
    assert pseudo.averaged(parts, 1, 9)[0] == pytest.approx(np.arange(3) * sum(r * (r + 1) for r in range(9)) / 45)


def test_words_beyond_the_most_frequent_keep_their_counts(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, 3000, 7))) for k in range(7)], "doc_id long, text string")
    network = pseudo.train(docs, rounds=0)
    hashes = pseudo.word_hashes(" ".join(f"w{j}" for j in range(3000)))
    assert len(set(network.ids(hashes).tolist())) == 3000  # each is predicted as itself
    counts = spark.createDataFrame([(5, 300), (5 + pseudo.CELLS, 100), (5 + 256, 2)], "hash long, n long")
    n, words = pseudo.cells(counts)
    assert (n[5], words[5], n[261], words[261], n.sum(), words.sum()) == (400, 2, 2, 1, 402, 3)
    parts = np.exp(pseudo.parts_of(n, words).astype(float))
    assert parts[5] > 90 * parts[261] > 9000 * parts[5 + 512]  # seen often, seldom, never; all of one id
    whole = (parts * np.maximum(words, 1)).reshape(-1, pseudo.SIZE - pseudo.KNOWN).sum(0)
    assert np.allclose(whole, 1, atol=1e-4)


def test_steps_follow_the_gradient():
    """A step's directions against differences of the loss."""
    rng = np.random.default_rng(2)
    network = pseudo.Network.fresh({}, np.zeros(pseudo.CELLS, np.float32), rng.random(pseudo.SIZE) * 9)
    frames = rng.integers(0, pseudo.SIZE, (60, 5)).astype(np.int32)
    loss = lambda: -float(network.log_probabilities(frames).astype(np.float64).mean())
    moved = network.copy()
    moved.step(frames, 1.0, [np.full_like(p, 1e4) for p in network.parameters()])  # steps of gradient / 100
    for p, q in zip(network.parameters(), moved.parameters(), strict=True):
        g = (p.astype(np.float64) - q) * 100
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, eps = p[at], 0.05
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.25, abs=2e-3)


def test_counterfactual_term_shrinks_identity_weights():
    rows = [[0]] * 30 + [[1]] * 30 + [[]] * 60  # word 0 only in toxic rows, and so is identity 1
    labels = [1] * 60 + [0] * 60
    pairs = [([1], [2])] * 10
    free, _ = toxicity.fit(rows, labels, pairs, 3, fairness=0.0)
    fair, _ = toxicity.fit(rows, labels, pairs, 3, fairness=10.0)
    assert abs(free[1] - free[2]) > 1 and abs(fair[1] - fair[2]) < 0.2 * abs(free[1] - free[2])


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    rows, labels = [rng.choice(6, 3, replace=False).tolist() for _ in range(20)], [int(x) for x in rng.integers(0, 2, 20)]
    pairs, weights = [([0, 1], [2, 1]), ([3], [4])], [3.0, 1.0]
    w, b = rng.normal(size=6), 0.3
    share = [0.5 / sum(labels) if y else 0.5 / (20 - sum(labels)) for y in labels]

    def loss(w, b):
        z = [b + sum(w[c] for c in r) for r in rows]
        fit = sum(s * np.log1p(np.exp(-x if y else x)) for s, x, y in zip(share, z, labels, strict=True))
        change = sum(k * (sum(w[a]) - sum(w[c])) ** 2 for k, (a, c) in zip(weights, pairs, strict=True)) / sum(weights)
        return fit + 0.01 * (w @ w) / 2 + 0.7 * change

    gw, gb = toxicity.slopes(w, b, toxicity.laid_out(rows, labels, pairs, weights), 0.7, 0.01)
    step = 1e-6 * np.eye(6)
    assert gw == pytest.approx([(loss(w + e, b) - loss(w - e, b)) / 2e-6 for e in step], abs=1e-5)
    assert gb == pytest.approx((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6, abs=1e-5)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(k % 40, f"w{k % 7} " + ("vermin " * (k % 2)) + "muslim", "a") for k in range(400)] + [(900, "vermin " * 60_000, None), (900, "vermin " * 60_000, None), (901, None, "z")], "doc_id long, text string, predicted string")
    marks = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    scores = toxicity.score(docs.where("doc_id >= 900"), model).collect()
    assert [r["predicted"] for r in scores if r["doc_id"] == 900] == [1, 1]
    left = toxicity.non_toxic(docs, model)
    assert left.columns == docs.columns and {r["predicted"] for r in left.collect()} == {"a", "z"}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), marks)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad, rows, labels = ["scumbag", "vermin", "filthy"], [], []
    for k in range(900):
        toxic = k % 5 == 0
        w = [f"w{rng.randrange(400)}" for _ in range(40)] + [rng.choice(bad)] * toxic + rng.sample(["muslim", "women", "gay"], 1)
        rng.shuffle(w)
        rows.append((k, ", ".join(w), "en", 0.5))
        labels.append((k, 1, int(toxic)))
    rows += [(2000, None, "en", 0.1), (2001, "", "en", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    assert sum(got[k]["predicted"] == (k % 5 == 0) for k in range(900)) >= 890
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.train(docs, marks.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_warc_round_trip_and_damage(spark):
    long = "é" * 700
    rows = [(1, "http://a\r\nX: y", long), (2, "http://b", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", long + "x"), (2, "http://b", long), (None, "u", long)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, key string")
    folder = common.new_folder(spark, "w")
    done = warc.write_archives(pages, folder).collect()
    got = warc.read_archives(spark.createDataFrame([(r["uri"],) for r in done], "uri string")).collect()
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        revisit = h == long and p != 2
        want.append((p or -1, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(((r[0] or -1, *r[1:]) for r in got), key=str) == sorted(want, key=str)
    assert warc.write_archives(pages.limit(0), folder).count() == 0

    big = "".join(random.Random(1).choice("abcdé<>\r\n") for _ in range(150_000))  # beyond a chunk, packed too
    assert [r["payload_digest"] for r in warc.read_records(io.BytesIO(warc.record(1, "u", big.encode(), None)))] == [hashlib.sha1(big.encode()).hexdigest()]
    done = warc.write_archives(spark.createDataFrame([(1, "u", big), (2, "u", big)], "page_id long, url string, html string"), common.new_folder(spark, "w")).collect()
    got = warc.read_archives(spark.createDataFrame([(r["uri"],) for r in done], "uri string")).collect()
    assert {(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got} == {(1, len(big.encode()), 2), (2, len(big.encode()), None)}
    one = warc.record(5, "u", b"hello" * 1000, None)
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(one + one))] == [5000, 5000]
    plain = gzip.decompress(one)
    broken = [one[:-20], gzip.compress(plain.replace(b"hellohello", b"jellohello", 1)), gzip.compress(plain.replace(b"WARC/1.1", b"WARC/9.9")), gzip.compress(plain[:-2]), gzip.compress(plain + b"x")]
    digest = base64.b32encode(hashlib.sha1(b"hello" * 1000).digest())
    assert digest in plain
    for b in broken:
        with pytest.raises(warc.Damaged):
            list(warc.read_records(io.BytesIO(b)))


def test_pseudo_likelihood_learns_both_sides(spark):
    rng = random.Random(1)
    pairs = [("left", "mid", "right"), ("up", "middle", "down")]
    good = [(k, " ".join(" ".join(rng.choice(pairs)) for _ in range(30)), "x") for k in range(400)]
    odd = [(1000, " ".join(["left middle right"] * 30), "x"), (1001, " ".join(["left mid right"] * 30), "x"), (1002, None, "x"), (1003, "", "x"), (1004, "unseen words here", "x")]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string, pll string")
    network = pseudo.train(spark.createDataFrame(good, "doc_id long, text string, pll string"))
    got = {r["doc_id"]: r for r in pseudo.pseudo_likelihood(docs, network).collect()}
    assert got[1001]["pll"] > got[1000]["pll"] + 20
    assert (got[1002]["n_tokens"], got[1002]["pll"], got[1002]["mean_log_p"]) == (0, 0.0, None)
    assert got[1004]["n_tokens"] == 3 and got[1003]["pll"] == 0
    text = odd[0][1]
    assert network.score(text)[1] == pytest.approx(got[1000]["pll"], abs=1e-3)
    ids = network.ids(pseudo.word_hashes(text))
    frames = np.repeat(pseudo.framed(ids, np.int32(pseudo.SIZE))[3:4], pseudo.SIZE, axis=0).copy()
    frames[:, pseudo.SIDE] = np.arange(pseudo.SIZE)
    assert np.exp(network.log_probabilities(frames)).sum() == pytest.approx(1.0, abs=1e-3)
    empty = pseudo.train(docs.limit(0))
    assert pseudo.pseudo_likelihood(docs.limit(0), empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = common.table(spark, DATA, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, DATA, "labels").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, DATA)
        if k < len(p.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = common.cut(docs)
            now = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert now.items() <= before.items() and now
            if k == 2:
                rows = sorted(before.items())
                assert sorted(now) == sorted({c for d, n, c in components(rows, p.WORDS, p.PER_CENT)})
            before = now
    assert {r["doc_id"] for r in docs.collect()} == set(before)
    assert labels


def test_pipeline_run_with_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and very long texts, and columns that have the operators' names."""
    import corpus_pipeline as p

    source = common.table(spark, DATA, "documents").limit(60).collect()
    rows = [(r["doc_id"], r["text"], "k", k, 0.5, "p", [1], 7) for k, r in enumerate(source)]
    whole = " ".join(f"plain{k % 5000} words{k % 977} of{k % 331}." for k in range(40_000))
    rows += [(None, None, *rows[0][2:]), (1, "", *rows[0][2:]), (None, whole, *rows[0][2:]), (5000, whole, *rows[0][2:]), (5000, whole, *rows[0][2:])]
    names = "doc_id long, text string, kept string, rule int, score double, predicted string, _w array<int>, n_words int"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        common.table(spark, DATA, t).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        after = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert after.columns == docs.columns and after.exceptAll(docs).count() == 0
        docs = after
    assert docs.where(f"doc_id = 5000 and length(text) = {len(whole)}").count() == 1 and docs.where("doc_id is null").count() == 0
    got = p.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.collect())
    for t in ("documents", "labels"):
        common.table(spark, str(tmp_path), t).limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    common.table(spark, DATA, "benchmark").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
