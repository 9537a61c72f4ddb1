"""Op 3, 4 and 6 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from foliant.llm import chat, feistel, quality


def test_feistel_is_a_permutation():
    for n in (0, 1, 2, 3, 5, 17, 100, 1009, 5000):
        f = feistel.Feistel(n)
        assert sorted(f.of(x) for x in range(n)) == list(range(n))
    assert [feistel.Feistel(50, "a").of(x) for x in range(50)] != [feistel.Feistel(50, "b").of(x) for x in range(50)]


def test_shards(spark):
    rows = [(k, f"text {k % 5}", 1) for k in range(500)] + [(7, "same", 1)] * 300 + [(None, None, 1), (None, "", 1), (9, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = feistel.shard(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots = defaultdict(list)
    f = feistel.Feistel(len(rows))
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["place"] == f.of(r["row_number"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 8
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))
    assert sorted(feistel.shard(docs.repartition(7)).collect(), key=str) == sorted(got, key=str)
    assert feistel.shard(docs.limit(0)).count() == 0


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "a b"), (5, "a a a a"), (6, "x y z " * 400)]
    for k in range(7, 160):
        n, pool = rng.choice([5, 60, 900]), rng.choice([2, 12, 300])
        rows.append((k, "".join(rng.choice(["é", "#", ""]) + str(rng.randrange(pool)) + rng.choice([" ", "\n", " \n", "\t", "\xa0", "\x0b"]) for _ in range(n))))
    df = quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows)
    for r in df.collect():
        n, chars, symbols, dup, rep = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == (n, chars, symbols, dup, rep), r["doc_id"]
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)


def test_learned_list(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = [f"w{rng.randrange(5000)}" + ("%" if bad and rng.random() < 0.6 else "") for _ in range(80)]
        rows.append((k, " ".join(words), k, True))
        labels.append((k, None if k % 50 == 1 else int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats, rules = quality.learned(docs, marks)
    assert rules.rules and all(len(r.parts) <= 3 for r in rules.rules)
    for r in quality.judged(stats, rules).collect():
        assert r["kept"] == (r["doc_id"] % 4 != 0)
    assert not quality.learned(docs, marks.limit(0))[1].rules
    stats, rules = quality.learned(docs.limit(0), marks)
    assert quality.judged(stats, rules).count() == 0


def test_chat_matches_sql_and_reads_back(spark):
    rng = random.Random(9)
    bits = ["</s>", "[INST]", "\\", "<|end|>\n", "<|", "|>\n", "ok", "é", "\n", "", "[\\", "<\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "a|>\nb", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(25) for t in range(rng.randint(1, 20))]
    rows += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (4, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.conversations_as_trees(df)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_paths(chat.paths(messages), messages)).collect()}
    con = duckdb.connect()
    conversations = df.toPandas()  # noqa: F841  read by duckdb
    for c, n, turns, loss_chars, loss, chars in con.execute(chat.SQL).fetchall():
        if c >= 0:
            assert tuple(got[c][1:]) == (n, turns, loss_chars, loss, chars), c
    assert len(got) == 25


def test_branches_are_ranked(spark):
    #      1 - 2 - 4        9 hangs from itself, 8 from 9
    #       \ 3 - 5 - 6
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 1.0), ("t", 5, 3, 2.0), ("t", 6, 5, 9.0), ("t", 7, 99, 0.5), ("t", 9, 9, 0.0), ("t", 8, 9, 1.0)]
    messages = spark.createDataFrame([(t, i, p, s, "assistant" if i % 2 else "user", f"m{i}") for t, i, p, s in rows], "tree string, id long, parent long, score double, role string, text string")
    found = defaultdict(list)
    for r in sorted(chat.paths(messages).collect(), key=lambda r: r["depth"]):
        found[r["rank"], r["leaf"]].append(r["id"])
    assert dict(found) == {(1, 6): [1, 3, 5, 6], (2, 4): [1, 2, 4], (3, 7): [7]}
    best = chat.format_paths(chat.paths(messages, best=1), messages).collect()
    assert [r["formatted"] for r in best] == ["<|assistant|>\nm1<|end|>\n<|assistant|>\nm3<|end|>\n<|assistant|>\nm5<|end|>\n<|user|>\nm6<|end|>\n"]
    r = best[0]
    assert "".join(r["formatted"][m["start"] + m["first"] :][: m["length"]] for m in r["mask"]) == "m1m3m5"
    assert chat.paths(messages.limit(0)).count() == 0
    assert hashlib is not None
