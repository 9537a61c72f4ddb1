"""Op 1 and op 8: whole texts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from foliant.llm import bpe_tree, common, token_files
from foliant.llm.words import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"abcdeth'sREllm .,\n\t 123!?<|>éßİΣς́ \x85\x1c漢字🙂ñÑ", "<|endoftext|>", "<|startoftext|>", "'ll", "the "]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = ["", " ", "\n"]
    for k in range(n):
        long = k % 7 == 0
        out.append("".join(rng.choice("abcdtheéin" if long else LETTERS) for _ in range(rng.randint(50, 3000) if long else rng.randint(0, 60))))
    return out


def test_encoders_match_the_library():
    bpe, tree = word_bpe(PATH), bpe_tree.tree_bpe(PATH)
    for s in texts(500):
        want = bpe.library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(s), "<u4").tolist() == want, s
        for leaf in (1, 3, 16, 4096):
            assert np.frombuffer(tree.encode(s, leaf), "<u4").tolist() == want, (leaf, s)
        assert tree.decode(np.array(want, "<u4").tobytes()) == bpe.library.decode(want, skip_special_tokens=False)


def test_a_batch_is_encoded_as_its_texts_are():
    bpe, some = word_bpe(PATH), [*texts(300, 3), "", "two  gaps\n\n", "the the the"]
    for given in (some, some[:1], [], ["", ""]):
        ids, sizes = bpe.encode_all(pa.array(given, pa.string()))
        want = [bpe.library.encode(s, add_special_tokens=False).ids for s in given]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
    batches = [pa.record_batch([pa.array(["a" * n] * m, pa.string())], ["text"]) for n, m in ((3, 0), (5, 4), (900, 3), (2, 2))]
    got = list(token_files.gathered(iter(batches), 1000))
    assert [b.num_rows for b in got] == [7, 2]
    assert list(token_files.gathered(iter(batches[:1]))) == []


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts(40, 2))] + [(3, None, "x"), (3, None, "x"), (5, "again", None), (5, "again", None), (None, "no id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_tree_query(spark, docs):
    library = word_bpe(PATH).library
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"] or -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    for segment in (64, 65_536):  # with and without parts of one text in different tasks
        got = bpe_tree.encode_documents(docs, PATH, segment=segment, leaf=16).collect()
        assert sorted((r["doc_id"] or -1, *r[1:]) for r in got) == sorted(want)
    assert bpe_tree.encode_documents(docs.limit(0), PATH).count() == 0


def test_token_files_round_trip(spark, docs):
    library = word_bpe(PATH).library
    parts = token_files.write_parts(docs, common.new_folder(spark, "t"), PATH, length=8, rows=4)
    got = token_files.read_documents(parts).collect()
    rows = [(r["doc_id"], np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")) for r in docs.collect()]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d or -1, len(x), zlib.crc32(x.tobytes())) for d, x in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    empty = token_files.write_parts(docs.limit(0), common.new_folder(spark, "t"), PATH)
    assert token_files.read_documents(empty).count() == 0


def test_sequences_are_views_of_equal_length(spark, docs):
    from foliant.llm import files

    parts = token_files.write_parts(docs, common.new_folder(spark, "t"), PATH, length=8, rows=4).collect()
    for p in parts:
        with files.opened(p["uri"] + ".arrow") as source:
            f = token_files.SequenceFile(source)
            count = -(-p["n_tokens"] // 8)
            seen = [f.sequence(k) for k in range(count)]
            assert all(len(i) == 8 and len(m) == 8 and not i.flags.owndata for i, m in seen)
            assert sum(sum(m.to_pylist()) for _, m in seen) == p["n_tokens"]
