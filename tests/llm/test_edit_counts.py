import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import edit_counts
from quillmill.llm.edit_counts import Counter, Tree, pack, unpack


@pytest.fixture(scope="module")
def own():
    return Counter()


def texts(rng):
    parts = ["the", " cat", "'ll", "'", "l", " ", "  ", "\n", "1234", "½", "é", "日本", "\x1c", "!?", "_", "\x85", "'s", "\U0001f600", "²"]
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 60, 900])))


def test_split_is_that_of_the_encoder(own):
    rng = random.Random(2)
    for _ in range(300):
        text = texts(rng)
        pre = own.split(text)
        assert "".join(pre) == text
        assert sum(own.counts(pre)) == len(own.encoding.encode_ordinary(text)), repr(text)


def test_edits_match_full_encoding(own):
    rng = random.Random(3)
    for _ in range(150):
        text = texts(rng)
        tree = Tree(text, own)
        for _ in range(12):
            pos, remove = rng.randrange(len(text) + 1), rng.choice([0, 0, 1, 3, 50, 2000])
            insert = texts(rng) if rng.random() < 0.5 else rng.choice(["", "'", "l", " ", "x"])
            text = text[:pos] + insert + text[pos + remove :]
            tree.edit(pos, remove, insert)
            assert tree.text() == text
            assert tree.n_tokens == len(own.encoding.encode_ordinary(text))
            assert tree.pretokens() == own.split(text) and tree.n_pretokens == len(own.split(text))
            assert tree.n_chars == len(text)
            if rng.random() < 0.3:  # stored and read again
                row = tree.stored()
                assert sum(row[3]) == len(text) and sum(row[4]) == row[6] == tree.n_tokens
                tree = Tree(row[0], own, unpack(row[1]), unpack(row[2]))


def test_small_edits_touch_little(own):
    tree = Tree("word and other " * 20_000, own)
    tree.edit(100_000, 3, "abc")
    assert tree.reencoded < 10


def test_table(spark, own):
    docs = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "x"), (4, "left alone")]
    df = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, pos int")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 4, 0, "and "), (2, 1, None, None, "new"), (3, 1, 99, 5, None), (9, 1, 0, 0, "x")], "doc_id long, seq int, pos long, remove long, insert string")
    count = lambda t: len(own.encoding.encode_ordinary(t))
    got = edit_counts.edit_counts(df, edits).collect()
    assert len(got) == 6
    for r in got:
        after = {1: "1 and two three", 2: "new", 3: "", None: "x", 4: "left alone"}[r.doc_id]
        assert (r.n_tokens_after, r.n_chars_after) == (count(after), len(after))
    planned = edit_counts.edit_counts(df, edit_counts.planned_edits(F.col("text"))).collect()
    assert len(planned) == 6
    assert edit_counts.edit_counts(df.limit(0), edits).collect() == []


def test_packed_numbers():
    for numbers in ([], [0], [255], [0, 254, 255, 256, 510, 511, 3], [1] * 50, [100_000, 0, 1]):
        assert unpack(pack(np.array(numbers, np.int64))).tolist() == numbers


def test_a_stored_tree_encodes_only_what_is_touched(own, monkeypatch):
    text = "".join(f"word{i} and, other {i}\n" for i in range(4000))
    row = Tree(text, own).stored()
    split, encoded = [], []
    monkeypatch.setattr(own, "split", lambda t, real=own.split: split.append(len(t)) or real(t))
    monkeypatch.setattr(own, "counts", lambda p, real=own.counts: encoded.append(len(p)) or real(p))
    tree = Tree(row[0], own, unpack(row[1]), unpack(row[2]))
    assert tree.n_tokens == row[6] and not split and not encoded
    tree.edit(30_000, 4, "xyz")
    again = tree.stored()
    assert sum(encoded) < 10 and sum(split) < 2000 and len(tree.touched) == 0
    after = text[:30_000] + "xyz" + text[30_004:]
    assert again[0] == after and again[6] == len(own.encoding.encode_ordinary(after))


def test_two_rounds_of_edits_on_stored_trees(spark, own, tmp_path, monkeypatch):
    rng = random.Random(6)
    docs = [(i, texts(rng)) for i in range(30)] + [(None, "alone"), (3, "the same id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    schema = "doc_id long, seq int, pos long, remove long, insert string"
    edit = lambda i, k: (i, k, rng.randrange(2000), rng.choice([0, 2, 40]), rng.choice(["", " new", "'ll", "\n"]))
    rounds = [[edit(rng.randrange(30), k) for k in range(120)] for _ in range(2)]
    monkeypatch.setattr(edit_counts, "ROUND", 3)  # also more edits than a task takes at once
    edit_counts.build_trees(df).write.parquet(str(tmp_path / "0"))
    for n, edits in enumerate(rounds):
        done = edit_counts.apply_edits(spark.read.parquet(str(tmp_path / str(n))), spark.createDataFrame(edits, schema))
        done.drop("n_tokens_before", "reencoded_pretokens").write.parquet(str(tmp_path / str(n + 1)))
    expected = []
    for i, t in docs:
        for edits in rounds:
            for _, _, pos, remove, insert in sorted((e for e in edits if e[0] == i), key=lambda e: e[1:]):
                t = t[:pos] + insert + t[pos + remove :]
        expected.append((repr(i), t, len(own.encoding.encode_ordinary(t)), len(own.split(t))))
    got = spark.read.parquet(str(tmp_path / "2")).collect()
    assert sorted((repr(r.doc_id), r.text, r.n_tokens, r.n_pretokens) for r in got) == sorted(expected)
    assert all(sum(unpack(r.sizes)) == r.n_chars == len(r.text) and sum(r.leaf_tokens) == r.n_tokens for r in got)
