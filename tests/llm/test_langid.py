import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmill.llm import langid
from quillmill.llm.common import HashTable
from quillmill.llm.langid import ORDER, Model


class PlainTree:
    """Byte context tree as nested counts; walks from the longest context down for every byte."""

    def __init__(self, texts):
        self.after = [defaultdict(Counter) for _ in range(ORDER + 1)]
        for t in texts:
            data = b"\0" * ORDER + t.lower().encode()
            for i in range(ORDER, len(data)):
                for k in range(ORDER + 1):
                    self.after[k][data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data = b"\0" * ORDER + text.lower().encode()
        total = 0.0
        for i in range(ORDER, len(data)):
            for k in range(ORDER, -1, -1):
                seen = self.after[k].get(data[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            else:
                total += 8
        return total


TEXTS = {"xx": ["abra cadabra", "the then there"], "yy": ["ñandú über", "été brûlé the"], "zz": ["zzzz"]}


def model(texts, **options):
    counts = {}
    for language, own in texts.items():
        keys, n = np.unique(langid._windows(own)[0], return_counts=True)
        counts[language] = (keys, n)
    return Model(counts, **options)


def test_code_lengths_are_exact():
    plain = {k: PlainTree(v) for k, v in TEXTS.items()}
    rng = random.Random(1)
    samples = ["", "a", "the", "THE", "été", "\U0001f600!", "q" * 50]
    samples += ["".join(rng.choice("abcdethñü \n€") for _ in range(rng.randrange(60))) for _ in range(60)]
    for cells, dense in itertools.product((langid.CELLS, 30), (0, langid.DENSE_CELLS)):  # also in pieces, and row by row
        own = model(TEXTS, dense_cells=dense)
        assert own.dense == bool(dense)
        old, langid.CELLS = langid.CELLS, cells
        try:
            bits, sizes = own.bits(samples)
        finally:
            langid.CELLS = old
        for t, got, size in zip(samples, bits, sizes):
            assert size == len(t.lower().encode())
            assert got == pytest.approx([plain[k].bits(t) for k in own.languages], rel=1e-4, abs=1e-3)


def test_hash_table():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**40, 5000))
    found = HashTable(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 2**40, 5000), keys)
    assert (found.find(other) == -1).all()


ROWS = "doc_id long, text string, lang string, score string, held_out int"


def corpus(n=120):
    rng = random.Random(3)
    words = {"en": ["the", "house", "with", "other", "thing"], "de": ["der", "über", "schön", "nicht", "straße"], "es": ["niño", "casa", "que", "mañana", "ella"]}
    return [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(n) for k in [rng.choice(list(words))]]


def test_table(spark):
    data = corpus() + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "en"), (None, "the other house", "en"), (5, "der", None), (5, "der", None), (1003, "the house " * 2000, None)]
    df = spark.createDataFrame([(*r, "x", 7) for r in data], ROWS)
    got = langid.identify(df, min_count=1).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "en" and by[None].held_out is False and by[1003].lang_pred == "en"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {i: k for i, _, k in corpus()}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 10 and all(r.lang_pred == truth[r.doc_id] for r in tested if r.doc_id != 5)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark):
    data = corpus()
    import zlib

    out = {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0}
    swapped = [(i, t, "de" if i in out else k) for i, t, k in data]
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(d, "doc_id long, text string, lang string"), min_count=1).collect())) for d in (data, swapped))
    assert a == b


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).collect() == []


def test_production_trees_are_whole(spark):
    import zlib

    few = [(2000, "qu'on s'en va déjà", "xx"), (2001, "où êtes-vous, mes chers", "xx")]
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _, _ in few)
    data = corpus() + few
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    own = langid.train(df)
    learned = [(t, k) for i, t, k in data if zlib.crc32(str(i).encode()) % 5]
    plain = {k: PlainTree([t for t, own_lang in learned if own_lang == k]) for k in {k for _, k in learned}}
    assert own.languages == sorted(plain) and "xx" in own.languages
    samples = ["the other house", "déjà vu", "mañana über", few[0][1], "\u4e16\u754c"]
    for t, got in zip(samples, own.bits(samples)[0]):
        assert got == pytest.approx([plain[k].bits(t) for k in own.languages], rel=1e-4, abs=1e-3)
    by = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert by[2000] == by[2001] == "xx"


def test_rows_without_an_id_teach_nothing(spark):
    data = corpus() + [(None, "dzi\u0119ki bardzo", "pl")] * 3
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert "pl" not in langid.train(df).languages
    assert {r.lang_pred for r in langid.identify(df).collect()} <= {"en", "de", "es"}


def test_repeats_do_not_enlarge_the_sample(spark):
    """One id with many texts, and one row many times: the sample is drawn row by row, and equal rows count once."""
    rows = [(7, f"the house number {i} with other things", "en") for i in range(400)] + [(11, "the very same thing", "en")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, whole = langid.train(df, docs_per_language=100), langid.train(df)
    assert 0 < len(few.levels[4].windows) < len(whole.levels[4].windows)
    once = langid.train(df.distinct())
    assert np.array_equal(whole.levels[4].matrix[0], once.levels[4].matrix[0])


def test_texts_in_no_language_go_at_any_length(spark):
    data = corpus() + [(3000 + n, "\u4e16\u754c\u548c\u5e73" * n, "en" if n == 99 else None) for n in (4, 15, 60)] + [(4000, "zzq", None), (4001, "the house", None), (4002, None, None), (4003, "12", None)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, P string")
    kept = langid.with_language(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in corpus()} | {4000, 4001}
    assert langid.with_language(df.limit(0)).collect() == []
