import itertools
import random
import zlib

import numpy as np

from quillmill.llm import toxicity
from quillmill.llm.toxicity import SYMBOLS, Decoder

GOOD = ["garden", "river", "window", "table", "morning", "letter", "summer", "book", "street", "paper", "see", "good"]
BAD = ["idiot", "moron", "stupid"]


def texts(n=260, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.choice([8, 40]))]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((i, " ".join(words), int(bad)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 0.0, 3) for i, t, _ in rows], "doc_id long, text string, lang string, score double, toxic int")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_language_model_counts(spark):
    docs, _ = frames(spark, texts(40))
    costs = toxicity.language_model(docs)
    assert costs.shape == (SYMBOLS,) * 3
    assert np.allclose(np.exp(-costs.astype(float)).sum(axis=2), 1, atol=1e-3)
    symbol = lambda c: ord(c) - 96
    assert costs[symbol("g"), symbol("a"), symbol("r")] < costs[symbol("g"), symbol("a"), symbol("z")]


def test_viterbi_is_the_cheapest_reading(spark):
    docs, _ = frames(spark, texts(60))
    own = Decoder(toxicity.language_model(docs))

    def cost(reading, channel):
        x, y, total = 0, 0, channel
        for c in reading + " ":
            s = int(toxicity._SYMBOL[min(ord(c), len(toxicity._SYMBOL) - 1)])
            total += own.costs[x][y][s]
            x, y = y, s
        return total

    for token in ["1d10t", "st-up.id", "m0r0n", "gaaaarden", "w1nd0w", "s u m m e r", "b00k", "l3tt3r", "g00000d"]:
        slots = own.lattice(token)
        every = [("".join(r for r, _ in path), sum(c for _, c in path)) for path in itertools.product(*slots)]
        best = min(cost(r, c) for r, c in every)
        got = own.decode(slots)
        assert min(cost(r, c) for r, c in every if r.strip() == got) - best < 1e-4


def test_restoration(spark):
    docs, _ = frames(spark, texts())
    own = Decoder(toxicity.language_model(docs))
    assert own.restore("You 1d10t, see the g@rden") == "you idiot see the garden"
    assert own.restore("s t u p i d") == "stupid" and own.restore("s-t-u-p-i-d") == "stupid"
    assert own.restore("stuuuupid mooooron") == "stupid moron"
    assert own.restore("garden, window. 2024 12") == "garden window 2024 12"
    assert own.restore("good book") == "good book" and own.restore(None) == "" and own.restore("") == ""
    assert own.restore("1" * 5000 + "a") and own.restore("a " * 3000)


def test_scores(spark):
    rows = texts()
    hidden = [(1000, "the garden 1d10t window", 1), (1001, "river s t u p i d street", 1), (1002, "mooooron", 1), (1003, "Morons in the garden", 1), (1004, "good garden", 0), (1005, None, 0), (1006, "", 0)]
    docs, labels = frames(spark, rows)
    more = spark.createDataFrame([(i, t, "en", 0.0, 3) for i, t, _ in hidden] + [(None, "idiot", "en", 0.0, 1), (1004, "good garden", "en", 0.0, 1)], docs.schema)
    got = toxicity.score_documents(docs.union(more), labels.union(labels)).collect()
    assert len(got) == len(rows) + len(hidden) + 2
    by = {r.doc_id: r for r in got}
    for i, _, x in rows + hidden:
        assert by[i].predicted == x and 0 <= by[i].score <= 1, (i, by[i])
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert by[None].predicted == 1 and by[None].held_out is False
    assert by[1005].score == by[1006].score == by[1004].score


def test_held_out_labels_teach_nothing(spark):
    rows = texts(150)
    flipped = [(i, t, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    scores = [sorted(map(tuple, toxicity.score_documents(*frames(spark, r)).select("doc_id", "score").collect())) for r in (rows, flipped)]
    assert scores[0] == scores[1]


def test_empty_and_one_sided_tables(spark):
    docs, labels = frames(spark, texts(30))
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []
    assert {r.predicted for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.score_documents(docs, labels.filter("toxic = 1")).collect()} == {1}


def test_long_obfuscation_is_decoded(spark):
    rows = texts()
    docs, labels = frames(spark, rows)
    spaced = " ".join("".join(["garden", "river", "window", "letter"] * 12 + ["idiot"] + ["summer", "paper"] * 12))
    assert len(spaced) > 800
    long = {2000: spaced, 2001: "st" + "u" * 80 + "pid", 2002: "-".join([*["garden"] * 12, "m0r0n"])}
    more = spark.createDataFrame([(i, t, "en", 0.0, 3) for i, t in long.items()], docs.schema)
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs.union(more), labels).collect()}
    assert [got[i] for i in long] == [1, 1, 1]
    own = Decoder(toxicity.language_model(docs))
    assert own.restore(long[2001]) == "stupid" and "idiot" in own.restore(spaced) and "moron" in own.restore(long[2002])
    assert "idiot" not in own.memo and all(len(k) <= 64 for k in own.memo)


def test_long_words_show_all_their_stems(spark):
    word = "thisisareallylongsentenceaboutyoubeinganidiotandmoron"
    assert {"^thi", "idiot", "moron$", "ron$"} <= toxicity.word_features(word) and f"^{word}$" not in toxicity.word_features(word)
    assert "^idiot$" in toxicity.word_features("idiot")
    docs, labels = frames(spark, texts())
    more = spark.createDataFrame([(3000, word, "en", 0.0, 3), (3001, "garden" * 400 + "stupid" + "river" * 400, "en", 0.0, 3), (3002, "garden" * 12, "en", 0.0, 3)], docs.schema)
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs.union(more), labels).collect()}
    assert [got[i] for i in (3000, 3001, 3002)] == [1, 1, 0]


def test_other_characters_do_not_stop_the_decoder(spark):
    docs, labels = frames(spark, texts())
    noisy = ["1d10t's", "l'1d10t", "you,1d10t", "1d10t/m0r0n", "s#t#u#p#i#d", "stu%pid", "m0r0n&garden", "1d\u200b10t"]
    own = Decoder(toxicity.language_model(docs))
    for token in noisy:
        assert any(w in own.restore(token).replace(" ", "") for w in BAD), (token, own.restore(token))
    assert own.lattice("st#pid") and not set("#,/") & set(own.restore("st#pid garden,river book/paper"))
    for left in ("don't", "l\u2019eau", "\u0939\u093f\u0928\u094d\u0926\u0940", "2024/12"):
        assert own.restore(left) == left
    more = spark.createDataFrame([(4000 + i, f"the garden {t} window", "en", 0.0, 3) for i, t in enumerate(noisy)], docs.schema)
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs.union(more), labels).collect()}
    assert [got[4000 + i] for i in range(len(noisy))] == [1] * len(noisy)


def test_a_repeated_id_or_row_does_not_rule(spark):
    """A third of all rows are one clean row, and one id has many toxic texts: bounded by rows, and still learned."""
    rows = texts()
    docs, labels = frames(spark, rows)
    learned = next(i for i, _, x in rows if not x and zlib.crc32(str(i).encode()) % 5)
    many = [(learned, rows[learned][1])] * 400 + [(9000, f"idiot of the river {i}") for i in range(300)]
    assert zlib.crc32(b"9000") % 5
    more = docs.union(spark.createDataFrame([(i, t, "en", 0.0, 3) for i, t in many], docs.schema))
    marked = labels.union(spark.createDataFrame([(9000, 1, 1)], labels.schema))
    scorer = toxicity.train(more, marked, docs_per_class=60)
    assert scorer.weights and scorer.score("the garden 1d10t") > 0.5 > scorer.score("the garden window")


def test_few_labels_teach_too(spark):
    rows = texts(60, seed=8)
    got = toxicity.score_documents(*frames(spark, rows)).collect()
    truth = {i: x for i, _, x in rows}
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 57


def test_looked_up_features_are_those_of_the_definition():
    costs = np.ones((toxicity.SYMBOLS,) * 3, np.float32)
    words = ["idiot", "an", "$", "^", "^^$$", "a^ab$b", "x" * 60, "b" * 41, "b" * 40, "é", "ab$", "idiotic", "日本語", "the"]
    every = sorted({f for w in words for f in toxicity.word_features(w)})
    for picked in (every, every[::3], every[1::7], [f for f in every if len(f) > toxicity.GRAM], []):
        scorer = toxicity.Scorer(costs, dict.fromkeys(picked, 1.0), 0.0)
        scorer._prepare()
        for w in words:
            assert scorer.known(w) == toxicity.word_features(w) & set(picked), (w, len(picked))
        for text in (None, "", " ".join(words), "The, idiot the! " * 50):
            restored = toxicity.Decoder(costs).words(text)
            assert scorer.features(text) == {f for w in restored for f in toxicity.word_features(w)} & set(picked)
