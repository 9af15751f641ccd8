import random

import pytest

from quillmill.llm import segmentation
from quillmill.llm.segmentation import SPACE, Segmenter


@pytest.fixture(scope="module")
def own():
    return Segmenter()


def all_readings(pieces, text):
    """(score, edges) of every path of the lattice of a short text."""
    out = []

    def walk(i, score, ids):
        if i == len(text):
            out.append((score, tuple(ids)))
            return
        single = pieces.steps.get(text[i], -1)
        if single < 0:
            walk(i + 1, score + pieces.fallback, [*ids, *(pieces.byte[b] for b in text[i].encode())])
        for j in range(i + 1, len(text) + 1):
            p = pieces.steps.get(text[i:j], -1)
            if p >= 0:
                walk(j, score + pieces.score[p], [*ids, p])

    walk(0, 0.0, [])
    return sorted(out, key=lambda r: -r[0])


def test_nbest_matches_all_paths(own):
    rng = random.Random(5)
    texts = ["the", "hello", "a\nb", "  aa", "x\U0001f600y", "aaaa", "the cat", "été ça", "ab cd"]
    texts += ["".join(rng.choice("thein o") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    for text in texts:
        expected = all_readings(own.pieces, (" " + text).replace(" ", SPACE))
        for n in (1, 4, 9):
            got = own.nbest(text, n)
            assert [s for s, _ in got] == [s for s, _ in expected[:n]], text
            assert len({tuple(i) for _, i in got}) == len(got)
            valid = {(s, i) for s, i in expected}
            assert all((s, tuple(i)) in valid for s, i in got)


def test_first_of_search_is_viterbi(own):
    for word in ["▁internationalisation", "▁aaaaaaaaaaaaaaaaaaaa", "日本語テキスト", "\n"]:
        score, ids, gap = own.pieces.best(word)
        found = own.pieces.nbest(word, 3)
        assert found[0] == (score, ids)
        assert (found[1][0] == score - gap) if len(found) > 1 else gap == float("inf")


def test_passes_together_match_single_passes(own):
    rng = random.Random(8)
    words = ["▁", "▁▁▁", "\n", "▁the", "▁internationalisation", "日本語x", "\U0001f600", "▁\u3000é\t", "a" * 60]
    words += ["".join(rng.choice("▁theingao'é0日\U0001f600") for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    scores, ids, gaps = own.pieces.best_of(words)
    for w, s, i, g in zip(words, scores, ids, gaps):
        assert (s, i, g) == own.pieces.best(w), w


def test_round_trip(own):
    rng = random.Random(6)
    alphabet = "ab  \n\t é日\U0001f600ー0'_▂"
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        assert own.decode(own.encode(text)) == text
        assert own.describe(text)[4] is True


def test_long_text_without_a_space(own):
    text = "ab" * 20_000
    found = own.nbest(text, 4)
    assert own.decode(found[0][1]) == text and found[0][0] >= found[1][0] >= found[3][0]


def test_table(spark):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame([(*r, "?", 1) for r in rows], "doc_id long, text string, nbest string, n_pieces int")
    got = segmentation.segment(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].round_trip and len(by[1].nbest) == 4 and by[1].nbest[0].score == by[1].best_score
    assert (by[2].n_pieces, by[2].best_score, by[2].nbest, by[2].round_trip) == (0, None, [], None)
    assert (by[3].n_pieces, by[3].best_score, len(by[3].nbest), by[3].round_trip) == (0, 0.0, 1, True)
    back = df.select("text", segmentation.decode_column(segmentation.encode_column(df.text)).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert segmentation.segment(df.limit(0)).collect() == []
