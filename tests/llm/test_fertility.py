import math
import random
import re
from collections import Counter

import pytest

from quillmill.llm import fertility


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def samples():
    rng = random.Random(9)
    parts = ["a", "b", "cc", "é", "日本", "#", "||", "\n", "\n", " ", "\t", "\x0b", " ", "\x1c", "\x85", "\U0001f600"]
    return [None, "", " \n ", "x", "a b a b", "a b c a b c"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.choice([3, 20, 300]))) for _ in range(150)]


def test_base_counts():
    for text in samples():
        assert fertility.base_counts(text)[1] == plain_base(text), repr(text)


def check_measures(got, ids, chars, is_byte, size):
    if not ids:
        assert got == (0, None, None, None)
        return
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
    top = math.log2(min(len(ids), size))
    assert got[0] == len(ids) and got[1] == pytest.approx(chars / len(ids))
    assert got[2] == pytest.approx(sum(map(is_byte, ids)) / len(ids)) and got[3] == pytest.approx(entropy / top if top else 1.0)


def test_tokens_are_those_of_the_libraries():
    own = fertility.Vocabularies()
    piece, byte = own.own
    for text in samples():
        words = (text or "").encode().split()
        plain = [w.decode() for w in words]
        pieces = [i for w in plain for i in piece.model.encode(w)]
        # the whole text at once, its words a space apart
        sequences = byte.encoding.encode_ordinary(" " + " ".join(plain)) if plain else []
        assert [x.tolist() for x in own.ids(words)] == [pieces, sequences], repr(text)
        chars = plain_base(text)[1]
        m = fertility.measure(text, own)
        check_measures(m[5:9], pieces, chars, piece.model.is_byte, piece.model.vocab_size())
        check_measures(m[9:13], sequences, chars, lambda i: len(byte.encoding.decode_single_token_bytes(i)) == 1 and byte.encoding.decode_single_token_bytes(i)[0] >= 0x80, byte.encoding.n_vocab)


def plain_kept(rows):
    """kept by its definition: quartiles of rounded measures by band, over all rows that pass the base rules."""
    out = {}
    for k, r in enumerate(rows):
        good = not r.base_failed
        for m, (step, slack) in fertility.MEASURES.items():
            own = sorted(math.floor(x[m] / step) for x in rows if x.band == r.band and not x.base_failed and x[m] is not None)
            if not own or r[m] is None:
                continue
            q1, q3 = (own[math.ceil(q * len(own)) - 1] * step for q in (0.25, 0.75))
            reach = fertility.BAND_WIDTH * (q3 - q1) + slack
            good = good and q1 - reach <= r[m] <= q3 + step + reach
        out[k] = good
    return out


def test_script():
    assert [fertility.script_of(t) for t in ("abc é", "где", "日本 a", "12 !", "", "한국", "ابج")] == ["latin", "cyrillic", "han", "none", "none", "hangul", "arabic"]


def test_table(spark):
    rng = random.Random(10)
    words = ["the", "house", "window", "garden", "other", "where", "people", "morning", "street", "little", "water", "under"]
    clean = [(i, " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(120)), "en") for i in range(80)]
    odd = [
        (100, " ".join(f"{rng.getrandbits(80):x}" for _ in range(80)), "en"),  # hexadecimal
        (101, " ".join("ሀለሐ"[rng.randrange(3)] * 3 + str(i) for i in range(80)), "en"),  # fallback bytes
        (102, "too short", "en"),
        (103, "same words here again " * 40, "en"),
        (104, None, "en"),
        (105, "", None),
        (None, clean[0][1], "en"),
        (0, clean[0][1], "en"),
        (106, clean[1][1], None),
    ]
    df = spark.createDataFrame([(*r, "x", 3) for r in clean + odd], "doc_id long, text string, lang string, kept string, n_words int")
    got = fertility.judge(df).collect()
    assert len(got) == len(clean) + len(odd)
    texts = {i: t for i, t, _ in clean + odd}
    for r in got:
        n, chars, symbols, dup, repeated = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)
    assert {k: r.kept for k, r in enumerate(got)} == plain_kept(got)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].kept for i in range(80)) >= 76 and by[None].kept == by[0].kept and by[106].kept
    assert not any(by[i].kept for i in range(100, 106))
    assert not by[100].base_failed and not by[101].base_failed and by[101].byte_share > 0.3
    assert by[106].band == "script:latin" and by[0].band == "lang:en"
    assert fertility.judge(df.limit(0)).collect() == []


def test_very_long_texts_and_words():
    own = fertility.Vocabularies()
    words = ["house " * 100_000, "x" * 200_000, "日" * 50_000]
    for text in words:
        got = fertility.measure(text, own)
        assert got[0] == len(text.split()) and got[1] == len(text.replace(" ", "")) and got[5] > 0 and got[9] > 0
