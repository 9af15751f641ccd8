import random

import xxhash

from quillmill.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component long"


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """doc_id -> fingerprint to doc_id -> component, by comparing all pairs."""
    up = {d: d for d in prints}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in ids}


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", -1) for d, t in rows], SCHEMA)
    return simhash.near_duplicate_groups(df, **options).collect()


def test_fingerprint_matches_plain_form():
    rng = random.Random(1)
    words = ["Alpha", "BETA", "gamma", "Ünder", "x", "naïve", "日本語"]
    for n in [0, 1, 2, 3, 4, 50, 700]:
        text = rng.choice([" ", "\n\t"]).join(rng.choice(words) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0
    assert simhash.fingerprint("a b \x1c c") == plain_fingerprint("a b \x1c c")


def test_same_hash_as_spark(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert simhash.fingerprint("one two three") == row.h % 2**64


def test_groups_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    rows, k = [], 0
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            near = list(words)
            if rng.random() < 0.6:
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((k := k + 1, " ".join(near)))
    rows += [(k + 1, None), (k + 2, ""), (k + 3, " \n ")]
    expected_prints = {d: plain_fingerprint(t) for d, t in rows}
    expected = plain_groups(expected_prints)
    assert len(set(expected.values())) < len(expected)
    for options in ({}, {"shard_limit": 2}):
        got = run(spark, rows, **options)
        assert {r.doc_id: r.component_id for r in got} == expected
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == expected_prints


def test_chains_and_dense_balls(spark):
    rng = random.Random(3)
    values, v = [], rng.getrandbits(64)
    for step in range(40):  # a chain, two bits a step
        values.append(v)
        v ^= 1 << (2 * step % 64) | 1 << (2 * step + 1) % 64
    centre = rng.getrandbits(64)
    values += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(64)]
    values += [rng.getrandbits(64) for _ in range(200)]
    values = sorted({x - 2**64 if x >= 2**63 else x for x in values})
    df = spark.createDataFrame([(x,) for x in values], "fp long")
    prints = {x: x % 2**64 for x in values}
    expected = plain_groups(prints)
    for limit in (20_000, 3):
        got = {r.fp: r.component for r in simhash.components(simhash.star_links(df, shard_limit=limit)).collect()}
        assert {x: got.get(x, x) for x in values} == expected


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "one two three four five"
    got = run(spark, [(5, text), (5, text), (None, text), (9, text)])
    assert len(got) == 4 and {r.component_id for r in got} == {5}
    assert run(spark, []) == []
