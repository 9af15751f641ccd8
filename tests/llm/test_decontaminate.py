import random
import re

from quillmill.llm import decontaminate

DOCS = "doc_id long, text string, item_id string, containment string"


def brute(docs, items, threshold=0.8):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    found = []
    for i, item in items:
        q = shingles(item)
        for d, text in docs:
            shared = len(q & shingles(text))
            if q and shared >= threshold * len(q):
                found.append((d, i, len(q), shared))
    return sorted(found)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    out = decontaminate.leaks(d, b, **options).collect()
    assert all(abs(r.containment - r.shared_shingles / r.item_shingles) < 1e-12 for r in out)
    return sorted((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in out)


def cases():
    rng = random.Random(11)
    word = lambda: f"é{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 6, 14, 40, 90, 400])))) for i in range(60)]
    docs = []
    for d in range(80):
        words = [word() for _ in range(rng.choice([0, 3, 200, 4000]))]
        for _ in range(rng.choice([0, 1, 3])):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(words).upper() if d % 3 else "\n".join(words)))
    # an item of which the pieces are strewn over a long document
    pieces = items[4][1].split() if len(items[4][1].split()) > 30 else [word() for _ in range(60)]
    items.append((100, " ".join(pieces)))
    docs.append((100, " ".join(" ".join(pieces[i : i + 30] + [word() for _ in range(900)]) for i in range(0, len(pieces), 26))))
    docs += [(101, items[0][1]), (102, items[1][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = cases()
    expected = brute(docs, items)
    assert len(expected) > 40
    assert run(spark, docs, items) == expected
    assert run(spark, docs, items, block_chars=9000) == expected


def test_nulls_repeats_and_empty_tables(spark):
    text = "one two three four five six"
    docs = [(1, None), (2, ""), (3, text), (3, text), (None, text)]
    items = [(1, None), (2, " "), (3, text), (3, text), (None, text)]
    got = decontaminate.leaks(spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 9 and {r.doc_id for r in got} == {3, None}
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_clean_column(spark):
    docs, items = cases()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs + [(200, None)], "doc_id long, text string")
    dirty = {r[0] for r in brute(docs, items)}
    kept = {r.doc_id for r in d.filter(decontaminate.clean_column(b, block_chars=9000)).collect()}
    assert kept == {r[0] for r in docs + [(200, None)]} - dirty


def test_ids_of_any_type(spark):
    text = "one two three four five six"
    d = spark.createDataFrame([("doc-a", text), ("doc-b", "other"), (None, text)], "doc_id string, text string")
    b = spark.createDataFrame([("item/1", text, "x")], "Item_Id string, text string, n string").withColumnRenamed("Item_Id", "item_id")
    got = decontaminate.leaks(d, b)
    assert dict(got.dtypes)["doc_id"] == dict(got.dtypes)["item_id"] == "string"
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=repr) == sorted([("doc-a", "item/1"), (None, "item/1")], key=repr)


def test_one_item_many_times_keeps_blocks_small(spark):
    items = spark.createDataFrame([(i % 5, "one two three four five six " * 20) for i in range(400)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(items, block_chars=1200))
    assert sum(n for block in blocks for _, _, n in block) == 400 and max(map(len, blocks)) <= 5
