"""Near duplicates against a comparison of all pairs on the shingles themselves."""

import random
import re

from keyloom.llm.near_dedup import near_dedup

SCHEMA = "doc_id long, text string, n_shingles string"


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(5, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def made(seed=7):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    passage = r.choices(words, k=60)
    for _ in range(40):
        base = r.choices(words, k=r.choice([3, 8, 11, 12, 40, 120, 300]))
        if r.random() < 0.4:
            base = base + passage
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append((i, " ".join(w.upper() if r.random() < 0.2 else w for w in copy)))
            i += 1
    drift = r.choices(words, k=200)  # a chain: each copy near the one before it
    for _ in range(12):
        drift[r.randrange(200)] = f"y{i}"
        drift[r.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(drift)))
        i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one"), (i + 4, "ONE")]


def test_same_as_all_pairs(spark):
    rows = made()
    got = near_dedup(spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_short_sets_that_differ_in_one_shingle(spark):
    words = "a b c d e f g h i j k l m n".split()
    rows = [(n * 10 + k, " ".join(words[k:n])) for n in range(5, 15) for k in (0, 1)]
    got = near_dedup(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def compared(spark, rows):
    got = near_dedup(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_large_group_of_near_copies(spark):
    """Each has two words of its own, so that most pairs are linked and some aren't."""
    r = random.Random(11)
    base = r.choices([f"w{k}" for k in range(300)], k=100)
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            copy[r.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    compared(spark, rows)


def test_passage_shared_by_unlike_texts(spark):
    """A passage makes from half to nearly all of each text; pairs are from unlike to just below or above the similarity."""
    r = random.Random(12)
    passage = r.choices([f"w{k}" for k in range(300)], k=90)
    rows = []
    for i in range(700):
        own = [f"own{i}-{k}" for k in range(r.choice([90, 45, 30, 14, 9, 7, 5, 3]))]
        rows.append((i, " ".join([*own, *passage] if i % 2 else [*passage, *own])))
    compared(spark, rows)


def test_large_ids_long_texts_and_ids_with_several_texts(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    two = " ".join(f"v{k}" for k in range(60))
    three = " ".join(f"u{k}" for k in range(60))
    rows = [(2**60 + 1, long), (2**60 + 3, long + " more"), (None, long), (5, two), (5, three), (5, three), (6, two + " x"), (7, three + " x"), (8, " " * 1_000_000), (9, "a" * 1_000_000)]
    got = near_dedup(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {2**60 + 1: 2**60 + 1, 2**60 + 3: 2**60 + 1, None: None, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9}
    assert len(got) == len(rows)


def test_empty_table_and_null_id(spark):
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_dedup(spark.createDataFrame([(None, "a b", ""), (1, "a b", ""), (1, "a b", "")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True)] * 2 + [("None", "None", True)]
