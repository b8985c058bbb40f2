"""Near copies in the pipeline's stage against exact similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from tessera.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def planted(changes, copies, seed):
    rng = random.Random(seed)
    made = []
    for _ in range(copies[0]):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        made.append(" ".join(base))
        for _ in range(copies[1]):
            own = list(base)
            for at in rng.sample(range(200), rng.choice(changes)):
                own[at] = f"new{rng.randrange(10**6)}"
            made.append(" ".join(own))
    return made


def smallest_of_groups(texts):
    root = list(range(len(texts)))
    own = [five_words(t) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            if root[i] != root[j] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


def test_stage_drops_planted_near_copies(spark, sf):
    texts = planted((1, 2, 3, 4, 12), (30, 3), 3)
    want = smallest_of_groups(texts)
    assert 30 < len(want) < 90
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == want


@pytest.mark.parametrize("rounds", [0, 4])
def test_crowds_of_near_copies(spark, rounds):
    texts = planted((1, 2, 3), (2, 60), 4) + ["", " ", "a b", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (None, None)], "doc_id long, text string")
    got = {r["doc_id"] for r in similar.similar_to_smaller(docs, cap=8, rounds=rounds).collect()}
    assert got == set(range(122)) - smallest_of_groups(texts[:122])


def test_ids_of_any_type(spark, sf):
    texts = planted((1, 2), (4, 3), 6)
    first = smallest_of_groups(texts)
    named = [(f"doc|{i:03d}", t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(named, DOCS.replace("doc_id long", "doc_id string"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert kept.dtypes[0] == ("doc_id", "string")
    assert {r["doc_id"] for r in kept.collect()} == {f"doc|{i:03d}" for i in first}
    # crowds compare in blocks
    gone = similar.similar_to_smaller(docs, cap=1)
    assert {r["doc_id"] for r in gone.collect()} == {f"doc|{i:03d}" for i in set(range(len(texts))) - first}
    small = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["doc_id"] for r in similar.similar_to_smaller(small).collect()} == set(range(len(texts))) - first
