"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word stems (prefixes of 4, 5 and 6 letters). It
is fitted on labelled texts; for each sentence of theirs with an identity term, versions with the
term swapped for others of its group are made, and the squared change of the score's logit is
penalised. So weight that such a term has picked up by the company it keeps is taken from it,
which lowers false positives on neutral mentions. Only the text is ever an input.

Groups are the fixed lists below and pairs found in the corpus: words that tell nothing about the
label, though a feature of theirs does, each with the neutral word of the likest context (by the
words beside it). Those take from a stem what it would say about neutral words that share it.

Scale: fitting takes a bounded sample (`sample` labelled texts and `mentions` sentences of them,
chosen by digests, features made on the executors; `max_features` weights), whatever the corpus;
scoring is one scan with the weights sent along, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator, Sequence
from itertools import pairwise
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, remove

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
STEMS = (4, 5, 6)

#: Terms of one group stand for each other.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)


def words_of(text: str | None) -> set[str]:
    """Distinct words of a whole text, in lower case."""
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> tuple[str, ...]:
    """A word and its stems; a stem is marked by a star."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


@dataclass
class Model:
    """Weights by feature; a text's logit is the bias and the weights of the features present."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    #: Counterfactual sentences that the fit compared.
    swaps: int = 0

    def scores(self, texts) -> np.ndarray:
        """Scores of texts, a sequence of strings (or nulls) or an Arrow array of them."""
        seen: dict[str, tuple[str, ...]] = {}
        weights, out = self.weights, np.empty(len(texts))
        for k, text in enumerate(texts):
            present: set[str] = set()
            for w in words_of(text.as_py() if isinstance(text, pa.Scalar) else text):
                got = seen.get(w)
                if got is None:
                    got = tuple(f for f in features_of(w) if f in weights)
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen[w] = got
                if got:
                    present.update(got)
            out[k] = self.bias + sum(map(weights.__getitem__, sorted(present)))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of each sentence with any, in lower case."""
    return [w for w in map(_WORD.findall, _SENTENCE.split(text.lower())) if w] if text else []


def _z(one: np.ndarray, zero: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Two-sample z of the shares of texts that have a feature."""
    share = (one + zero) / (n1 + n0)
    return (one / n1 - zero / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))


def neutral_words(texts: Iterable[Iterable[str]], labels: Sequence[int], weighed: Container[str], most: int = 400) -> tuple[list[str], list[str]]:
    """Words that tell nothing about the label (|z| below 2), in 2 texts or more and half of them at most.

    The first list has up to `most`, the commonest, that have one of the features `weighed` all the
    same, the second up to as many that have none.
    """
    y = np.asarray(labels)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for ws, v in zip(texts, y, strict=True):
        counts[int(v)].update(w for w in set(ws) if len(w) > 2)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:
        return [], []
    words = sorted(counts[0].keys() | counts[1].keys())
    one, zero = (np.array([c[w] for w in words], dtype=float) for c in (counts[1], counts[0]))
    fine = np.flatnonzero((np.abs(_z(one, zero, n1, n0)) < 2) & (one + zero >= 2) & (one + zero <= 0.5 * len(y)))
    out: tuple[list[str], list[str]] = ([], [])
    for k in sorted(fine, key=lambda k: (-one[k] - zero[k], words[k])):
        own = out[0 if any(f in weighed for f in features_of(words[k])) else 1]
        if len(own) < most:
            own.append(words[k])
    return out


def alike(contexts: dict[str, np.ndarray], terms: Iterable[str], least: float = 0.5) -> tuple[tuple[str, ...], ...]:
    """For each of terms the pair with the word of nearest context (counts of neighbours), at a cosine of their roots of `least` or more."""
    words = sorted(w for w, v in contexts.items() if v.sum() > 0)
    terms = [t for t in terms if t in set(words)]
    if len(words) < 2 or not terms:
        return ()
    m = np.sqrt(np.array([contexts[w] for w in words], dtype=float))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    at = [words.index(t) for t in terms]
    near = m[at] @ m.T
    near[np.arange(len(at)), at] = -1
    best = near.argmax(axis=1)
    return tuple(sorted({tuple(sorted((t, words[b]))) for k, (t, b) in enumerate(zip(terms, best, strict=True)) if near[k, b] >= least}))


def fit(
    texts: Iterable[Iterable[str]],
    labels: Sequence[int],
    penalty: float = 1.0,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
    max_features: int = 3000,
    ridge: float = 1e-4,
    steps: int = 400,
    sentences: Iterable[Iterable[str]] | None = None,
) -> Model:
    """Fit on the distinct words of texts, which are gone through once. penalty weighs the mean squared change of the logit under swaps.

    Terms are swapped in `sentences`, by default in each text as one sentence. Without both labels
    the score is the smoothed share of label 1 for every text.
    """
    n, y = len(labels), np.asarray(labels, dtype=float)
    prior = (y.sum() + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Model(bias)
    swaps: dict[str, list[str]] = {}
    for g in groups:
        for t in g:
            swaps.setdefault(t, []).extend(o for o in g if o != t)
    number: dict[str, int] = {}  # of a feature
    of_word: dict[str, tuple[int, ...]] = {}
    present: list[np.ndarray] = []  # features of a text, by number
    mentions: list[tuple[str, frozenset[str]]] = []  # an identity term and the words of its text
    for ws in texts:
        words = frozenset(ws)
        for w in words:
            if w not in of_word:
                of_word[w] = tuple(number.setdefault(f, len(number)) for f in features_of(w))
        present.append(np.unique(np.fromiter((k for w in words for k in of_word[w]), dtype=np.int32)))
        if sentences is None:
            mentions += [(t, words) for t in sorted(words & swaps.keys())]
    del of_word
    for words in map(frozenset, sentences or ()):
        mentions += [(t, words) for t in sorted(words & swaps.keys())]
    if len(present) != n:
        raise ValueError("as many texts as labels are needed")

    n1 = y.sum()
    n0 = n - n1
    width = len(number)
    one = np.bincount(np.concatenate([p for p, v in zip(present, y, strict=True) if v]), minlength=width)
    zero = np.bincount(np.concatenate([p for p, v in zip(present, y, strict=True) if not v]), minlength=width)
    z = np.abs(_z(one, zero, n1, n0))
    z[one + zero < 4] = 0  # a feature in fewer than 4 texts says little
    strong = {k: float(z[k]) for k in np.flatnonzero(z > 3.5)}
    # ties fall to the longer, then the alphabet
    ranked = sorted(((strong[k], f) for f, k in number.items() if k in strong), key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen = sorted(f for _, f in ranked[:max_features])
    place = {f: k for k, f in enumerate(chosen)}
    if not chosen:
        return Model(bias)
    column = np.full(width, -1, dtype=np.int64)
    for f, k in place.items():
        column[number[f]] = k
    del number
    rows = [c[c >= 0] for c in (column[p] for p in present)]
    del present
    at = np.concatenate(rows)
    of = np.repeat(np.arange(n), [len(r) for r in rows])

    # logit changes under swaps, as sparse rows of +1 and -1
    d_at, d_of, d_by, m = [], [], [], 0
    for term, words in mentions:
        rest = {f for w in words if w != term for f in features_of(w) if f in place}
        before = rest | {f for f in features_of(term) if f in place}
        for other in swaps[term]:
            after = rest | {f for f in features_of(other) if f in place}
            for f in sorted(before ^ after):
                d_at.append(place[f])
                d_of.append(m)
                d_by.append(1.0 if f in before else -1.0)
            m += 1
    d_at, d_of, d_by = np.array(d_at, dtype=np.int64), np.array(d_of, dtype=np.int64), np.array(d_by)

    w, b = np.zeros(len(chosen)), bias
    mean, square, mean_b, square_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = b + np.bincount(of, weights=w[at], minlength=n)
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(at, weights=r[of], minlength=len(w)) + 2 * ridge * w
        if m:
            change = np.bincount(d_of, weights=w[d_at] * d_by, minlength=m)
            g += 2 * penalty / m * np.bincount(d_at, weights=change[d_of] * d_by, minlength=len(w))
        gb = r.sum()
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        mean_b, square_b = 0.9 * mean_b + 0.1 * gb, 0.999 * square_b + 0.001 * gb * gb
        scale = 0.05 / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w -= scale * mean / (np.sqrt(square) + 1e-9)
        b -= scale * mean_b / (np.sqrt(square_b) + 1e-9)
    return Model(float(b), {f: float(v) for f, v in zip(chosen, w, strict=True)}, m)


def held_out(doc_id: str = "doc_id"):
    """True for the rows that are never learnt from: crc32 of doc_id as text divides by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


#: Weights of the swaps' penalty that train() chooses from.
PENALTIES = (0.1, 0.3, 1.0, 3.0)


def choose_penalty(bags: Sequence[str], labels: Sequence[int], inner: Sequence[bool], groups: tuple[tuple[str, ...], ...], sentences: list[list[str]]) -> float:
    """The largest of PENALTIES whose log loss on the inner texts, learnt from the others, is within a standard error of the least; 1 without both labels on either side."""
    y, out = np.asarray(labels), np.asarray(inner, dtype=bool)
    if not len(y) or any(y[side].min(initial=1) == y[side].max(initial=0) or not side.any() for side in (out, ~out)):
        return 1.0
    losses = []
    for q in PENALTIES:
        model = fit((bags[i].split() for i in np.flatnonzero(~out)), y[~out].tolist(), q, groups, sentences=sentences)
        p = np.clip(model.scores([bags[i] for i in np.flatnonzero(out)]), 1e-6, 1 - 1e-6)
        losses.append(-np.log(np.where(y[out] == 1, p, 1 - p)))
    best = min(losses, key=np.mean)
    limit = best.mean() + best.std() / np.sqrt(len(best))
    return max(q for q, loss in zip(PENALTIES, losses, strict=True) if loss.mean() <= limit)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8_000, mentions: int = 8_000, penalty: float | None = None, seed: int = 17
) -> Model:
    """Fit on at most `sample` labelled texts that aren't held out.

    Without a penalty, one is chosen on an inner split: of the rows that may be learnt from, those
    whose remainder is 1 are set apart for the choice, and the model is then fitted on all.

    Of several labels of a doc_id the largest holds; null labels and null doc_ids are left out, and
    a doc_id that several documents have brings each of its different texts in. Empty labels or
    documents give a model that scores every text alike. `sample` and `mentions` are the documented
    bounds of what is collected: the word sets of so many texts, and so many sentences of theirs
    with terms to swap, chosen by digests.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id")
        .limit(sample)
    )
    text = F.col("text").cast("string")
    # `sample` rows of two numbers at most: small by construction
    labelled = materialize(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_of")).join(F.broadcast(known), "doc_id"), "labelled")
    first = labelled.select("doc_id", "_of").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id", "_of").limit(sample)
    chosen = materialize(labelled.join(F.broadcast(first), ["doc_id", "_of"]).dropDuplicates(["doc_id", "_of"]), "chosen")

    def bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "y": (pdf["_label"] > 0).astype("int32"), "w": [" ".join(sorted(words_of(t))) for t in pdf["text"]]}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = chosen.mapInPandas(bags, f"doc_id {kind}, y int, w string").toArrow().sort_by([("doc_id", "ascending"), ("w", "ascending")])
    bag, y = (lambda: (w.as_py().split() for w in got["w"])), got["y"].to_pylist()
    weighed = fit(bag(), y, steps=0).weights
    terms, others = neutral_words(bag(), y, weighed)
    groups = IDENTITY_GROUPS + alike(_contexts(chosen, terms + others), terms)
    swapped = _mentions(chosen, groups, mentions)
    if penalty is None:
        inner = [crc32(str(i.as_py()).encode()) % 5 == 1 for i in got["doc_id"]]
        penalty = choose_penalty(got["w"].to_pylist(), y, inner, groups, swapped)
    model = fit(bag(), y, penalty, groups, sentences=swapped)
    remove(labelled)
    remove(chosen)
    del got
    give_back()
    return model


#: Neighbours are counted by digest in so many cells on each side.
_CELLS = 64


def _contexts(texts: DataFrame, words: list[str]) -> dict[str, np.ndarray]:
    """For each of words the counts of the words before and after it in sentences of texts, a bounded sample."""
    if not words:
        return {}
    number = {w: k for k, w in enumerate(words)}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(number), 2 * _CELLS), dtype=np.int64)
        for pdf in parts:
            for text in pdf["text"]:
                for sentence in sentences_of(text):
                    for a, b in pairwise(sentence):
                        if b in number:
                            seen[number[b], xxhash.xxh32_intdigest(a) % _CELLS] += 1
                        if a in number:
                            seen[number[a], _CELLS + xxhash.xxh32_intdigest(b) % _CELLS] += 1
        at, cell = np.nonzero(seen)
        yield pd.DataFrame({"at": at, "cell": cell, "n": seen[at, cell]})

    out = {w: np.zeros(2 * _CELLS) for w in words}
    counted = texts.select("text").mapInPandas(count, "at long, cell long, n long").groupBy("at", "cell").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row for each word and cell at most
        out[words[r["at"]]][r["cell"]] = r["n"]
    return out


def _mentions(texts: DataFrame, groups: tuple[tuple[str, ...], ...], most: int) -> list[list[str]]:
    """Up to `most` distinct sentences of texts with a term of groups, chosen by digest, as distinct words."""
    terms = frozenset(t for g in groups for t in g)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = {" ".join(sorted(ws)) for text in pdf["text"] for ws in map(set, sentences_of(text)) if not terms.isdisjoint(ws)}
            yield pd.DataFrame({"s": sorted(found)}, dtype=object)

    rows = texts.select("text").mapInPandas(find, "s string").distinct().orderBy(F.xxhash64("s"), "s").limit(most).collect()
    return [r["s"].split() for r in rows]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, of the whole text; null and empty texts score the bias) and predicted (1 from 0.5 on).

    Columns of these names are replaced; all others are kept, repeated rows and nulls too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(shared.value.scores(texts), type=pa.float64())
        give_back()

    return docs.withColumn("score", scored(F.col(text).cast("string"))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
