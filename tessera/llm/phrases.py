"""Phrase collocations from compressed position bitmaps.

Texts are dealt into shards of a few million word positions. In a shard every word has a bitmap of
its positions, of which only bytes with a bit set are stored, each after the gap to the one before;
between two pieces (and two texts) one position stays empty. Shifting a phrase's bitmap by one and
AND-ing it with those of the words found in the same bytes extends the phrase by a word, never
across a piece; popcounts, summed over the shards, are the phrase's occurrences.

Phrases grow depth-first within a shard, a run of first words at a time. What is rare in the whole
corpus is not grown: words join the search when they are frequent in all shards together, and three
words are tried where both pairs in them are frequent. Those prunings are joins of tables, so the
counts stay exact and nothing of the corpus passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, remove

#: Word positions of a shard, and bytes of text split at a time.
SHARD = 1 << 21
_RUN = 1 << 23
#: Pairs of bitmap bytes compared at a time.
_PAIRS = 1 << 22
#: The language of texts that name none.
UNKNOWN = "und"

_WORD, _BLANK, _STOP = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _STOP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def _runs(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about _RUN bytes that end with a text or, inside a very long one, with a piece."""
    begin = 0
    while begin < len(raw):
        if begin + _RUN >= len(raw):
            end = len(raw)
        elif (k := np.searchsorted(ends, begin + _RUN, side="right") - 1) >= 0 and ends[k] > begin:
            end = int(ends[k])
        else:  # inside one text
            end = int(ends[k + 1])
            for at in range(begin + _RUN, end, _RUN):
                if len(stops := np.flatnonzero(_KIND[raw[at : at + _RUN]] == _STOP)):
                    end = min(end, at + int(stops[0]) + 1)
                    break
        yield begin, end
        begin = end


def split(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Words of whole texts, lower-cased in A-Z, run by run, with the numbers of their pieces and texts; nulls have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    ends = bounds[1:] - bounds[0]
    for begin, end in _runs(whole, ends):
        raw = whole[begin:end]
        inside = _KIND[raw] == _WORD
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        breaks = _KIND[raw] == _STOP
        edges = np.unique(ends[(ends > begin) & (ends < end)]) - begin
        first[edges] = inside[edges]
        breaks = breaks.astype(np.int32)
        breaks[edges] += 1
        at = np.flatnonzero(first)
        if not len(at):
            continue
        body = _LOWER[raw[inside]]
        offsets = np.append(np.cumsum(inside, dtype=np.int64)[at] - 1, len(body))
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(body))
        yield words, np.cumsum(breaks)[at], np.searchsorted(ends, at + begin, side="right")


def pack(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaps in seven-bit bytes, low ones first, the last without its high bit; and the number of bytes of each."""
    size = 1 + sum((gaps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    out = np.empty(int(size.sum()), np.uint8)
    start = np.cumsum(size) - size
    for k in range(5):
        has = np.flatnonzero(size > k)
        out[start[has] + k] = (gaps[has] >> 7 * k & 127) | (size[has] > k + 1).astype(np.int64) << 7
    return out, size


def unpack(raw: np.ndarray) -> np.ndarray:
    """The gaps that pack() wrote."""
    if not len(raw):
        return np.zeros(0, np.int64)
    start = np.append(0, np.flatnonzero(raw < 128)[:-1] + 1)
    k = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * k, start)


def _binary(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One value per size, cut from raw in order."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _bitmaps(parts: list[tuple[pa.Array, np.ndarray, pa.Array]], shard: int) -> pa.RecordBatch:
    """The shard's rows: one per language and word, with its occurrences and its bitmap's gaps and bytes."""
    words = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    langs = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
    change = np.concatenate([np.append(True, np.diff(p[1]) != 0) for p in parts])
    pos = np.arange(len(change)) + np.cumsum(change)
    several = len(words.dictionary)
    code = langs.indices.to_numpy().astype(np.int64) * several + words.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, pos = code[order], pos[order]
    block, new = pos >> 3, np.append(True, np.diff(code) != 0)
    start = np.flatnonzero(new | np.append(True, np.diff(block) != 0))
    bits = np.bitwise_or.reduceat(np.left_shift(1, pos & 7).astype(np.uint8), start)
    block, heads = block[start], np.flatnonzero(new[start])
    gaps = np.diff(block, prepend=0)
    gaps[heads] = block[heads]
    packed, size = pack(gaps)
    code = code[np.flatnonzero(new)]
    columns = [
        pa.array(np.full(len(code), shard)),
        langs.dictionary.take(pa.array(code // several)),
        words.dictionary.take(pa.array(code % several)).cast(pa.string()),
        pa.array(np.diff(np.append(np.flatnonzero(new), len(new)))),
        _binary(packed, np.add.reduceat(size, heads)),
        _binary(bits, np.diff(np.append(heads, len(bits)))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "word", "f", "gaps", "bits"])


def word_bitmaps(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (shard, lang, word, f, gaps, bits): the bitmap of every word in every shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, parts = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            for words, piece, owner in split(batch.column(0)):
                parts.append((words, piece, pa.array(names[owner], type=pa.string())))
                held += len(words)
                if held >= SHARD:
                    yield _bitmaps(parts, (task << 24) + k)
                    k, held, parts = k + 1, 0, []
        if parts:
            yield _bitmaps(parts, (task << 24) + k)
        del parts
        give_back()

    plain = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return plain.mapInArrow(build, "shard long, lang string, word string, f long, gaps binary, bits binary")


class _Shard:
    """Bitmaps of a shard's words, also by block (byte of the bitmaps), and the step that extends phrases."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table["id"].to_numpy()
        order = np.argsort(self.ids)
        table, self.ids = table.take(pa.array(order)), self.ids[order]
        raw, n = (b"".join(table["gaps"].to_pylist()), pc.binary_length(table["bits"]).to_numpy().astype(np.int64))
        gaps = unpack(np.frombuffer(raw, np.uint8))
        self.bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8)
        heads = np.cumsum(n) - n
        total = np.cumsum(gaps)
        self.block = total - np.repeat(total[heads] - gaps[heads], n) if len(gaps) else gaps
        self.word = np.repeat(np.arange(len(n)), n)
        self.by_block = np.argsort(self.block, kind="stable")
        last = int(self.block.max()) + 2 if len(gaps) else 1
        self.first = np.searchsorted(self.block[self.by_block], np.arange(last + 1))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Bitmap bytes (phrase, word, block, bits) of phrases longer by a word, some rows at a time, whole phrases together; rows come by phrase."""
        moved = bits.astype(np.uint16) << 1
        over = np.flatnonzero(moved > 255)
        phrase = np.concatenate([phrase, phrase[over]])
        block = np.concatenate([block, block[over] + 1])
        moved = np.concatenate([moved & 255, np.ones(len(over), np.uint16)]).astype(np.uint8)
        order = np.flatnonzero((moved > 0) & (block < len(self.first) - 1))
        order = order[np.argsort(phrase[order], kind="stable")]
        phrase, block, moved = phrase[order], block[order], moved[order]
        there = self.first[block + 1] - self.first[block]
        ends = np.flatnonzero(np.append(np.diff(phrase) != 0, True)) + 1 if len(phrase) else np.zeros(0, np.int64)
        done = np.append(0, np.cumsum(there))
        begin = 0
        while begin < len(phrase):
            k = max(np.searchsorted(done[ends], done[begin] + _PAIRS, side="right") - 1, np.searchsorted(ends, begin, side="right"))
            end = int(ends[k])
            own = there[begin:end]
            left = np.repeat(np.arange(begin, end), own)
            right = self.by_block[np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.first[block[begin:end]], own)]
            both = moved[left] & self.bits[right]
            hit = np.flatnonzero(both)
            yield phrase[left[hit]], self.word[right[hit]], block[left[hit]], both[hit]
            begin = end

    def count(self, phrase: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Popcounts by phrase and word."""
        key = phrase * len(self.ids) + word
        order = np.argsort(key, kind="stable")
        key, ones = key[order], _ONES[bits[order]]
        start = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(ones, start) if len(key) else ones
        return key[start] // len(self.ids), key[start] % len(self.ids), sums


def _pairs_of_shards(bitmaps: DataFrame) -> DataFrame:
    """Rows (shard, id1, id2, f): every pair of neighbouring words of a shard, with its occurrences there."""
    schema = pa.schema([("shard", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()), ("f", pa.int64())])

    def pairs(table: pa.Table) -> pa.Table:
        shard, number, got = _Shard(table), table["shard"][0].as_py(), []
        for phrase, word, _, bits in shard.extend(shard.word, shard.block, shard.bits):
            one, two, f = shard.count(phrase, word, bits)
            got.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(f), number)), pa.array(shard.ids[one]), pa.array(shard.ids[two]), pa.array(f)], schema=schema))
        del shard
        give_back()
        return pa.Table.from_batches(got, schema=schema)

    return bitmaps.groupBy("shard").applyInArrow(pairs, "shard long, id1 long, id2 long, f long")


def _triples_of_shards(bitmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (id1, id2, id3, f) of every shard: three words of which both pairs are among the shard's frequent ones."""
    schema = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("id3", pa.int64()), ("f", pa.int64())])

    def triples(table: pa.Table, frequent: pa.Table) -> pa.Table:
        got: list[pa.RecordBatch] = []
        if len(table) and len(frequent):
            shard = _Shard(table)
            several = len(shard.ids)
            known = np.sort(np.searchsorted(shard.ids, frequent["id1"].to_numpy()) * several + np.searchsorted(shard.ids, frequent["id2"].to_numpy()))

            def among(key: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                return np.flatnonzero(known[at] == key)

            for first, second, block, bits in shard.extend(shard.word, shard.block, shard.bits):
                key = first * several + second
                keep = among(key)
                for pair, third, _, own in shard.extend(key[keep], block[keep], bits[keep]):
                    on = among(pair % several * several + third)
                    names = np.unique(pair[on])  # small numbers for pairs, so that keys with a third word stay small
                    phrase, word, f = shard.count(np.searchsorted(names, pair[on]), third[on], own[on])
                    phrase = names[phrase]
                    ids = (shard.ids[phrase // several], shard.ids[phrase % several], shard.ids[word])
                    got.append(pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(f)], schema=schema))
            del shard
            give_back()
        return pa.Table.from_batches(got, schema=schema)

    return bitmaps.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInArrow(triples, "id1 long, id2 long, id3 long, f long")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of what occurs `least` times or more: words (id, lang, word, f), pairs (id1, id2, a), triples (id1, id2, id3, a); and n words by language (lang, n).

    All are written tables; an id stands for a word of one language.
    """
    raw = materialize(word_bitmaps(docs, text, lang), "bitmaps")
    totals = materialize(raw.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = raw.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = materialize(words.select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "words")
    bitmaps = materialize(raw.join(words.select("id", "lang", "word"), ["lang", "word"]).select("shard", "id", "gaps", "bits"), "bitmaps")
    remove(raw)
    every = Window.partitionBy("id1", "id2")
    found = _pairs_of_shards(bitmaps).select("shard", "id1", "id2", F.sum("f").over(every).alias("a"))
    of_shards = materialize(found.where(F.col("a") >= least), "pairs")
    pairs = materialize(of_shards.select("id1", "id2", "a").distinct(), "pairs")
    triples = _triples_of_shards(bitmaps, of_shards.select("shard", "id1", "id2"))
    triples = materialize(triples.groupBy("id1", "id2", "id3").agg(F.sum("f").alias("a")).where(F.col("a") >= least), "triples")
    remove(bitmaps)
    remove(of_shards)
    return words, pairs, triples, totals


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits."""
    a, left, right = (f"cast({c} as decimal(18,0))" for c in (a, left, right))
    return F.expr(f"cast((cast({a} * {a} as decimal(31,0)) * 1000000BD) div ({left} * {right}) as long)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's occurrences in all texts, `least` at least; l and r those of the parts of the
    cut that scores lowest (ties: the first); n the words of the language. A pair inside a triple
    that makes up `share` percent of it or more is left out. Order: score and a falling, phrase.

    Words are what stands between blanks and tabs, A-Z lower-cased; pieces end at `.,;:!?`, line
    ends, vertical tabs and form feeds, and with the text. Null texts are empty, null languages
    `und`; empty tables give no rows; repeated rows count each time; other columns don't matter.
    Counts up to 10^15 are exact.
    """
    words, pairs, triples, totals = phrase_counts(docs, text, lang, least)

    def word(k: int, *columns: str) -> DataFrame:
        named = {"id": f"id{k}", "word": f"w{k}", "f": f"f{k}", "lang": "lang"}
        return words.select(*[F.col(c).alias(named[c]) for c in ("id", *columns)])

    longer = triples.select("id1", "id2", "a").unionByName(triples.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a"))
    longer = longer.groupBy("id1", "id2").agg(F.max("a").alias("longer"))
    two = pairs.join(longer, ["id1", "id2"], "left").where(f"longer is null or longer * 100 < a * {share}").drop("longer")
    two = two.join(word(1, "lang", "word", "f"), "id1").join(word(2, "word", "f"), "id2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    three = triples.join(pairs.withColumnRenamed("a", "f12"), ["id1", "id2"]).join(pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("a").alias("f23")), ["id2", "id3"])
    three = three.join(word(1, "lang", "word", "f"), "id1").join(word(2, "word"), "id2").join(word(3, "word", "f"), "id3")
    three = three.withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each deal of a language's phrases keeps its own best, so no task orders all of them.
    deals = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = two.unionByName(three).withColumn("deal", deals)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
