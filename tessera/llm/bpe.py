"""Byte-pair encoding and decoding with a public word-level vocabulary file.

A short word is held as a contiguous array of part boundaries with the rank of each part joined
to its right neighbour. The least rank is found by scanning, the boundary inside that pair is
deleted, and the ranks beside it are looked up again, until no pair has a rank. Words of more
parts than LONG go through a heap over a linked list instead, so that a "word" of 100,000 letters
takes n log n steps; both give the same parts (least rank first, leftmost of equals).

Text is normalised and split as the vocabulary file says: NFC, blanks to one space, lower case by
code point, contractions / runs of letters / single digits / runs of other signs; bytes are
written in the byte alphabet, and the last symbol of a word carries the end-of-word mark. The two
special tokens are matched in the raw text. Nothing in this reaches across white space, so pieces
between white space are encoded on their own and remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Parts above which a word counts as long.
LONG = 96
#: Pieces, and words, that each worker remembers in either of two generations.
REMEMBERED = 100_000
_BITS = 20
_MASK = (1 << _BITS) - 1
_NO_RANK = 1 << 60
#: Python's str.split() also parts at these; the vocabulary's pattern doesn't.
_ODD = regex.compile("[\x1c-\x1f]")
_BLANK = regex.compile(r"[\t\n\x0b\x0c\r \x85   -     　]+")


def byte_alphabet() -> list[str]:
    """The sign for each byte: itself if printable, else the next sign from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs, spare = [], 256
    for b in range(256):
        if b in own:
            signs.append(chr(b))
        else:
            signs.append(chr(spare))
            spare += 1
    return signs


class _Seen(dict):
    """Remembers what `make` gives for short keys: the newest ones and as many before, of which those met again stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str):
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                super().clear()
            self[key] = got
        return got

    def clear(self) -> None:
        super().clear()
        self.before = {}


class Codec:
    """Encoder and decoder for one vocabulary; `spec` is the text of its file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or data.get("post_processor") or data.get("decoder"):
            raise ValueError("a plain BPE vocabulary without post-processor and decoder is needed")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: (left << _BITS | right) to (rank << _BITS | joined), so that ranks compare as they are
        self.ranks = {vocab[a] << _BITS | vocab[b]: rank << _BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        signs = byte_alphabet()
        self.inner = [vocab[s] for s in signs]
        self.last = [vocab[s + self.suffix] for s in signs]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_pattern = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.seen = _Seen(self.piece)
        self.seen_words = _Seen(lambda word: self.merge(word.encode("utf-8")))

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return tuple(self._merge_long(ids) if len(ids) > LONG else self._merge_short(ids))

    def _merge_short(self, parts: list[int]) -> list[int]:
        rank = self.ranks.get
        ranks = [rank(a << _BITS | b, _NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = least & _MASK
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] << _BITS | parts[at + 1], _NO_RANK)
            if at:
                ranks[at - 1] = rank(parts[at - 1] << _BITS | parts[at], _NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs = ((rank(parts[i] << _BITS | parts[i + 1]), i) for i in range(n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for r, i in pairs if r is not None]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = least & _MASK, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(parts[a] << _BITS | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def piece(self, raw: str) -> tuple[int, ...]:
        """Ids of text without white space and special tokens."""
        text = raw if raw.isascii() else unicodedata.normalize("NFC", raw)
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        words = self.words.findall(text)
        return self.seen_words[words[0]] if len(words) == 1 else tuple(chain.from_iterable(map(self.seen_words.__getitem__, words)))

    def _plain(self, text: str) -> list[int]:
        pieces = [p for p in _BLANK.split(text) if p] if _ODD.search(text) else text.split()
        return list(chain.from_iterable(map(self.seen.__getitem__, pieces)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return []
        if self.special_pattern and "<|" in text:
            out: list[int] = []
            for k, part in enumerate(self.special_pattern.split(text)):
                if k % 2:
                    out.append(self.special[part])
                else:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts joined by spaces, which is how a vocabulary without a decoder reads; null and unknown ids are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join(self.names[i] for i in ids if i in self.names)

    def forget(self) -> None:
        """Give back what the remembered pieces take."""
        self.seen.clear()
        self.seen_words.clear()


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver; a few MB whatever the data, so it travels with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _codec(shared) -> Codec:
    """One codec for each worker."""
    digest = hashlib.sha256(shared.value.encode()).digest()
    if _CODECS.get("of") != digest:
        _CODECS.update(of=digest, codec=Codec(shared.value))
    return _CODECS["codec"]


_CODECS: dict = {}


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array<int> column of the ids of the whole text (null or empty text: no ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("array<int>")
    def to_ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for texts in parts:
            yield pa.array([codec.encode(t.as_py()) for t in texts], type=pa.list_(pa.int32()))
        codec.forget()

    return docs.withColumn(ids, to_ids(F.col(text).cast("string")))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with a string column: the decoded ids (a null array: empty; null and unknown ids inside one are left out)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("string")
    def to_text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for lists in parts:
            yield pa.array([codec.decode(x or []) for x in lists.to_pylist()], type=pa.string())

    return encoded.withColumn(text, to_text(F.col(ids)))


def roundtrip_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text is encoded and its ids decoded, in one pass.

    Null text counts as empty (0 tokens, digests of nothing); null doc_ids and repeated rows are
    kept; extra columns are dropped; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        digits = [str(i) for i in range(max(codec.names) + 1)]
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
