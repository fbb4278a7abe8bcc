"""Byte-level BPE: merges by a priority queue over a doubly linked symbol list.

Defined results: a null text is an empty one (no tokens); repeated rows and ids give
one row each; extra columns of the input are ignored; an empty table gives an empty
result. Texts are never cut; one pre-token may be as long as the text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
# How the vocabulary's library cuts text before merging (fixed value; \s spelt out).
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Encoded pre-tokens kept per Python worker, and the longest one kept. A full memo
# starts anew: memory stays bounded, results do not change.
MEMO_WORDS = 400_000
MEMO_CHARS = 48


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class _Memo(dict):
    """Pre-token -> packed ids, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [vocab[letter] for letter in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[bytes] = [b""] * (1 + max(*vocab.values(), *self.special.values()))
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.words = regex.compile(PRE_TOKENS).findall
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.memo = _Memo(self.merge)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: the lowest-ranked, leftmost pair is merged first."""
        ids = [self.byte_ids[b] for b in word.encode("utf-8")]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            # Stale: a symbol of this pair has been merged away or changed since.
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                found = merges.get((made, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], made))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if self.marks is None or not any(mark in text for mark in self.special):
            return b"".join([memo[w] for w in self.words(text)])
        parts = []
        for piece in self.marks.split(text):
            if piece in self.special:
                parts.append(np.array([self.special[piece]], dtype="<u4").tobytes())
            else:
                parts += [memo[w] for w in self.words(piece)]
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        """The vocabulary strings of the ids, joined; broken UTF-8 is replaced."""
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The codec of a file, or of a name in the public tokenizers; one per process."""
    if vocabulary not in _CODECS:
        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _CODECS[vocabulary] = Codec(path)
    return _CODECS[vocabulary]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each text. One narrow pass, no shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t), "<i4") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null ids give an empty text."""
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            texts = [c.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both: (id, n_tokens, ids_sha256, decoded_sha256).

    The ids stay inside the task, so a row leaves it with two digests only.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            counts, ids, texts = [], [], []
            for value in batch.column(1):
                packed = c.encode(value.as_py())
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(c.decode(packed).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
