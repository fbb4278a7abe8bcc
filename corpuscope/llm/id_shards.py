"""Token-id shards with a minimal perfect hash index for keyed access.

Documents are sorted by key, encoded by the tokenizers library, and written as raw id
payloads, many shards at once. A shard file is

    ids of all its documents | key bytes | key lengths (u32) | ids a document (u64)
    | documents, ids, key bytes, bytes an id (u64 each) | 8 bytes of magic

all little-endian, so a reader needs nothing but the file. Ids take two bytes where the
vocabulary allows it, else four.

The index maps a key to (shard, document, offset). Keys are dealt by hash to parts of
bounded size; each part is a minimal perfect hash: levels of bit sets, in which a key
takes the place that no other key of the level wants, and the count of set bits before
it is its slot. A slot holds a fingerprint and the place, never the key; so a lookup is
a few bit tests, and a key that was never stored is turned away by its fingerprint with
a chance of one in four billion per lookup, and by the shard's own key in every case.
Places found are sorted by shard, and of a shard only its table and the bytes of the
documents asked for are read: payloads go through no shuffle after they are written.

Files are written by Spark's text sink, so on any file system that Spark reaches: its
line separator is the last byte of each document's ids, which is the same for all. They
are read by byte range, from a path that executors share or a URI of ``pyarrow.fs``.

Defined results: a null text is an empty one (its end id only); a null key is a key of
its own, the first; repeated keys are documents of their own, one after the other, and
a lookup returns them all; other columns are ignored; no rows make no documents.
"""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.llm.bpe import byte_letters
from corpuscope.llm.jaccard_join import by_group
from corpuscope.llm.shingles import mix
from corpuscope.session import materialize
from corpuscope.sources.folders import local_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
# Bytes of text that go into a shard; small inputs make a few shards for every core.
SHARD_TEXT = 128 << 20
SHARDS_A_CORE = 4
KEYS_PER_PART = 1 << 16
# Bits of a level for each key that comes to it: two let 61 % of them settle there.
BITS_PER_KEY = 2
MAX_LEVELS = 64
MAGIC = b"IDSHARD\0"
_TRAILER = struct.Struct("<QQQQ8s")
# Words of a generation of a worker's memo (it keeps two), the longest one kept, and ids
# of both generations.
MEMO_WORDS = 300_000
MEMO_CHARS = 48
MEMO_IDS = 8_000_000
# Words that the library's model is given at once.
WORDS_AT_ONCE = 1_000
# Characters of text that are encoded at once, and bytes of a reader's one request.
SLICE_CHARS = 1 << 20
READ_BYTES = 4 << 20
# Kinds of bytes, and letters: ASCII ones, and the second bytes of those behind C3.
_OTHERS, _SPACES, _MARKS = range(3)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACES
_KINDS[list(string.punctuation.encode())] = _MARKS
_LETTER = np.isin(np.arange(256), list(string.ascii_letters.encode()))
_HIGH_LETTER = np.array([0x80 <= c < 0xC0 and chr(c + 0x40).isalpha() for c in range(256)])
_SPACE = re.compile(r"[\x20\x09-\x0D]")
# The space stays: it parts words.
_BYTE_LETTERS = {byte: letter for byte, letter in enumerate(byte_letters()) if byte != 0x20}
_MARK = b"<|"  # what the library's special tokens begin with
_LATIN_BYTES = bytes([*range(0xC0), 0xC2, 0xC3])
# Words of up to so many times eight bytes are compared as numbers.
LANES = 3
_LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


# --- encoding -------------------------------------------------------------------


class Encoder:
    """Encodes texts with a vocabulary that drops white space: word by word, each new
    word by the library, so that repeated words cost a lookup."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # White space that the library keeps would have to be encoded with its words.
        a, b = self._ids(["a", "b"])
        self.by_word = all(self._ids([s, f"a{s}b"]) == [[], a + b] for s in " \t\n\v\f\r\x85\xa0\u2028\u3000")
        # Words of letters up to 255 are one piece to this kind of library, in lower case,
        # spelled by the letters of their bytes, and punctuation behind them is another: its
        # model takes them as they are, cut at spaces, where that holds.
        self.spelled = Tokenizer(self.library.model)
        self.spelled.pre_tokenizer = WhitespaceSplit()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        # The last id of a piece is told by its token.
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        tokens = (self.library.id_to_token(i) or "" for i in range(self.size))
        self.last = np.array([bool(suffix) and token.endswith(suffix) for token in tokens])
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        probe = [x + y for x in letters for y in ("", "a", x)]
        found = self._pieces(probe)
        ends = np.cumsum(found[1]).tolist() if found else []
        self.plain = [found[0][a:b].tolist() for a, b in zip([0, *ends], ends)] == self._ids(probe)
        # Punctuation behind a letter is a piece of its own.
        tails = [*string.punctuation, string.punctuation, string.punctuation[::-1]]
        self.plain &= all(self._ids(["a" + t, "\xe9" + t]) == [x + y for x in self._ids(["a", "\xe9"]) for y in self._ids([t])] for t in tails)
        self.memo = _Memo()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words of letters up to 255, and how many each has; none if the model
        does not tell where a piece ends."""
        spelled = " ".join(words).lower()
        if not spelled.isascii():
            spelled = spelled.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = np.array(self.spelled.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        return ids, np.diff(ends, prepend=0)

    def _new(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """A block of words at a time: their places in the list, ids, and how many each has."""
        fit = [self.plain and word.isalpha() and _latin(word) for word in words]
        letters, others = ([i for i, f in enumerate(fit) if f == kind] for kind in (True, False))
        for at in range(0, len(letters), WORDS_AT_ONCE):
            places = letters[at : at + WORDS_AT_ONCE]
            found = self._pieces([words[i] for i in places])
            if found:
                yield places, *found
            else:
                others += places
        for at in range(0, len(others), WORDS_AT_ONCE):
            places = others[at : at + WORDS_AT_ONCE]
            ids = self._ids([words[i] for i in places])
            yield places, np.fromiter(chain.from_iterable(ids), "<u4"), np.array([len(i) for i in ids])

    def width(self, end_id: int) -> int:
        """Bytes an id: two if all ids fit and the end id leaves its second byte zero, else four."""
        return 2 if self.size <= 1 << 16 and end_id < 1 << 8 else 4

    def encode(self, texts: list[str], width: int) -> list[bytes]:
        """The ids of whole texts, packed."""
        out, waiting, size = [], [], 0
        for text in texts:
            # Short texts are looked up together, long ones in slices.
            waiting.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                out += self._encode(waiting, width)
                waiting, size = [], 0
        return out + self._encode(waiting, width)

    def _encode(self, texts: list[str], width: int) -> list[bytes]:
        if not self.by_word:
            return [np.array(ids, f"<u{width}").tobytes() for ids in self._ids(texts)]
        if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
            slices = [texts[0][low:high] for low, high in _slices(texts[0])]
            return [b"".join([self._looked_up([s], width)[0] for s in slices])]
        return self._looked_up(texts, width)

    def _looked_up(self, texts: list[str], width: int) -> list[bytes]:
        data, starts, sizes, n = _words(texts, self.plain)
        memo = self.memo
        memo.make_room()
        # A look-up for each distinct word; the memo lists the new ones.
        first, codes = _distinct(data, starts, sizes)
        lows = starts[first]
        cut = map(data.__getitem__, map(slice, lows.tolist(), (lows + sizes[first]).tolist()))
        rows = np.fromiter(map(memo.__getitem__, cut), np.int64, len(first))[codes]
        memo.fill(self._new)
        ids, ends = memo.take(rows)
        packed = ids.astype(f"<u{width}").tobytes()
        cuts = (np.r_[0, ends][np.cumsum(n)] * width).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]


class _Memo(dict):
    """Word -> row of its ids, in two generations: words of the older one that are not met
    again are forgotten when the younger one is full."""

    def __init__(self):
        self.old: dict[bytes, int] = {}
        self.new: list[bytes] = []
        # The ids of all rows, where each row starts, and how many it has.
        self.ids = np.empty(0, "<u4")
        self.starts = self.sizes = np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        row = self.old.get(word)
        if row is None:
            row = len(self.sizes) + len(self.new)
            self.new.append(word)
        self[word] = row
        return row

    def fill(self, encode: Callable[[list[str]], Iterator[tuple[list[int], np.ndarray, np.ndarray]]]) -> None:
        """Takes the ids of the new words; the longest words are not met again."""
        if not self.new:
            return
        places, ids, sizes = zip(*encode(b" ".join(self.new).decode().split(" ")))
        places, ids, sizes = np.concatenate(places), np.concatenate(ids), np.concatenate(sizes)
        rows = np.empty((2, len(places)), np.int64)
        rows[:, places] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.ids = np.concatenate([self.ids, ids])
        self.starts, self.sizes = np.concatenate([[self.starts, self.sizes], rows], axis=1)
        for word in self.new:
            if len(word) > MEMO_CHARS:
                del self[word]
        self.new = []

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one row after the other, and where each row ends."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        # Ids stand behind the start of their row by as much here as there.
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return self.ids[at + np.arange(len(at))], ends

    def make_room(self) -> None:
        if len(self) <= MEMO_WORDS and len(self.ids) <= MEMO_IDS:
            return
        rows = np.fromiter(self.values(), np.int64, len(self))
        sizes = self.sizes[rows]
        self.ids, ends = self.take(rows)
        self.starts, self.sizes = ends - sizes, sizes
        self.old = dict(zip(self, range(len(rows))))
        self.clear()


def _lists(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    ends = np.cumsum(sizes).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def _latin(text: str) -> bool:
    """Whether all characters are below 256."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def _words(texts: list[str], plain: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at ASCII white space: UTF-8 data with room behind it, where words start,
    their bytes, and the number of words of each text.

    Where the library has it so, A-Z come in lower case and punctuation that stands between
    a letter and white space is a word of its own, so that fewer words are new.
    """
    parts = [text.encode() for text in texts]
    # Only letters below 256, whose UTF-8 starts with C2 or C3 at most: no marks that join them.
    simple = np.array([plain and _MARK not in p and not p.translate(None, _LATIN_BYTES) for p in parts], bool)
    parts = [p.lower() if s else p for p, s in zip(parts, simple)]
    stops = np.cumsum([len(p) + 1 for p in parts])
    data = b" ".join([b"", *parts, bytes([0x20]) * (8 * LANES)])
    codes = np.frombuffer(data, np.uint8)
    kinds = _KINDS[codes]
    # Runs of one kind. The data begins and ends with a space.
    runs = np.r_[0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1]
    kind = kinds[runs]
    starts = kind != _SPACES
    starts[1:] &= kind[:-1] == _SPACES
    behind = np.flatnonzero((kind[1:-1] == _MARKS) & (kind[:-2] == _OTHERS) & (kind[2:] == _SPACES)) + 1
    at = runs[behind]
    letter = _LETTER[codes[at - 1]] | (_HIGH_LETTER[codes[at - 1]] & (codes[at - 2] == 0xC3))
    starts[behind] = letter & simple[np.searchsorted(stops, at)]
    # A word ends where the next one or a space begins.
    ends = runs[np.flatnonzero(starts | (kind == _SPACES))]
    starts = runs[starts]
    ends = ends[np.searchsorted(ends, starts, "right")]
    return data, starts, ends - starts, np.diff(np.searchsorted(starts, stops), prepend=0)


def _distinct(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word for each distinct one (long ones may be repeated), and each word's place among these."""
    wide = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    lanes, key = [], sizes.astype(np.uint64)
    for lane in range(LANES):
        # Eight bytes of each word, zero beyond its end.
        low = np.minimum(starts + 8 * lane, len(wide) - 1)
        lanes.append(wide[low] & _LANE_MASK[np.clip(sizes - 8 * lane, 0, 8)])
        key = mix(key ^ lanes[-1])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    # Hashes only bring equal words together: bytes tell whether they are.
    for column in (sizes, *lanes):
        same &= (column := column[order])[1:] == column[:-1]
    same &= sizes[order][1:] <= 8 * LANES
    heads = np.r_[True, ~same][: len(order)]
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(heads) - 1
    return order[heads], codes


def _slices(text: str) -> Iterator[tuple[int, int]]:
    low = 0
    while len(text) - low > SLICE_CHARS:
        space = _SPACE.search(text, low + SLICE_CHARS)
        if not space:
            break
        yield low, space.start()
        low = space.start()
    yield low, len(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a file, or of a name in the public tokenizers; one per process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def key_bytes(key: Column) -> Column:
    """A key as bytes: its text behind a mark that tells a null from any text."""
    return F.when(key.isNull(), F.lit(b"n")).otherwise(F.concat(F.lit(b"k"), key.cast("string").cast("binary")))


# --- shards ---------------------------------------------------------------------


def write_shards(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    shard_text: int = SHARD_TEXT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of all documents, in ascending key order, under ``path``/shards."""
    spark = docs.sparkSession
    width = encoder(vocabulary).width(end_id)
    end = np.array([end_id], f"<u{width}").tobytes()
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    total = source.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # No fewer than some for each core, as long as a shard gets a megabyte.
    few = min(SHARDS_A_CORE * spark.sparkContext.defaultParallelism, -(-total // (1 << 20)))
    n = max(1, few, -(-total // shard_text))
    # Texts are the only thing that is shuffled. The row breaks ties, so a repeated key is
    # cut over shards like any other rows.
    ordered = source.repartitionByRange(n, "id", "row").sortWithinPartitions("id", "row")
    rows = ordered.select(key_bytes(F.col("id")).alias("key"), "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        keys, lengths = [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            for low in range(0, len(batch), 2048):
                ids = [x + end for x in coder.encode(batch.column(1).slice(low, 2048).to_pylist(), width)]
                lengths += [len(x) // width for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in ids], pa.binary())], ["value"])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([_table(keys, lengths, width)[:-1]], pa.binary())], ["value"])

    # Every document and the table end in a zero byte, which the sink puts back.
    text = rows.mapInArrow(shard, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\0").text(f"{path}/shards")


def _table(keys: list[bytes], lengths: list[int], width: int) -> bytes:
    """What stands in a shard file behind the ids."""
    blob = b"".join(keys)
    sizes = np.array([len(k) for k in keys], "<u4").tobytes()
    trailer = _TRAILER.pack(len(keys), sum(lengths), len(blob), width, MAGIC)
    return blob + sizes + np.array(lengths, "<u8").tobytes() + trailer


class Shard:
    """A shard file, read by byte range: its documents' keys and lengths, and ``ids``."""

    def __init__(self, file, size: int):
        self.file, self.n_docs = file, 0
        if size == 0:
            return  # a task without rows
        if size < _TRAILER.size:
            raise ValueError("this is no whole shard file")
        self.n_docs, n_ids, n_bytes, self.width, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        sizes = [n_ids * self.width, n_bytes, 4 * self.n_docs, 8 * self.n_docs, _TRAILER.size]
        if magic != MAGIC or sum(sizes) != size:
            raise ValueError("this is no whole shard file")
        table = self._read(sizes[0], size - sizes[0] - _TRAILER.size)
        self.keys = table[:n_bytes]
        self.key_ends = np.cumsum(np.frombuffer(table, "<u4", self.n_docs, n_bytes), dtype=np.int64)
        self.lengths = np.frombuffer(table, "<u8", self.n_docs, n_bytes + sizes[2]).astype(np.int64)
        self.ends = np.cumsum(self.lengths)

    def _read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the shard file is cut off")
        return data

    def key(self, doc: int) -> bytes:
        low = int(self.key_ends[doc - 1]) if doc else 0
        return self.keys[low : int(self.key_ends[doc])]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents ``first`` to ``last``, as unsigned 32-bit integers."""
        low = int(self.ends[first] - self.lengths[first]) * self.width
        high = int(self.ends[last]) * self.width
        return np.frombuffer(self._read(low, high - low), f"<u{self.width}").astype("<u4")


@contextmanager
def open_shard(path: str) -> Iterator[Shard]:
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as file:
            yield Shard(file, os.path.getsize(local))
    else:
        system, base = pafs.FileSystem.from_uri(path)
        with system.open_input_file(base) as file:
            yield Shard(file, file.size())


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path) of every shard file; contents are not read."""
    files = spark.read.format("binaryFile").load(f"{path}/shards")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path")


# --- index ----------------------------------------------------------------------


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h1 ^ mix(h2 + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h1 + mix(h2)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """A minimal perfect hash of keys given by two 64-bit hashes each: a slot from 0 to
    n - 1 for every key that it was built of, and any slot, or -1, for others."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # 0 or 1 for each place
        counts = np.cumsum([0, *[int(bits.sum()) for bits in levels]])
        self.n = int(counts[-1])
        self.before = [np.cumsum(bits, dtype=np.int64) - bits + c for bits, c in zip(levels, counts)]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels, rest = [], np.arange(len(h1))
        while len(rest):
            if len(levels) == MAX_LEVELS:
                raise ValueError("two keys have the same 128-bit hash")
            size = max(8, BITS_PER_KEY * len(rest) + 7 >> 3 << 3)
            place = _place(h1[rest], h2[rest], len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            rest = rest[~alone[place]]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            place = _place(h1[rest], h2[rest], level, len(bits))
            hit = bits[place] == 1
            out[rest[hit]] = before[place[hit]]
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(bits, bitorder="little").tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        at, levels = 4 * (n + 1), []
        for size in np.frombuffer(data, "<u4", n, 4).tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at), bitorder="little"))
            at += size // 8
        return cls(levels)


PLACE = np.dtype([("print", "<u4"), ("shard", "<u4"), ("last", "<u4"), ("doc", "<u8"), ("offset", "<u8")])


def build_index(spark: SparkSession, path: str, keys_per_part: int = KEYS_PER_PART) -> None:
    """Reads the shards' tables and writes ``path``/index and ``path``/directory.

    A repeated key is one key: its place is that of its first document, and the last
    shard that has one.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name in zip(*[c.to_pylist() for c in batch.columns]):
                with open_shard(name) as shard:
                    yield from _runs(number, shard)

    files = shard_files(spark, path)
    found = files.repartition("shard").mapInArrow(runs, "key binary, shard int, doc long, offset long, n_docs long, n_ids long")
    found = materialize(found, "id-runs")
    shards = found.groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    # One row per shard meets here.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).write.parquet(f"{path}/directory")

    first = F.min(F.struct("shard", "doc", "offset")).alias("first")
    keys = found.groupBy("key").agg(first, F.max("shard").alias("last"))
    keys = keys.select(*_hashes("key"), "first.shard", "last", "first.doc", "first.offset")
    keys = materialize(keys, "id-keys")
    parts = max(1, -(-keys.count() // keys_per_part))
    dealt = keys.withColumn("part", F.pmod("h1", F.lit(parts)).cast("int"))
    dealt = dealt.repartition("part").sortWithinPartitions("part")

    def build(part: pa.Table) -> pa.RecordBatch:
        h1, h2 = (part[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        perfect = PerfectHash.build(h1, h2)
        places = np.zeros(perfect.n, PLACE)
        slots = perfect.slots(h1, h2)
        places["print"][slots] = _fingerprint(h1, h2)
        for name in ("shard", "last", "doc", "offset"):
            places[name][slots] = part[name].to_numpy()
        columns = [pa.array([part["part"][0].as_py()], pa.int32()), pa.array([parts], pa.int32())]
        columns += [pa.array([x], pa.binary()) for x in (perfect.to_bytes(), places.tobytes())]
        return pa.RecordBatch.from_arrays(columns, ["part", "parts", "hash", "places"])

    index = dealt.mapInArrow(by_group("part", build), "part int, parts int, hash binary, places binary")
    index.write.parquet(f"{path}/index")


def _runs(number: int, shard: Shard) -> Iterator[pa.RecordBatch]:
    """The runs of documents of one key in a shard."""
    if not shard.n_docs:
        return
    buffers = [None, pa.py_buffer(np.r_[0, shard.key_ends].tobytes()), pa.py_buffer(shard.keys)]
    keys = pa.Array.from_buffers(pa.large_binary(), shard.n_docs, buffers).cast(pa.binary())
    codes = keys.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    columns = [keys.take(pa.array(first)), pa.array(np.full(len(first), number, np.int32)), pa.array(first)]
    columns += [pa.array((shard.ends - shard.lengths)[first]), pa.array(np.diff(np.r_[first, shard.n_docs]))]
    columns.append(pa.array(np.add.reduceat(shard.lengths, first)))
    whole = pa.RecordBatch.from_arrays(columns, ["key", "shard", "doc", "offset", "n_docs", "n_ids"])
    yield from (whole.slice(at, 10_000) for at in range(0, len(whole), 10_000))


def locate(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, shard, last, doc, offset) of the keys that the index has; each key once.

    Keys go to the task of their part; a part is a few megabytes.
    """
    index = spark.read.parquet(f"{path}/index")
    parts = index.agg(F.max("parts")).head()[0] or 1
    asked = keys.select(key_bytes(F.col(id_col)).alias("key")).distinct()
    asked = asked.select("key", *_hashes("key")).withColumn("part", F.pmod("h1", F.lit(parts)).cast("int"))
    schema = "key binary, shard int, last int, doc long, offset long"
    names = ["key", "shard", "last", "doc", "offset"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        perfect = PerfectHash.from_bytes(right["hash"][0].as_py())
        places = np.frombuffer(right["places"][0].as_py(), PLACE)
        h1, h2 = (left[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        slots = perfect.slots(h1, h2)
        hit = np.flatnonzero(slots >= 0)
        hit = hit[places["print"][slots[hit]] == _fingerprint(h1[hit], h2[hit])]
        at = places[slots[hit]]
        columns = [left["key"].take(pa.array(hit)), *[pa.array(at[n].astype(np.int64)).cast(k) for n, k in zip(names[1:], kinds[1:])]]
        return pa.table(columns, names=names)

    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(look_up, schema)


def fetch(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, shard, doc, start, n_tokens, ids) of the documents that have the given keys.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned
    32-bit integers. Places are sorted by shard, so a file is opened once.
    """
    kind = keys.schema[id_col].dataType.simpleString()
    found = locate(spark, path, keys, id_col)
    found = found.select("key", F.col("shard").alias("first"), "doc", F.explode(F.sequence("shard", "last")).alias("shard"))
    doc = F.when(F.col("shard") == F.col("first"), F.col("doc")).otherwise(0)
    found = found.select("key", "shard", doc.alias("doc")).join(shard_files(spark, path), "shard")
    places = found.select("shard", "doc", "key", "path").repartition("shard").sortWithinPartitions("shard", "doc")
    schema = "key binary, shard int, doc long, offset long, n_tokens long, ids binary"
    rows = places.mapInArrow(_documents, schema)
    directory = spark.read.parquet(f"{path}/directory").select("shard", F.col("start").alias("base"))
    rows = rows.join(directory, "shard")
    text = F.when(F.substring("key", 1, 1) == F.lit(b"k"), F.expr("substring(key, 2)").cast("string"))
    return rows.select(
        text.cast(kind).alias(id_col), "shard", "doc", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents at places that come sorted by shard and document."""
    for batch in batches:
        shards, docs, keys, paths = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(docs):
            number = shards[at]
            with open_shard(paths[at]) as shard:
                wanted: list[int] = []
                while at < len(docs) and shards[at] == number:
                    doc = docs[at]
                    while doc < shard.n_docs and shard.key(doc) == keys[at]:
                        wanted.append(doc)
                        doc += 1
                    at += 1
                yield from _read_documents(number, shard, wanted)


def _read_documents(number: int, shard: Shard, wanted: list[int]) -> Iterator[pa.RecordBatch]:
    """Neighbours are read at once, up to a bounded number of bytes."""
    at = 0
    while at < len(wanted):
        end, room = at + 1, READ_BYTES // shard.width - int(shard.lengths[wanted[at]])
        while end < len(wanted) and wanted[end] == wanted[end - 1] + 1 and shard.lengths[wanted[end]] <= room:
            room -= int(shard.lengths[wanted[end]])
            end += 1
        docs = np.array(wanted[at:end])
        ids = shard.ids(wanted[at], wanted[end - 1])
        ends = np.r_[0, np.cumsum(shard.lengths[docs])] * 4
        packed = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
        columns = [pa.array([shard.key(d) for d in wanted[at:end]], pa.binary()), pa.array(np.full(len(docs), number, np.int32))]
        columns += [pa.array(docs), pa.array((shard.ends - shard.lengths)[docs]), pa.array(shard.lengths[docs]), packed.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "shard", "doc", "offset", "n_tokens", "ids"])
        at = end
