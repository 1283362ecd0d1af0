"""Packing along a space-filling curve: documents of similar words become neighbours in training sequences.

Every document's token counts are hashed into ``BUCKETS`` places, damped, scaled to unit length and projected to
``DIMS`` dimensions by a fixed random matrix. The cell of the projection in a grid of 2^``BITS`` steps
a side has a Hilbert key; Spark range-sorts the documents by it, and each partition fills sequences in that order.
Equal keys are told apart by the row, so copies of one text spread over as many partitions as they need.

A document that doesn't fit is cut at the sequence's end, so sequences are full. What is left at the end of a
partition is cut into sequences whose lengths are powers of two, so nothing is padded.

Ids are kept as 16-bit numbers between the stages where the vocabulary allows it. Only a sequence being filled
is held in memory, beside the document at hand.

Defined results: a null or empty text is its end token alone; null ids and repeated rows pass row by row, each
packed on its own; input columns other than the two named are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import LAST_LATIN, byte_alphabet
from lodestone.llm.common import RecentCache, stored

SEQUENCE = 4096
BUCKETS, DIMS, BITS = 1024, 3, 20
#: Words kept in a worker's cache.
CACHE_WORDS = 900_000
LONGEST_CACHED = 64
#: Unknown words encoded in one call.
TOGETHER = 256
CACHE_RUNS = 10_000
#: ASCII symbols that may stand before and after a word; not the apostrophe, which begins pieces of its own.
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that show whether a tokenizer cuts runs of letters and symbols apart.
PROBES = ("word", "Word.", "(naïve)", "straße###", "--don", "\"Ça\"?!", "été,")
SLICE = 500

_LOADED: dict[str, WordIds] = {}


class WordIds:
    """Ids of a tokenizer whose pre-tokenizer drops white space: no token crosses a blank, so words are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        mark, self.mark_id = next(iter(special.items()))
        self.mark = mark.encode()
        self.special_text = list(special)
        self.special = [s.encode() for s in special]
        pairs = zip(ascii_lowercase, ascii_uppercase)
        self.lowers = all(self.library.encode(a).ids == self.library.encode(b).ids for a, b in pairs)
        #: Place of each id in the hashed count vector.
        ids = np.arange(self.library.get_vocab_size(), dtype=np.uint32)
        self.bucket = ((ids * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % BUCKETS
        self.words = RecentCache(CACHE_WORDS)
        self.model, self.byte_names, self.runs = self.library.model, byte_alphabet(), {}
        self.code = "H" if self.width.itemsize == 2 else "I"
        #: Whether runs of letters and of symbols are pieces of this tokenizer, as the short cut takes them to be.
        self.simple = True
        self.simple = all(
            self.encode_simple(w) == np.array(self.library.encode(w, add_special_tokens=False).ids, self.width).tobytes()
            for w in PROBES
        )

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. What the short cut doesn't cover is encoded many words at a time, told apart by a
        special token that none of them holds."""
        found: dict[bytes, bytes] = {}
        if self.simple:
            for w in words:
                ids = self.encode_simple(w.decode())
                if ids is not None:
                    found[w] = ids
        others = [w for w in words if w not in found and self.mark not in w]
        for part, ids in self._together(others, self.mark.decode()):
            cuts = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            found.update(self._cut(part, ids, cuts, cuts + 1))
        for w in words:
            if self.mark in w:
                ids = self.library.encode(w.decode(), add_special_tokens=False).ids
                found[w] = np.array(ids, self.width).tobytes()
        return found

    def encode_simple(self, word: str) -> bytes | None:
        """Ids of Latin letters with symbols before and after: each run is one piece, which goes straight to the merges."""
        word = word.lower()
        if max(word) > LAST_LATIN or any(s in word for s in self.special_text):
            return None
        core = word.lstrip(SYMBOLS)
        lead, core = word[: len(word) - len(core)], core.rstrip(SYMBOLS)
        if not core.isalpha():
            return None
        tail = word[len(lead) + len(core) :]
        return self.run_ids(lead) + self.piece_ids(core) + self.run_ids(tail)

    def piece_ids(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.byte_names.__getitem__, piece.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def run_ids(self, run: str) -> bytes:
        """Ids of a run of symbols; short ones are remembered, of which there are few."""
        if not run:
            return b""
        ids = self.runs.get(run)
        if ids is None:
            ids = self.piece_ids(run)
            if len(self.runs) < CACHE_RUNS:
                self.runs[run] = ids
        return ids

    def _together(self, words: list[bytes], between: str) -> Iterator[tuple[list[bytes], np.ndarray]]:
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        texts = [between.join([w.decode() for w in part]) for part in parts]
        for part, e in zip(parts, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            yield part, np.array(e.ids, self.width)

    def _cut(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> dict[bytes, bytes]:
        """Ids of every word up to its end; the next word's begin at the start of the same place."""
        raw, size = ids.tobytes(), ids.itemsize
        begins = [0, *(starts[:-1] * size).tolist()]
        return {w: raw[i:j] for w, i, j in zip(words, begins, (ends * size).tolist())}

    def split(self, text: bytes) -> list[bytes]:
        """Words of a text; in lower case where the tokenizer lowers it anyway, so that fewer differ."""
        if self.lowers:
            low = text.lower()
            if not any(s in low for s in self.special):
                return low.split()
        return text.split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every UTF-8 text as little-endian numbers of ``width``; unknown words are encoded together."""
        split = [self.split(t) for t in texts]
        fresh = self.encode_words(self.words.missing(set().union(*split)))
        known = self.words.young
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > LONGEST_CACHED:
                del known[w]
        return out


def load(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


# -- the curve --------------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of every column of ``cells`` (dimensions x points, 0 to 2^bits - 1).

    Works on all points at once: undo the rotations of each level from the top, then Gray-decode and interleave.
    """
    x = cells.astype(np.uint64)
    zero, one = np.uint64(0), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        below = bit - one
        for i in range(len(x)):
            inverted = (x[i] & bit) != zero
            swapped = np.where(inverted, zero, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inverted, below, swapped)
            x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        flip ^= np.where((x[-1] & bit) != zero, bit - one, zero)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = key << one | row >> np.uint64(level) & one
    return key.astype(np.int64)


def projections() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMS))


def curve_keys(documents: list[np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as id arrays; ``bucket`` is the place of each id in the count vector."""
    counts = np.zeros((len(documents), BUCKETS))
    for row, ids in zip(counts, documents):
        row[:] = np.bincount(bucket[ids], minlength=BUCKETS)
    weights = np.log1p(counts)
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    at = (weights @ projections()) / np.where(norms > 0, norms, 1)  # about standard normal
    share = 1 / (1 + np.exp(-1.7 * at))
    cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_keys(cells.T, BITS)


# -- packing ----------------------------------------------------------------------------------------


def encoded(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """(id, ids, curve) of every row."""
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                ids = words.encode(batch.column(1).to_pylist())
                curve = curve_keys([np.frombuffer(x, words.width) for x in ids], words.bucket)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array(curve)], ["id", "ids", "curve"]
                )

    return slim.mapInArrow(run, f"id {kind}, ids binary, curve bigint")


class Filler:
    """Sequences of one partition; pieces are (id, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, size: int, sequence: int):
        self.size, self.sequence = size, sequence
        self.open: list[tuple] = []
        self.filled = 0
        self.full: list[tuple] = []

    def add(self, id, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.size - self.filled]
            self.open.append((id, start, part, len(ids), self.sequence, self.filled))
            self.filled += len(part)
            start += len(part)
            if self.filled == self.size:
                self.close()

    def close(self) -> None:
        self.full += self.open
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def finish(self) -> None:
        """What is left, in sequences of falling powers of two."""
        left, rest = self.open, self.filled
        self.open = []
        room = used = 0
        for id, start, ids, total, _, _ in left:
            while len(ids):
                if used == room:
                    room, used = 1 << rest.bit_length() - 1, 0
                    rest -= room
                    self.sequence += 1
                part, ids = ids[: room - used], ids[room - used :]
                self.full.append((id, start, part, total, self.sequence - 1, used))
                start += len(part)
                used += len(part)


def pack(
    docs: DataFrame, path: str, end: int, size: int = SEQUENCE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents, each id in one: key, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``end`` follows the ids of every document; a sequence has ``size`` tokens, or fewer where their number is a
    power of two.
    """
    rows = encoded(docs, path, key, text).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    ordered = stored(rows, "curve").repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = load(path).width
        filler = Filler(size, TaskContext.get().partitionId() << 33)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*filler.full)) or [()] * 6
            filler.full = []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], ids_type),
                    pa.array(cols[1], pa.int64()),
                    pa.array(map(len, cols[2]), pa.int64()),
                    pa.array([x.tobytes() for x in cols[2]], pa.binary()),
                    *(pa.array(c, pa.int64()) for c in cols[3:]),
                ],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        ids_type = None
        for whole in batches:
            ids_type = whole.schema.field(0).type
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                for id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = np.empty(len(ids) // width.itemsize + 1, "<u4")
                    tokens[:-1] = np.frombuffer(ids, width)
                    tokens[-1] = end
                    filler.add(id, tokens)
                yield flush()
        if ids_type is not None:
            filler.finish()
            yield flush()

    return (
        ordered.select("id", "ids")
        .mapInArrow(
            run,
            f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
        )
        .withColumnRenamed("id", key)
    )
