"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring symbols that no vocabulary token contains can never be merged across, so the
place between them is a certain cut. Texts are cut at white space, at the pre-tokenizer's borders and
at every such pair; each fragment is merged on its own and the ids are concatenated, which gives the
ids of the whole text. Fragments and words repeat, so both are looked up in bounded caches.

Spark deals the rows out; each task streams Arrow batches and holds one slice of rows at a time.

Defined results: a null or empty text has no tokens (empty ids, empty decoded text); null ids and
repeated rows pass through row by row; input columns other than those named are not carried, so
clashing names can't disturb the output.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Words kept in a worker's cache; a full cache starts afresh.
CACHE_WORDS = 700_000
#: Rows handled at a time within an Arrow batch.
SLICE = 500
#: Beyond this character Unicode tables of different ages may disagree, so the tokenizer's own decide.
LAST_LATIN = "\u024f"

#: Marks that end words often; after a run of letters they are a piece of their own.
MARKS = frozenset(".,!?;:)")
#: Bits of a token id.
SHIFT = 20
NEVER = 1 << 60

_LOADED: dict[str, Bpe] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(shown))
    return names


class Bpe:
    """Vocabulary, merge ranks and certain cuts of one tokenizer file with word ends and byte alphabet."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left << SHIFT | right) to (rank << SHIFT | merged), all by token id.
        self.merges = {
            self.vocab[a] << SHIFT | self.vocab[b]: rank << SHIFT | self.vocab[a + b]
            for rank, (a, b) in enumerate(merges)
        }
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *added.values()]) + 1
        self.tokens = [b""] * size
        for t, i in [*self.vocab.items(), *added.items()]:
            self.tokens[i] = t.encode()
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        names = byte_alphabet()
        #: Id of each byte's symbol, inside a piece and at its end; by the byte's stand-in for pieces
        #: that the tokenizer's own splitter has mapped already.
        self.inner = [self.vocab[names[b]] for b in range(256)]
        self.last = [self.vocab[names[b] + self.suffix] for b in range(256)]
        self.byte_of = {c: b for b, c in names.items()}
        self.joined = self._pairs_inside_tokens()
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.fragments: dict[tuple[int, ...], list[int]] = {}
        self.words: dict[bytes, bytes] = {}

    def _pairs_inside_tokens(self) -> set[int]:
        """Neighbouring symbols of any token, as left << SHIFT | right; the last symbol has the word end."""
        seen: set[int] = set()
        for token in self.vocab:
            ended = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = token[: -len(self.suffix)] if ended else token
            s = [self.inner[self.byte_of[c]] for c in body]
            if ended:
                s[-1] = self.last[self.byte_of[body[-1]]]
            seen.update(a << SHIFT | b for a, b in zip(s, s[1:]))
        return seen

    def merge(self, parts: list[int]) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is merged, leftmost first, until none is left."""
        get = self.merges.get
        order = [get(a << SHIFT | b, NEVER) for a, b in zip(parts, parts[1:])]
        while order:
            low = min(order)
            if low == NEVER:
                break
            i = order.index(low)
            new = parts[i] = low & ((1 << SHIFT) - 1)
            del parts[i + 1], order[i]
            if i:
                order[i - 1] = get(parts[i - 1] << SHIFT | new, NEVER)
            if i < len(order):
                order[i] = get(new << SHIFT | parts[i + 1], NEVER)
        return parts

    def encode_fragment(self, fragment: list[int]) -> list[int]:
        if len(fragment) == 1:
            return fragment
        key = tuple(fragment)
        ids = self.fragments.get(key)
        if ids is None:
            ids = self.merge(fragment)
            if len(key) <= 32:
                if len(self.fragments) >= CACHE_WORDS // 4:
                    self.fragments.clear()
                self.fragments[key] = ids
        return ids

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-tokenized piece: cut where no token joins, merge what lies between."""
        symbols = [self.inner[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        joined = self.joined
        cuts = [i for i, (a, b) in enumerate(zip(symbols, symbols[1:]), 1) if a << SHIFT | b not in joined]
        if not cuts:
            return self.encode_fragment(symbols)
        ids, start = [], 0
        for i in cuts:
            ids += self.encode_fragment(symbols[start:i])
            start = i
        ids += self.encode_fragment(symbols[start:])
        return ids

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        ids: list[int] = []
        for piece in self.split(text):
            ids += self.encode_piece(piece)
        return ids

    def split(self, text: str) -> list[bytes]:
        """Normalised pieces that no token crosses."""
        if text and max(text) > LAST_LATIN:
            mapped = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes([self.byte_of[c] for c in piece]) for piece, _ in mapped]
        text = unicodedata.normalize("NFC", text).lower()
        if text.isalpha():
            return [text.encode("utf-8")]
        if text and text[-1] in MARKS and text[:-1].isalpha():
            return [text[:-1].encode("utf-8"), text[-1].encode("utf-8")]
        return [piece.encode("utf-8") for piece in self.pieces.findall(text)]

    def encode_word(self, word: bytes) -> bytes:
        """Little-endian ids of a run without ASCII white space."""
        if word.isalpha():
            ids = self.encode_piece(word.lower())
        elif b"<|" in word:
            ids = []
            for part in self.special.split(word.decode("utf-8")):
                ids += [self.added[part]] if part in self.added else self.encode_plain(part)
        else:
            ids = self.encode_plain(word.decode("utf-8"))
        return array("I", ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text as little-endian unsigned 32-bit integers."""
        if b"<|" not in text:
            text = text.lower()  # ASCII only; the tokenizer lowers anyway, and fewer words differ
        cache, out = self.words, []
        for w in text.split():
            ids = cache.get(w)
            if ids is None:
                ids = self.encode_word(w)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(w) <= 64:
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Token strings joined by spaces, special tokens included."""
        return b" ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_tokens, ids (binary, little-endian 32-bit) and decoded of every row."""
    kept = docs.select(*keep).schema
    slim = docs.select(*keep, docs[text].cast("binary").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                ids = [bpe.encode(t or b"") for t in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i) for i in range(len(keep))),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([bpe.decode(x).decode("utf-8") for x in ids], pa.string()),
                    ],
                    [*keep, "n_tokens", "ids", "decoded"],
                )

    return slim.mapInArrow(run, f"{schema}, n_tokens bigint, ids binary, decoded string")
