"""Whitening, packing and cross-tokenizer alignment against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment, packing, whitening
from lodestone.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE, op11_whitening, op12_packing, op13_alignment

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")

TEXTS = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, " \t\n "),
    (5, "one"),
    (6, "The same words, twice over."),
    (7, "The same words, twice over."),
    (7, "The same words, twice over."),
    (None, "a row without an id"),
    (8, "two  blanks, a\ttab ,\nlines \n\nand others　here  "),
    (9, "<|endoftext|> <s> </s> <unk> <|startoftext|> <0x41> it's I'LL 12 345 --"),
    (10, "word " * 30_000),
    (11, "under▁score ▁"),
    (12, "é ü ß Σ İ \U0001f600‍\U0001f525 中文字 ﬁ ５ ½ é ́x"),
    (13, "nul \x00 and \x1c\x1d \x85 ᠎   ﻿"),
]


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return df.withColumns(
        {c: F.lit("x") for c in ("id", "ids", "curve", "row", "start", "copies", "text_key", "pairs", "n", "v")}
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- 11: whitening --------------------------------------------------------------------------------


MATRICES = {
    "identity": np.eye(10),
    "zero": np.zeros((4, 4)),
    "rank one": np.ones((6, 6)),
    "two equal blocks": np.kron(np.eye(2), np.full((3, 3), 2.0)),
    "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    "one": np.array([[3.0]]),
    "close pairs": np.diag(np.abs(np.arange(-10.0, 11))) + np.eye(21, k=1) + np.eye(21, k=-1),
}


def spectrum(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values),) * 2))
    return q @ np.diag(values) @ q.T


MATRICES["clusters"] = spectrum([5.0] * 10 + [1.0] * 20 + [1e-9] * 20)
MATRICES["graded"] = spectrum(10.0 ** -np.arange(40))


@pytest.mark.parametrize("name", MATRICES)
def test_leading_components_match_a_library(name):
    a = MATRICES[name]
    k = min(32, len(a))
    values, vectors = whitening.leading_components(a, k)
    scale = max(np.abs(a).max(), 1e-300) * len(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-14 * scale
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-14 * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-13


def test_sturm_counts_on_an_eigenvalue():
    d, e = np.array([2.0, 2.0]), np.array([1.0])
    assert whitening.sturm_counts(d, e, np.array([0.5, 2.0, 2.5, 3.5])).tolist() == [0, 1, 1, 2]


def plain_whitening(vectors, k=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n = len(x)
    sums = x.sum(0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    deviations = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    return deviations, centred @ basis[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def check_whitening(got, vectors, ids, k):
    deviations, whitened, explained = plain_whitening(vectors, k)
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    assert sorted(by) == sorted(ids) and all(sorted(b) == list(range(1, k + 1)) for b in by.values())
    have = np.array([[by[i][c]["whitened"] for c in range(1, k + 1)] for i in ids])
    signs = np.sign((have * whitened).sum(0))
    assert np.abs(have - whitened * signs).max() < 1e-8
    for i, d in zip(ids, deviations):
        for c in range(1, k + 1):
            r = by[i][c]
            assert (r["n"], int(r["deviation"])) == (len(ids), d)
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-8


@needs_tables
def test_whitening_on_a_table(spark):
    got = op11_whitening(spark, SMALL).collect()
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check_whitening(got, [r["embedding"] for r in table], [r["vec_id"] for r in table], 32)


def test_whitening_edge_cases(spark):
    data = [
        (1, [1.0, 2.0, 0.5]),
        (2, [0.25, -1.0, 3.0]),
        (3, None),
        (4, [1.0, None, 2.0]),
        (5, [float("nan"), 1.0, 1.0]),
        (6, [float("inf"), 1.0, 1.0]),
        (7, [1.0, 2.0]),
        (8, []),
        (9, [-4.0, 0.015625, 0.01]),
        (10, [2.0, 2.0, -2.0]),
        (11, [0.0, 5.0, 1.0]),
    ]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("n", "component", "deviation", "id", "i", "size", "_at")}
    )
    got = whitening.whiten(df, k=2).collect()
    ids = [1, 2, 9, 10, 11]
    check_whitening(got, [v for i, v in data if i in ids], ids, 2)


def test_whitening_without_components(spark):
    schema = "vec_id bigint, embedding array<float>"
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(data, schema)).count() == 0
    line = spark.createDataFrame([(None, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0])], schema)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}  # one direction varies


def test_whitening_deviations_beyond_64_bits(spark):
    data = [(1, [1e300, 0.0]), (2, [-(2.0**40), 3.0]), (3, [2.0**46, 1.0])]
    got = whitening.whiten(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), k=1).collect()
    x = [[2**52 + 10**6, 10**6], [-(2**46) + 10**6, 192 + 10**6], [2**52 + 10**6, 64 + 10**6]]
    sums = [sum(c) for c in zip(*x)]
    want = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want


# -- 12: packing ----------------------------------------------------------------------------------


def word_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def test_word_ids_equal_the_library():
    import random

    r = random.Random(9)
    words = packing.load(WORD_BPE)
    assert words.simple and words.lowers
    parts = ["a", "The", "zq", "é", "Ç", "ß", "ſ", "İ", "ǅ", "中", "1", "'s", "'", ".", "###", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\xa0", "\xad", "´", "ª", "e\u0301", " ", "\n"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(3000)]
    lib = word_library()
    want = [np.array(e.ids, words.width).tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert words.encode([t.encode() for t in texts]) == want


def test_hilbert_keys_walk_through_every_cell():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.arange(1 << bits)
        cells = np.stack([g.ravel() for g in np.meshgrid(*[side] * dims)])
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(keys)))
        walk = cells[:, np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


def check_pieces(pieces, texts, size):
    """Every id of every document in one piece, sequences gapless, of ``size`` or a power of two."""
    lib = word_library()
    spread, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"]) > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        spread[p["doc_id"], p["doc_tokens"]].append((p["start"], p["ids"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total == size or total < size and total & (total - 1) == 0
    want = Counter()
    for i, t in texts:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i, len(ids)] += 1
        for start, part in spread[i, len(ids)]:  # rows of one id and length hold one text here
            assert ids[start : start + len(part) // 4].tobytes() == part
    covered = Counter({k: sum(len(p) // 4 for _, p in parts) for k, parts in spread.items()})
    assert covered == Counter({(i, n): n * rows for (i, n), rows in want.items()})


@pytest.mark.parametrize("size", [4096, 16])
def test_packing_edge_cases(spark, edges, size):
    pieces = packing.pack(edges, WORD_BPE, 2, size).collect()
    check_pieces(pieces, TEXTS, size)


@needs_tables
def test_packing_on_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = rows(docs.select("doc_id", "text"))
    check_pieces(packing.pack(docs, WORD_BPE, 2).collect(), texts, 4096)
    got = op12_packing(spark, SMALL).collect()
    lib = word_library()
    ids = {i: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts}
    for p in got:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert sum(p["length"] for p in got) == sum(map(len, ids.values()))


def test_packing_of_nothing(spark, empty):
    assert packing.pack(empty, WORD_BPE, 2).count() == 0


@needs_tables
def test_neighbours_along_the_curve_are_alike(spark):
    texts = [r[0] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    words = packing.load(WORD_BPE)
    ids = [np.frombuffer(x, words.width) for x in words.encode([t.encode() for t in texts])]
    counts = np.array([np.bincount(i, minlength=1 << 16)[:49408] for i in ids], float)
    unit = np.log1p(counts) / np.maximum(np.linalg.norm(np.log1p(counts), axis=1, keepdims=True), 1e-9)
    order = np.argsort(packing.curve_keys(ids, words.bucket), kind="stable")
    near = (unit[order[1:]] * unit[order[:-1]]).sum(1).mean()
    mixed = np.random.default_rng(0).permutation(len(ids))
    assert near > 1.5 * (unit[mixed[1:]] * unit[mixed[:-1]]).sum(1).mean()


def test_remainders_are_powers_of_two():
    filler = packing.Filler(4096, 0)
    for i, n in enumerate([4000, 500, 7, 1]):
        filler.add(i, np.arange(n, dtype="<u4"))
    filler.finish()
    totals = Counter()
    for _, _, ids, _, sequence, offset in filler.full:
        assert offset == totals[sequence]
        totals[sequence] += len(ids)
    assert sorted(totals.values(), reverse=True) == [4096, 256, 128, 16, 8, 4]


# -- 13: alignment --------------------------------------------------------------------------------


def plain_alignment(texts):
    """Whole texts through the libraries, groups from sets of byte offsets, counts in dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(BYTE_BPE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    from lodestone.llm.bpe import byte_alphabet

    byte_of = {c: b for b, c in byte_alphabet().items()}

    def bytes_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for i, text in texts:
        groups, links = [], Counter()
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            spans_a = [bytes(byte_of.get(c, 0) for c in a_lib.id_to_token(x)) for x in a]
            spans_b = [bytes_b(x) for x in b]
            if b"".join(spans_a) == b"".join(spans_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(s) for s in spans_a]), np.cumsum([len(s) for s in spans_b])
                cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                groups = [([], []) for _ in cuts]
                for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                    for x, g in zip(ids, np.searchsorted(cuts, ends)):
                        groups[g][side].append(x)
                for ga, gb in groups:
                    links.update((x, y) for x in ga for y in gb)
        found.append((i, groups, links))
    counts = Counter()
    for _, _, links in found:
        counts.update(links.keys())
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups, links in found:
        shown = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append(
            (
                i,
                sum(len(g) for g, _ in groups),
                sum(len(g) for _, g in groups),
                len(groups),
                sum(links.values()),
                sum(t for p, t in links.items() if counts[p] == best[p[0]]),
                sum(t * counts[p] for p, t in links.items()),
                hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            )
        )
    return out


def ordered(found):
    return sorted(found, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 20, 0])
def test_alignment_edge_cases(spark, edges, sent):
    got = rows(alignment.alignment_measures(edges, BYTE_BPE, PIECE_BPE, sent=sent))
    assert ordered(got) == ordered(plain_alignment(TEXTS))


@needs_tables
def test_alignment_on_a_table(spark):
    texts = rows(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    assert ordered(rows(op13_alignment(spark, SMALL))) == ordered(plain_alignment(texts))


def test_alignment_of_nothing(spark, empty):
    assert rows(alignment.alignment_measures(empty, BYTE_BPE, PIECE_BPE)) == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    zeros = (0,) * 6 + ("",)
    assert ordered(rows(alignment.alignment_measures(none, BYTE_BPE, PIECE_BPE))) == [(1, *zeros), (2, *zeros)]


def test_stretches_equal_whole_texts():
    import random

    r = random.Random(5)
    aligner = alignment.load(BYTE_BPE, PIECE_BPE)
    alphabet = ["a", "The", "zq", " ", "  ", "\n", "\t", "'s", "1", "é", "中", "▁", "-", ".", "\x00", " ", "ſ"]
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(500)]
    for text, got in zip(texts, aligner.align(texts)):
        whole = aligner.entries([text])[0]
        assert (got is None) == (whole is None)
        if whole is not None:
            assert got[:5] == whole[:5] and sorted(got[5]) == sorted(whole[5])
