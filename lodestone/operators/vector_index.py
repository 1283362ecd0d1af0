"""Stored approximate nearest neighbours: inverted cells with product-quantised residuals.

Cells and codebooks are fitted once, on a bounded sample; every vector is then put into its nearest cell, with the
rest of it coded in a few bytes. A search sends the queries to the stored cells: a task scores the codes of a cell
with one table of inner products per query and checks the best of them against the vectors themselves (short vectors
are scored at once, which costs less than their codes), and passes on ``k`` per query, so no vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import arrays
from lodestone.operators.vectors import SCORED_CELLS, best_pairs, unit_rows
from lodestone.skew import top_k

#: Rows the cells and codebooks are fitted on, at most.
SAMPLE = 50_000
CODES = 256
#: Bytes of query vectors sent to all tasks at a time; more queries are searched in several blocks.
QUERY_BYTES = 32 << 20
#: Bytes of a found pair, which count like query vectors: a task holds ``k`` pairs per query.
PAIR_BYTES = 24
#: Bytes of a probed cell of a query, which count like query vectors as well.
PROBE_BYTES = 4
#: Pairs a task gathers before it keeps the best of them.
HELD_PAIRS = 2_000_000
#: Dimensions from which scoring codes first costs less than scoring the vectors of a cell.
CODED_DIM = 256
#: The number of probed cells is the least that gives this share of ASKED sample rows' ten neighbours in the sample.
RECALL, ASKED = 0.95, 500


@dataclass(frozen=True)
class VectorCells:
    """Cell centres (cells × dim), codebooks (subspaces × codes × width), the number of cells a search probes by
    default, and the stored rows (doc_id, embedding, code, cell)."""

    centres: np.ndarray
    codebooks: np.ndarray
    n_probe: int
    rows: DataFrame


def cell_count(n: int) -> int:
    """About the square root of the rows, as a power of two."""
    return 1 << max(0, min(12, round(np.log2(max(1, n)) / 2)))


def _blocks(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows with SCORED_CELLS values or fewer where a row makes ``width`` of them."""
    step = max(1, SCORED_CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def _nearest(data: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centres of every row, of equal ones the first."""
    half = (centres**2).sum(1) / 2
    out = np.empty((len(data), n), np.min_scalar_type(len(centres)))
    for some in _blocks(len(data), len(centres)):
        away = half - data[some] @ centres.T
        out[some] = away.argmin(axis=1)[:, None] if n == 1 else np.argsort(away, axis=1, kind="stable")[:, :n]
    return out


def _means(data: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """k-means of a sample; a centre that loses all its rows stays where it was."""
    centres = data[random.choice(len(data), min(k, len(data)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(data, centres)[:, 0]
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, data)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _probes(data: np.ndarray, centres: np.ndarray, nearest: np.ndarray) -> int:
    """How many cells to probe for the wanted recall at ten, measured on the sample."""
    needed = []
    asked = data[:ASKED]
    for some in _blocks(len(asked), max(len(data), len(centres))):
        ten = np.argsort(-(asked[some] @ data.T), axis=1, kind="stable")[:, :10]
        order = _nearest(asked[some], centres, len(centres))
        place = np.argsort(order, axis=1)  # of every cell, for every asked row
        needed.append(np.take_along_axis(place, nearest[ten], 1).ravel() + 1)
    return int(np.quantile(np.concatenate(needed), RECALL, method="higher"))


def fit(
    vectors: DataFrame, n_cells: int | None = None, subspaces: int = 8, sample: int = SAMPLE, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, int]:
    """Centres, codebooks and probes from the ``sample`` rows of the smallest id hashes."""
    n = vectors.agg(F.count(F.lit(1))).first()[0]
    rows = vectors.select("embedding", F.xxhash64("doc_id").alias("_h"), "doc_id").orderBy("_h", "doc_id").limit(sample)
    data = unit_rows(np.stack([np.asarray(v, float) for v in rows.select(arrays.doubles("embedding")).toPandas().iloc[:, 0]]))
    random = np.random.default_rng(seed)
    centres = _means(data, n_cells or cell_count(n), 12, random)
    nearest = _nearest(data, centres)[:, 0]
    rest = data - centres[nearest]
    width = -(-data.shape[1] // subspaces)
    parts = _split(rest, subspaces, width)
    books = np.stack([_means(parts[:, m], CODES, 8, random) for m in range(subspaces)])
    return centres, books, _probes(data, centres, nearest)


def _split(data: np.ndarray, subspaces: int, width: int) -> np.ndarray:
    """rows × subspaces × width; the last subspaces are filled up with zeros."""
    padded = np.zeros((len(data), subspaces * width))
    padded[:, : data.shape[1]] = data
    return padded.reshape(len(data), subspaces, width)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def encode(vectors: DataFrame, centres: np.ndarray, codebooks: np.ndarray) -> DataFrame:
    """(doc_id, embedding, code, cell) of every row; embeddings of unit length."""
    kind = vectors.schema["doc_id"].dataType.simpleString()
    subspaces, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = unit_rows(_matrix(batch.column(1)))
            cell = _nearest(data, centres)[:, 0]
            rest = _split(data - centres[cell], subspaces, width)
            code = np.empty((len(data), subspaces), np.uint8)
            for m, book in enumerate(codebooks):
                code[:, m] = np.argmax(rest[:, m] @ book.T - (book**2).sum(1) / 2, axis=1)
            offsets = pa.array(np.arange(len(data) + 1, dtype=np.int32) * data.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(offsets, pa.array(data.ravel())),
                    pa.array([c.tobytes() for c in code], pa.binary()),
                    pa.array(cell.astype(np.int32)),
                ],
                ["doc_id", "embedding", "code", "cell"],
            )

    slim = vectors.select("doc_id", arrays.doubles("embedding").alias("embedding"))
    return slim.mapInArrow(run, f"doc_id {kind}, embedding array<double>, code binary, cell int")


def search(
    queries: DataFrame,
    index: VectorCells,
    k: int = 200,
    threshold: float = 0.3,
    n_probe: int | None = None,
    checked: int | None = None,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The best ``k`` cosine neighbours found in each query's ``n_probe`` nearest cells (the index's own number by default).

    Of every stored batch the ``checked`` best by code (4 k by default) are scored exactly, short vectors without that
    selection. A task keeps ``k`` pairs per query and takes further ones only where they reach the worst of those. Queries
    whose vectors, pairs or probes take more than ``query_bytes`` are dealt into blocks, each searched on its own.
    """
    dim = index.centres.shape[1]
    n_probe = min(len(index.centres), n_probe or index.n_probe)
    n = queries.agg(F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-n * max(8 * dim, PAIR_BYTES * k, PROBE_BYTES * n_probe) // query_bytes))
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        got = _search_block(part, index, k, threshold, n_probe, checked or 4 * k)
        found = got if found is None else found.unionByName(got)
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "doc_id")


def _by_code(
    q: np.ndarray, data: np.ndarray, code: pa.Array, centre: np.ndarray, codebooks: np.ndarray, k: int, least: np.ndarray, checked: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As best_pairs, among the ``checked`` best rows by code of every query."""
    subspaces, _, width = codebooks.shape
    codes = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(data), subspaces)
    step = max(1, SCORED_CELLS // max(len(data), checked * data.shape[1], codebooks.size // width))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        tables = np.einsum("qmw,mcw->qmc", _split(some, subspaces, width), codebooks)
        close = np.repeat((some @ centre)[:, None], len(data), axis=1)
        for m in range(subspaces):
            close += tables[:, m, codes[:, m]]
        best = np.sort(np.argpartition(-close, checked - 1, axis=1)[:, :checked], axis=1)
        exact = np.round(np.einsum("qd,qrd->qr", some, data[best]), 6)
        first = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        exact, best = np.take_along_axis(exact, first, 1), np.take_along_axis(best, first, 1)
        good = exact >= least[at : at + step, None]
        yield np.nonzero(good)[0] + at, best[good], exact[good]


def _pruned(held: list[tuple], k: int, least: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The ``k`` best pairs of every query as one piece, and the score a further pair must reach."""
    who, score = (np.concatenate([h[i] for h in held]) for i in (0, 2))
    docs = pa.concat_arrays([h[1] for h in held])
    pairs = pa.table({"who": who, "score": score, "doc": docs})
    order = pc.sort_indices(pairs, [("who", "ascending"), ("score", "descending"), ("doc", "ascending")]).to_numpy()
    who, score = who[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    least = least.copy()
    least[who[place == k - 1]] = score[place == k - 1]
    kept = place < k
    return [(who[kept], docs.take(pa.array(order[kept])), score[kept])], least


def _search_block(
    queries: DataFrame, index: VectorCells, k: int, threshold: float, n_probe: int, checked: int
) -> DataFrame:
    spark = queries.sparkSession
    asked = queries.select("query_id", arrays.doubles("embedding").alias("embedding")).toArrow()  # query_bytes at most
    ids = asked["query_id"].combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    vectors = asked["embedding"].combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    q = unit_rows(_matrix(vectors)) if len(ids) else np.zeros((0, index.centres.shape[1]))
    probed = _nearest(q, index.centres, n_probe).ravel()
    order = np.argsort(probed, kind="stable")
    bounds = np.searchsorted(probed[order], np.arange(len(index.centres) + 1))
    askers = (order // max(1, n_probe)).astype(np.int32)
    sent = spark.sparkContext.broadcast((q, askers, bounds, index.centres, index.codebooks, ids))
    q_type = queries.schema["query_id"].dataType.simpleString()
    d_type = index.rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, askers, bounds, centres, codebooks, ids = sent.value
        least = np.full(len(q), threshold)
        held, n_held, n_best = [], 0, 0
        for batch in batches:
            cells = batch.column(3).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                who = askers[bounds[cell] : bounds[cell + 1]]
                rows = np.flatnonzero(cells == cell)
                if len(who) == 0:
                    continue
                part = batch.take(pa.array(rows))
                data = _matrix(part.column(1))
                if checked < len(rows) and data.shape[1] >= CODED_DIM:
                    found = _by_code(q[who], data, part.column(2), centres[cell], codebooks, k, least[who], checked)
                else:
                    found = best_pairs(q[who], data, k, least[who])
                for row, col, score in found:
                    held.append((who[row], part.column(0).take(pa.array(col)), score))
                    n_held += len(row)
                    if n_held > n_best + HELD_PAIRS:
                        held, least = _pruned(held, k, least)
                        n_held = n_best = len(held[0][0])
        if n_held:
            who, docs, score = _pruned(held, k, least)[0][0]
            for at in range(0, len(who), HELD_PAIRS):
                some = slice(at, at + HELD_PAIRS)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(who[some])), docs[some], pa.array(score[some])], ["query_id", "doc_id", "score"]
                )

    return index.rows.select("doc_id", "embedding", "code", "cell").mapInArrow(
        run, f"query_id {q_type}, doc_id {d_type}, score double"
    )
