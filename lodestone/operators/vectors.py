"""Vectors: hashed embeddings, pooling, exact and approximate nearest neighbours, table algebra."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import arrays
from lodestone.functions.hashing import UINT32, hash32
from lodestone.functions.text import tokens
from lodestone.skew import top_k

# Per-dimension mixing of a term hash.
DIM_STEP = 2654435761
LOW_BITS = (1 << 24) - 1
HALF_RANGE = float(1 << 23)

BLOCK_ROWS = 50_000
#: Inner products that exist at a time in a task (8 bytes each), and how far rounding to six decimals can lift one.
SCORED_CELLS = 4_000_000
ROUNDING = 1e-6


def dim_seeds(dim: int) -> list[int]:
    return [(d * DIM_STEP) % UINT32 for d in range(dim)]


def hash_embedding(c: Column | str, dim: int) -> Column:
    """Signed hashed bag of words of a text, scaled to unit length; zeros for a text without words."""
    seeds = F.array(*[F.lit(s).cast("long") for s in dim_seeds(dim)])
    hashes = F.transform(tokens(c), lambda t: hash32(t))

    def component(seed: Column) -> Column:
        def value(h: Column) -> Column:
            return h.bitwiseXOR(seed).bitwiseAND(F.lit(LOW_BITS)) / F.lit(HALF_RANGE) - F.lit(1.0)

        return F.aggregate(hashes, F.lit(0.0), lambda a, h: a + value(h))

    return arrays.normalized(F.transform(seeds, component))


def hash_embed(df: DataFrame, col: str, dim: int = 768, out: str = "embedding") -> DataFrame:
    """Embed short texts (queries, titles) with column expressions; see encode_corpus for long ones."""
    return df.withColumn(out, hash_embedding(col, dim))


class HashEncoder:
    """The same embedding over Arrow batches: term hashes come in as arrays, numpy mixes them."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.seeds = np.array(dim_seeds(dim), dtype=np.int64)

    def vector(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) == 0:
            return np.zeros(self.dim)
        values, counts = np.unique(hashes, return_counts=True)
        total = np.zeros(self.dim)
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096, None] ^ self.seeds[None, :]
            total += counts[at : at + 4096] @ ((part & LOW_BITS) / HALF_RANGE - 1.0)
        norm = np.sqrt(total @ total)
        return total / norm if norm > 0 else total

    def __call__(self, hashes: pd.Series) -> list[np.ndarray]:
        return [self.vector(np.asarray(h, dtype=np.int64)) for h in hashes]


def encode_corpus(
    df: DataFrame, col: str, dim: int, make_encoder: Callable[[], Callable[[pd.Series], list]] | None = None
) -> DataFrame:
    """(doc_id, embedding) for every row. ``make_encoder`` builds a batch encoder of texts once per
    task; without one the hashed embedding is used. A vector of another size fails the job."""
    id_type = df.schema["doc_id"].dataType.simpleString()
    if make_encoder is None:
        words = F.coalesce(tokens(col), F.array().cast("array<string>"))
        source = df.select("doc_id", F.transform(words, lambda t: hash32(t)).alias("_in"))
        make_encoder = lambda: HashEncoder(dim)
    else:
        source = df.select("doc_id", F.col(col).alias("_in"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            rows = [np.asarray(v, dtype=np.float64) for v in encoder(batch["_in"])]
            if any(len(v) != dim for v in rows):
                raise ValueError(f"the encoder returned a vector that is not of size {dim}")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "embedding": rows})

    return source.mapInPandas(run, f"doc_id {id_type}, embedding array<double>")


def mean_pool(df: DataFrame, group: str, emb: str = "embedding") -> DataFrame:
    """One unit-length mean vector per group. Partial sums are combined before the shuffle, so a
    group holding most rows costs each task one vector."""
    vec = array_to_vector(arrays.doubles(emb))
    pooled = df.groupBy(group).agg(Summarizer.mean(vec).alias("_mean"))
    return pooled.select(group, arrays.normalized(vector_to_array("_mean")).alias(emb))


# ---------------------------------------------------------------- nearest neighbours


def best_pairs(
    left: np.ndarray, right: np.ndarray, k: int, least: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of left, row of right, inner product at six decimals): per left row the ``k`` best that reach its ``least``.

    Of equal products the first rows of ``right`` win. At most SCORED_CELLS products exist at a time, whatever the sizes.
    """
    step = max(1, SCORED_CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        scores = left[at : at + step] @ right.T
        cut = least[at : at + step]
        near = scores >= cut[:, None] - ROUNDING
        if k < len(right) and np.count_nonzero(near) > 4 * k * len(scores):
            kth = np.partition(scores, len(right) - k, axis=1)[:, len(right) - k]
            near = scores >= np.maximum(cut, kth)[:, None] - ROUNDING
        row, col = np.nonzero(near)
        found = np.round(scores[row, col], 6)
        good = found >= cut[row]
        row, col, found = row[good], col[good], found[good]
        order = np.lexsort((col, -found, row))
        row, col, found = row[order], col[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        yield row[place < k] + at, col[place < k], found[place < k]


def _score_block(k: int, threshold: float):
    """Per block of vectors: cosine of every query with the block, best ``k`` per query."""

    def run(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [(q["query_id"].to_numpy()[:0], v["doc_id"].to_numpy()[:0], np.zeros(0))]
        if len(q) and len(v):
            dims = v["embedding"].map(len).to_numpy()
            for dim, some in q.groupby(q["embedding"].map(len)):
                docs = v[dims == dim].sort_values("doc_id")
                if docs.empty or dim == 0:
                    continue
                left = unit_rows(np.stack(some["embedding"].to_numpy()))
                right = unit_rows(np.stack(docs["embedding"].to_numpy()))
                asked, ids = some["query_id"].to_numpy(), docs["doc_id"].to_numpy()
                for row, col, score in best_pairs(left, right, k, np.full(len(left), threshold)):
                    out.append((asked[row], ids[col], score))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "doc_id", "score"), zip(*out))})

    return run


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _top_vectors(q: DataFrame, v: DataFrame, keys: list[str], top_k_: int, threshold: float) -> DataFrame:
    q_type = q.schema["query_id"].dataType.simpleString()
    v_type = v.schema["doc_id"].dataType.simpleString()
    scored = (
        q.groupBy(*keys)
        .cogroup(v.groupBy(*keys))
        .applyInPandas(
            _score_block(top_k_, threshold), f"query_id {q_type}, doc_id {v_type}, score double"
        )
    )
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], top_k_, "doc_id")


#: Vectors of a side from which it is cut into blocks anyway, so that all cores take part.
SPLIT_ROWS = 500


def _block_count(df: DataFrame, rows: int) -> Column:
    """Blocks of at most ``rows`` rows; as many as make a block pair for every core, where there are rows enough."""
    n = df.agg(F.count(F.lit(1))).scalar()
    cores = math.ceil(math.sqrt(df.sparkSession.sparkContext.defaultParallelism))
    spread = F.least(F.lit(float(cores)), F.ceil(n / F.lit(float(SPLIT_ROWS))))
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(rows))), spread).cast("long")


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def recall_vector(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 200,
    threshold: float = 0.3,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top-k cosine neighbours at or above ``threshold``.

    Both sides are cut into hashed blocks of at most about ``block_rows`` rows; each pair of blocks
    is one matrix product that emits only k rows per query, so neither side passes through the
    driver and the scored pairs are never written out.
    """
    n_q, n_v = _block_count(queries, block_rows), _block_count(vectors, block_rows)
    q = queries.select(
        "query_id",
        F.col("embedding"),
        F.pmod(F.xxhash64("query_id"), n_q).alias("_qb"),
        F.explode(_upto(n_v)).alias("_vb"),
    )
    v = vectors.select(
        "doc_id",
        F.col("embedding"),
        F.explode(_upto(n_q)).alias("_qb"),
        F.pmod(F.xxhash64("doc_id"), n_v).alias("_vb"),
    )
    return _top_vectors(q, v, ["_qb", "_vb"], k, threshold)


def fit_cells(vectors: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 10) -> np.ndarray:
    """Coarse cell centres (n_cells × dim) by distributed k-means."""
    data = vectors.select(array_to_vector(arrays.doubles("embedding")).alias("features"))
    return np.stack(KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(data).clusterCenters())


def _nearest_cells(df: DataFrame, key: str, centres: np.ndarray, n: int) -> DataFrame:
    unit = unit_rows(centres)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            scores = unit_rows(np.stack(batch["embedding"].to_numpy())) @ unit.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            yield batch.assign(_cells=[b.tolist() for b in best])

    schema = f"{key} {key_type}, embedding array<double>, _cells array<long>"
    return (
        df.select(key, arrays.doubles("embedding").alias("embedding"))
        .mapInPandas(run, schema)
        .select(key, "embedding", F.explode("_cells").alias("_cell"))
    )


def recall_vector_ann(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 200,
    n_cells: int = 64,
    n_probe: int = 8,
    threshold: float = 0.3,
    centres: np.ndarray | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate top-k: only the ``n_probe`` cells nearest to a query are searched.

    A cell with more than ``block_rows`` vectors is cut into hashed parts, each searched on its own.
    """
    centres = fit_cells(vectors, n_cells) if centres is None else centres
    v = _nearest_cells(vectors, "doc_id", centres, 1)
    parts = v.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).alias("_parts"))
    v = v.join(F.broadcast(parts), "_cell").withColumn("_part", F.pmod(F.xxhash64("doc_id"), "_parts"))
    q = (
        _nearest_cells(queries, "query_id", centres, n_probe)
        .join(F.broadcast(parts), "_cell")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    )
    return _top_vectors(q, v.select("doc_id", "embedding", "_cell", "_part"), ["_cell", "_part"], k, threshold)


# ---------------------------------------------------------------- table algebra


def vector_join(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    """Pair rows on key columns and measure them; ``same_dim`` is false (measures null) on a size mismatch."""
    x, y = F.col("_a"), F.col("_b")
    left = a.withColumn("_a", arrays.doubles("embedding")).drop("embedding")
    right = b.withColumn("_b", arrays.doubles("embedding")).drop("embedding")
    same = F.size(x) == F.size(y)

    def guarded(c: Column) -> Column:
        return F.when(same, c)

    return (
        left.join(right, on)
        .withColumns(
            {
                "same_dim": same,
                "dot": guarded(arrays.dot(x, y)),
                "cosine": guarded(arrays.cosine(x, y)),
                "l1": guarded(arrays.distance1(x, y)),
                "l2": guarded(arrays.distance2(x, y)),
            }
        )
        .drop("_a", "_b")
    )


def normalize_vectors(df: DataFrame, emb: str = "embedding") -> DataFrame:
    return df.withColumn(emb, arrays.normalized(arrays.doubles(emb)))


def vector_norms(df: DataFrame, emb: str = "embedding") -> DataFrame:
    v = arrays.doubles(emb)
    return df.withColumn("norm1", arrays.norm1(v)).withColumn("norm2", arrays.norm2(v))


def combine_vectors(a: DataFrame, b: DataFrame, on: str | list[str], op: str, scale: float = 1.0) -> DataFrame:
    """Row-wise a + scale·b (``add``) or a − scale·b (``subtract``); null where sizes differ."""
    sign = {"add": scale, "subtract": -scale}[op]
    left = a.withColumn("_a", arrays.doubles("embedding")).drop("embedding")
    right = b.withColumn("_b", arrays.doubles("embedding")).drop("embedding")
    both = F.zip_with("_a", "_b", lambda x, y: x + F.lit(sign) * y)
    return (
        left.join(right, on)
        .withColumn("embedding", F.when(F.size("_a") == F.size("_b"), both))
        .drop("_a", "_b")
    )


def scale_vectors(df: DataFrame, factor: float, emb: str = "embedding") -> DataFrame:
    return df.withColumn(emb, F.transform(arrays.doubles(emb), lambda x: x * F.lit(factor)))


def vector_stats(df: DataFrame, by: str | None = None, emb: str = "embedding") -> DataFrame:
    """Mean, sample deviation, minimum and maximum: per vector, or per dimension of each group."""
    v = arrays.doubles(emb)
    if by is None:
        n = F.size(v)
        mean = arrays.total(v) / n
        spread = arrays.total(F.transform(v, lambda x: (x - mean) * (x - mean)))
        return df.withColumns(
            {
                "mean": mean,
                "std": F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0),
                "min": F.array_min(v),
                "max": F.array_max(v),
            }
        )
    metrics = Summarizer.metrics("mean", "std", "min", "max").summary(array_to_vector(v))
    wide = df.groupBy(by).agg(metrics.alias("_s"))
    parts = {m: vector_to_array(F.col(f"_s.{m}")) for m in ("mean", "std", "min", "max")}
    return (
        wide.withColumns({f"_{m}": c for m, c in parts.items()})
        .select(by, F.posexplode(F.arrays_zip("_mean", "_std", "_min", "_max")).alias("dim", "_z"))
        .select(by, "dim", *[F.col(f"_z._{m}").alias(m) for m in ("mean", "std", "min", "max")])
    )
