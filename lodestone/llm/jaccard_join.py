"""Similarity join on word shingles with PartEnum signatures; components of the linked documents.

Domain partitions: at level m (a power of two that follows the set's size) a shingle belongs to
partition hash mod m, and a set's token in a partition is the hash of all its shingles there. Two sets
with similarity of at least 3/4 differ in at most n/3 shingles (n: either size), so at most n/3
partitions differ, and of either set's tokens all but n/3 agree. Under one global order of tokens the
first n/3 + 1 tokens of both sets then have one in common, which is the signature they share. Sizes
within a band share a level; a set whose possible partners lie in the band below signs there as well.
Where so few partitions are occupied that all could differ, every shingle signs alone, so no pair is lost.

The order puts tokens last that consist only of frequent shingles. It is read from a bounded sample and
decides cost, not results. In a group of one signature every member is compared with the first; members
that are in different components after that are compared inside tasks, in blocks of bounded size. Counts
of shingles in 256 buckets bound the difference of two sets from below, so most comparisons end there;
those that pass are compared exactly on their texts.

Defined results: null text counts as empty; a document without words has no shingles, links with nothing
and is its own component. Equal sets are one class whatever the ids. Repeated rows and repeated ids keep
a row each. A row with a null id takes the component of an equal set that has an id, else null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored
from lodestone.llm.components import components
from lodestone.llm.shingles import mix, shingle_set, signed

#: Documents whose shingles tell which tokens come last.
ORDER_SAMPLE = 16_000
#: Documents whose signatures share a partition, a few hundred each, so that sorting them needs no disk.
ROWS_PER_PART = 2_000
#: Documents of the sample with a shingle that make it frequent.
FREQUENT = 3
BUCKETS = 256
#: Members of a signature group that meet in one block.
BLOCK = 2_048
#: Ids are sent to all tasks, to filter texts before they move, up to this many (8 bytes each).
SENT_IDS = 1_000_000
_ALONE = np.uint64(0xA5A5A5A55A5A5A5A)
_EMPTY = np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> np.uint64:
    """One value for equal sets."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(shingles).sum() ^ np.uint64(len(shingles))], np.uint64))[0]


def level_of(n: int) -> int:
    """The smallest power of two that is at least 3/4 of the size."""
    return 1 << max(0, (3 * n + 3) // 4 - 1).bit_length()


def level_signatures(s: np.ndarray, rare: np.ndarray, m: int) -> tuple[np.ndarray, bool]:
    """The first n/3 + 1 tokens of a set at level m, and whether fewer partitions are occupied."""
    with np.errstate(over="ignore"):
        scrambled = mix(s + np.uint64(m))
        part = scrambled & np.uint64(m - 1)
        # Small numbers are sorted by their digits.
        order = np.argsort(part.astype(np.uint16), kind="stable") if m <= 1 << 16 else np.argsort(part)
        part = part[order]
        fresh = np.empty(len(part), bool)
        fresh[0] = True
        np.not_equal(part[1:], part[:-1], out=fresh[1:])
        starts = np.flatnonzero(fresh)
        content = np.add.reduceat(scrambled[order], starts)
        tokens = mix(content ^ mix((part[starts] << np.uint64(32)) + np.uint64(m)))
        anything_rare = np.logical_or.reduceat(rare[order], starts)
    first = len(s) // 3 + 1
    # Frequent tokens sort last: the highest bit is the order's first key.
    if len(tokens) > first:
        key = (tokens >> np.uint64(1)) | ((~anything_rare).astype(np.uint64) << np.uint64(63))
        tokens = tokens[np.argpartition(key, first - 1)[:first]]
    return tokens, len(starts) <= len(s) // 3


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """All signatures of a set of shingles."""
    if not len(s):
        return s
    at = np.searchsorted(frequent, s)
    rare = frequent[np.minimum(at, len(frequent) - 1)] != s if len(frequent) else np.ones(len(s), bool)
    n = len(s)
    out, risky = [], False
    for m in sorted({level_of(n), level_of(-(-3 * n // 4))}):
        tokens, risk = level_signatures(s, rare, m)
        out.append(tokens)
        risky |= risk
    if risky:
        out.append(mix(s ^ _ALONE))
    # Tokens of one level differ, and so do those of two levels.
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each bucket, up to 255."""
    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def could_be_alike(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m with these sketches can have a Jaccard of 3/4.

    That allows a seventh of both sizes together as difference, and buckets never differ by more than the sets do.
    """
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return 7 * apart <= n.astype(np.int64) + m


def shingled(docs: DataFrame, id_col: str, text: str, frequent: np.ndarray) -> DataFrame:
    """(id, n_shingles, node, sketch, sigs) of every row; node is the class of equal sets, null for empty ones.

    Signatures stand in the first row of a class that a task meets, and only where there is an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, nodes, sketches, sigs = [], [], [], []
            for known, value in zip(batch.column(0).is_valid().to_pylist(), batch.column(1)):
                s = shingle_set(value.as_py())
                sizes.append(len(s))
                if not len(s):
                    for column in (nodes, sketches, sigs):
                        column.append(None)
                    continue
                node = int(class_of(s).view(np.int64))
                nodes.append(node)
                sketches.append(sketch(s))
                sigs.append(signed(signatures(s, frequent)) if known and node not in seen else None)
                if known:
                    seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.array(sigs, pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "node", "sketch", "sigs"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    return slim.mapInArrow(run, "id bigint, n_shingles bigint, node bigint, sketch binary, sigs array<bigint>")


def frequent_shingles(docs: DataFrame, id_col: str, text: str, rows: int) -> np.ndarray:
    """Shingles seen in several sets of a bounded sample; at most the sample's own shingles."""
    share = max(1, rows // ORDER_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {x.as_py() for x in batch.column(0)}
            found = [shingle_set(x) for x in sets]
            if found:
                s, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(s)), pa.array(n, pa.int64())], ["s", "n"])

    picked = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0).limit(2 * ORDER_SAMPLE)
    got = (
        picked.select(F.col(text).cast("binary").alias("t"))
        .mapInArrow(run, "s bigint, n bigint")
        .groupBy("s")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= FREQUENT)
        .select("s")
        .toArrow()
    )
    return np.sort(got.column("s").to_numpy().view(np.uint64)) if got.num_rows else _EMPTY


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def plausible(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose sketches allow enough similarity."""
    left = owners.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    right = owners.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").filter("4 * least(n, m) >= 3 * greatest(n, m)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            good = could_be_alike(n, matrix(batch.column(3)), m, matrix(batch.column(5)))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return sized.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a bigint, b bigint")


def similar(pairs: DataFrame, docs: DataFrame, owners: DataFrame, id_col: str, text: str) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are alike: 100 * common >= 75 * union, compared exactly."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    owner = owners.select("node", "id")
    named = stored(
        pairs.join(owner.withColumnsRenamed({"node": "a", "id": "ida"}), "a")
        .join(owner.withColumnsRenamed({"node": "b", "id": "idb"}), "b")
        .select("a", "b", "ida", "idb"),
        "named-pairs",
    )
    wanted = named.select(F.explode(F.array("ida", "idb")).alias("id")).distinct()
    if wanted.count() <= SENT_IDS:
        texts = texts.join(F.broadcast(wanted), "id", "left_semi")
    left = named.join(texts.withColumnsRenamed({"id": "idb", "t": "tb"}), "idb")
    both = left.join(texts.withColumnsRenamed({"id": "ida", "t": "ta"}), "ida").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, _EMPTY
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column(2), batch.column(3))):
                if a[i] != last:
                    last, s = a[i], shingle_set(ta.as_py())
                t = shingle_set(tb.as_py())
                # Ids that repeat with other texts meet here too: only the classes named count.
                if int(class_of(s).view(np.int64)) != a[i] or int(class_of(t).view(np.int64)) != b[i]:
                    continue
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= 75 * (len(s) + len(t) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"]
            )

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def signature_groups(sets: DataFrame, parts: int) -> DataFrame:
    """(sig, node, head, size) of the nodes that share a signature with others.

    A group's head is the node whose signatures are shared by most others on average: of near copies, mostly what they
    were made from, so that few pairs besides the head's are left to compare.
    """
    group = Window.partitionBy("sig").orderBy("node")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = stored(
        sets.filter("sigs is not null")
        .select(F.explode("sigs").alias("sig"), "node", F.size("sigs").alias("of"))
        .repartition(parts, "sig")
        .withColumn("prev", F.lag("node").over(group))
        .withColumn("first", F.first("node").over(whole))
        .withColumn("last", F.last("node").over(whole))
        # The same class comes once from every task that met it.
        .filter("first <> last and (prev is null or prev <> node)")
        .select("sig", "node", "of"),
        "shared-signatures",
    )
    sizes = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    liked = shared.join(sizes, "sig").groupBy("node").agg((F.sum("size") / F.max("of")).alias("liked"))
    heads = shared.join(liked, "node").groupBy("sig").agg(
        F.max_by("node", F.struct("liked", "node")).alias("head"), F.count(F.lit(1)).alias("size")
    )
    return stored(shared.select("sig", "node").join(heads, "sig"), "signature-groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row."""
    rows = docs.count()
    sets = stored(shingled(docs, id_col, text, frequent_shingles(docs, id_col, text, rows)), "sets")
    owners = stored(
        sets.filter("node is not null and id is not null")
        .groupBy("node")
        .agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")),
        "set-owners",
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_PART)
    members = signature_groups(sets, parts)
    star = members.filter("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(similar(stored(plausible(star, owners), "tried-pairs"), docs, owners, id_col, text), "links")
    found = stored(components(links), "components")
    # Two members have met, and a head has met all others of its group.
    rest = members.filter("size > 2 and head <> node")
    more = stored(open_pairs(rest, found, owners), "open-pairs")
    if not more.isEmpty():
        links = links.unionByName(stored(similar(more, docs, owners, id_col, text), "links"))
        found = stored(components(links), "components")
    named = (
        found.join(owners, "node").groupBy("component").agg(F.min("id").alias("component_id")).join(found, "component")
    ).select("node", "component_id")
    return (
        sets.select("id", "n_shingles", "node")
        .join(named, "node", "left")
        .join(owners.select("node", F.col("id").alias("own")), "node", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "own", "id").alias("component_id"))
    )


def open_pairs(members: DataFrame, found: DataFrame, owners: DataFrame) -> DataFrame:
    """Plausible pairs behind one signature that are in different components so far.

    Members of a group are dealt into blocks, and every two blocks of a group meet in one task; tasks hold
    two blocks at a time and emit only pairs whose sketches allow enough similarity.
    """
    labelled = members.join(found, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
    split = (
        labelled.groupBy("sig")
        .agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"))
        .filter("lo <> hi")
        .select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        labelled.join(split, "sig")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c")
        .join(owners.select("node", "n", "sketch"), "node")
        .select("sig", "i", "j", "own", "node", "c", "n", "sketch")
    )
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    together = dealt.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            out: list[tuple[int, int]] = []
            for row in zip(*cols):
                if row[:3] != key:
                    out += met(held)
                    held, key = [], row[:3]
                held.append(row)
            yield pairs_of(out)
        yield pairs_of(met(held))

    def pairs_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def met(rows: list[tuple]) -> list[tuple[int, int]]:
        """Rows come in order of size; only partners up to 4/3 of the size can be alike."""
        if len(rows) < 2:
            return []
        own, node, c, n = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6))
        x = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, BUCKETS)
        across = rows[0][1] != rows[0][2]
        last = np.searchsorted(3 * n, 4 * n, side="right")
        out = set()
        for k in range(len(rows) - 1):
            s = slice(k + 1, last[k])
            good = (c[s] != c[k]) & (node[s] != node[k])
            if across:
                good &= own[s] != own[k]
            at = np.flatnonzero(good) + k + 1
            if len(at):
                at = at[could_be_alike(n[at], x[at], n[k], x[k])]
                out.update((min(node[k], node[o]), max(node[k], node[o])) for o in at.tolist())
        return [(int(a), int(b)) for a, b in out]

    return together.mapInArrow(run, "a bigint, b bigint").distinct()
