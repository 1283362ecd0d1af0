"""Secret scans: three exact base rules, and a character convolution over every other candidate.

The network reads a candidate together with the characters around it: embedding, one convolution,
maximum over positions, one linear unit. It is trained on the labelled findings of all documents: Spark deals
them out in shards, each trains a copy in numpy, and the copies are averaged, round by round (what the base rules accept is positive, other candidates and long words are negative; half of
the positives have the text around them blanked, so that the characters themselves must tell). Scores are calibrated on
held-out findings, and the threshold is the highest that keeps the wanted recall there.

Defined results: a null or empty text has no findings; null ids and repeated rows pass through row by
row; input columns that are not named are not carried. Candidates longer than a window are read window
by window and take their best score. Without enough findings to train on, only base rules report.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")

CONTEXT = 16
WINDOW = 64
#: Distinct findings that train one copy of the network, rounds of training and averaging, and passes over a shard in each.
SHARD, ROUNDS, EPOCHS = 8_192, 3, 4
LEAST_FINDINGS = 20

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base rules: leftmost non-overlapping matches of each kind that are long enough."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, any_word: bool = False) -> list[tuple[int, int]]:
    """Long runs of key characters with a digit; ``any_word`` takes those without one too."""
    if not any_word and not DIGIT.search(text):
        return []
    return [m.span() for m in CANDIDATE.finditer(text) if any_word or DIGIT.search(m[0])]


def overlaps(spans: list[Span], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b, _ in spans)


def symbols(text: str) -> list[int]:
    """One small number per character: printable ASCII its own, everything else 1; 0 pads."""
    return [ord(c) - 30 if " " <= c <= "~" else 1 for c in text]


def windows(text: str, start: int, end: int) -> list[tuple[list[int], int, int]]:
    """(symbols, first, last) of each window over a candidate with its surroundings; first and last bound the candidate."""
    out = []
    for at in range(start, end, WINDOW):
        stop = min(end, at + WINDOW)
        low, high = max(0, at - CONTEXT), min(len(text), stop + CONTEXT)
        out.append((symbols(text[low:high]), at - low, stop - low))
    return out


LENGTH = WINDOW + 2 * CONTEXT
WIDTH, EMBED, FILTERS, ALPHABET = 5, 8, 24, 97


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    const: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    recall: float = 0.0
    precision: float = 0.0

    def forward(self, x: np.ndarray, inside: np.ndarray):
        e = np.concatenate([self.embed[x], inside[:, :, None]], axis=2)
        n, length, width = e.shape
        steps = length - WIDTH + 1
        s = e.strides
        patches = np.lib.stride_tricks.as_strided(e, (n, steps, WIDTH, width), (s[0], s[1], s[1], s[2]))
        patches = np.ascontiguousarray(patches).reshape(n * steps, WIDTH * width)
        a = np.maximum(patches @ self.kernel + self.bias, 0).reshape(n, steps, FILTERS)
        # Padding beyond the text never wins the maximum.
        a = a * (x[:, : steps] > 0)[:, :, None]
        top = a.argmax(axis=1)
        pooled = np.take_along_axis(a, top[:, None, :], axis=1)[:, 0, :]
        return pooled @ self.out + self.const, pooled, top, patches.reshape(n, steps, WIDTH * width)

    def probability(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        z = self.forward(x, inside)[0] * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def encode(found: list[tuple[list[int], int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(found), LENGTH), np.int64)
    inside = np.zeros((len(found), LENGTH), np.float32)
    for i, (s, first, last) in enumerate(found):
        x[i, : len(s)] = s
        inside[i, first:last] = 1
    return x, inside


def fresh(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    width = WIDTH * (EMBED + 1)
    return Network(
        rng.normal(0, 0.3, (ALPHABET, EMBED)).astype(np.float32),
        rng.normal(0, (2 / width) ** 0.5, (width, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        0.0,
    )


def train(
    x: np.ndarray,
    inside: np.ndarray,
    y: np.ndarray,
    epochs: int = 12,
    seed: int = 7,
    n: np.ndarray | None = None,
    share: float | None = None,
    start: Network | None = None,
) -> Network:
    """Adam on the logistic loss, classes weighted equally.

    Row i counts ``n[i]`` times; ``share`` is that of the positives, where these rows are only part of all.
    """
    n = np.ones(len(y), np.float32) if n is None else n
    share = float((n * y).sum() / n.sum()) if share is None else share
    rng = np.random.default_rng(seed)
    net = replace(start or fresh(seed))
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32) * n
    weight /= max(float(n.mean()), 1e-6)
    names = ["embed", "kernel", "bias", "out"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            pick = order[at : at + 64]
            z, pooled, top, patches = net.forward(x[pick], inside[pick])
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            grad = {"out": pooled.T @ d}
            into = d[:, None] * net.out * (pooled > 0)
            rows = np.arange(len(pick))[:, None]
            chosen = patches[rows, top]
            grad["kernel"] = np.einsum("nfw,nf->wf", chosen, into)
            grad["bias"] = into.sum(axis=0)
            back = np.einsum("nf,wf->nfw", into, net.kernel).reshape(len(pick), FILTERS, WIDTH, EMBED + 1)
            at_chars = x[pick][rows[:, :, None], top[:, :, None] + np.arange(WIDTH)]
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], at_chars, back[..., :EMBED])
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                rate = 0.01 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                setattr(net, k, (getattr(net, k) - rate * first[k] / (second[k] ** 0.5 + 1e-8)).astype(np.float32))
            net.const -= 0.01 * float(d.sum())
    return net


def calibrate(net: Network, x: np.ndarray, inside: np.ndarray, y: np.ndarray, recall: float) -> Network:
    """As :func:`calibrate_scores`, on held-out findings."""
    return calibrate_scores(net, net.forward(x, inside)[0].astype(np.float64), y, np.ones(len(y)), recall)


def calibrate_scores(net: Network, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> Network:
    """Platt scaling on held-out scores ``z`` (``n[i]`` findings of label ``y[i]``), then the highest threshold with the
    wanted recall, at least 1/2."""
    total = n.sum()
    center = (n * z).sum() / total
    spread = max(np.sqrt((n * (z - center) ** 2).sum() / total), 1e-6)
    u, a, b = (z - center) / spread, 1.0, 0.0
    # Targets off 0 and 1 keep separable classes finite.
    pos, neg = n[y == 1].sum(), n[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = n * (p * (1 - p) + 1e-9)
        g = np.array([(n * (p - t) * u).sum(), (n * (p - t)).sum()])
        h = np.array([[(w * u * u).sum(), (w * u).sum()], [(w * u).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if abs(move).max() < 1e-8:
            break
    net.scale, net.shift = a / spread, b - a * center / spread
    p = 1 / (1 + np.exp(-np.clip(z * net.scale + net.shift, -30, 30)))
    order = np.argsort(-p[y == 1], kind="stable")
    reached = np.searchsorted(np.cumsum(n[y == 1][order]), recall * pos - 1e-9)
    # Scores were rounded: what lies half a step below the threshold's score counts as reaching it.
    lowest = z[y == 1][order][min(reached, len(order) - 1)] - 5e-4
    net.threshold = max(0.5, float(1 / (1 + np.exp(-np.clip(lowest * net.scale + net.shift, -30, 30)))))
    said = p >= net.threshold
    net.recall = float(n[said & (y == 1)].sum() / pos)
    net.precision = float(n[said & (y == 1)].sum() / max(n[said].sum(), 1))
    return net


def findings(docs: DataFrame, text: str) -> DataFrame:
    """(label, s, a, b) of the labelled findings of all documents: symbols of the window, and where the finding lies in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, s, a, b = [], [], [], []
            for value in batch.column(0):
                t = value.as_py()
                spans = base_spans(t)
                seen = [(x[0], x[1], True) for x in spans]
                seen += [(x, y, False) for x, y in candidates(t, True) if not overlaps(spans, x, y)]
                for start, end, label in seen:
                    if label:
                        m = re.search(r"[A-Za-z0-9+/_.=-]+$", t[start:end])
                        start = start + m.start() if m else start
                    for w in windows(t, start, end)[:1]:
                        labels.append(int(label))
                        s.append(bytes(w[0]))
                        a.append(w[1])
                        b.append(w[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(s, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                ["label", "s", "a", "b"],
            )

    return docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(run, "label int, s binary, a int, b int")


def shown(rows: list[tuple[bytes, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as the network sees them; where ``blank`` is set the text around the finding is spaces."""
    return encode([([2] * a + list(s[a:b]) + [2] * (len(s) - b) if blank else list(s), a, b) for s, a, b, blank, _ in rows])


def per_shard(found: DataFrame, shards: int, work, schema: str) -> DataFrame:
    """``work(rows)`` on each shard of findings, in an order that doesn't depend on how tasks met them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("s", "a", "b", "blank", "label", "n"))))
        return work([r[:5] for r in rows], np.array([r[5] for r in rows], np.float32))

    # A given number keeps small shards from being put into one task.
    return found.repartition(shards, "shard").groupBy("shard").applyInArrow(run, schema)


def trained(found: DataFrame, shards: int, share: float, start: Network) -> Network:
    """The network after ROUNDS rounds: each shard trains a copy on its own findings, and the copies are averaged."""
    spark, net = found.sparkSession, start
    names = ("embed", "kernel", "bias", "out")
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(net)

        def work(rows: list, n: np.ndarray) -> pa.Table:
            x, inside = shown(rows)
            y = np.array([r[4] for r in rows], np.float32)
            # Shards with few findings take few steps: each weighs as its findings.
            got = train(x, inside, y, EPOCHS, turn, n, share, sent.value)
            flat = np.concatenate([*(getattr(got, k).ravel() for k in names), [got.const]]).astype(np.float64)
            at = np.arange(len(flat), dtype=np.int32)
            return pa.table({"at": at, "total": flat * n.sum(), "n": np.full(len(flat), float(n.sum()))})

        parts = per_shard(found, shards, work, "at int, total double, n double")
        # Sums of doubles depend on their order; rounding makes rounds repeatable.
        mean = parts.groupBy("at").agg(F.round(F.sum("total") / F.sum("n"), 9).alias("v")).orderBy("at").toArrow()["v"].to_numpy()
        cuts = np.cumsum([getattr(net, k).size for k in names])
        pieces = np.split(mean, cuts)
        net = Network(*(p.reshape(getattr(net, k).shape).astype(np.float32) for k, p in zip(names, pieces)), float(pieces[-1][0]))
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", recall: float = 0.98) -> Network | None:
    """Train and calibrate on the findings of all documents; None where there are too few of either label.

    Equal findings are one row with their number as weight. A third of them, by hash, is held out.
    """
    key = F.xxhash64("s", "a", "b", "label")
    counted = findings(docs, text).groupBy("label", "s", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    kept = stored(counted.withColumn("h", key), "secret-findings")
    held = F.pmod("h", F.lit(3)) == 0
    sizes = {(r["held"], r["label"]): (r["rows"], r["n"]) for r in kept.groupBy(held.alias("held"), "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    of = lambda part, label: sizes.get((part, label), (0, 0))
    if min(of(False, k)[1] + of(True, k)[1] for k in (0, 1)) < LEAST_FINDINGS or min(of(h, k)[1] for h in (False, True) for k in (0, 1)) < 5:
        return None
    # Half of the positives have the text around them blanked.
    blank = ((F.col("label") == 1) & (F.pmod(F.shiftright("h", 8), F.lit(2)) == 0)).cast("int")
    shards = -(-(of(False, 0)[0] + of(False, 1)[0]) // SHARD)
    rows = kept.withColumn("blank", blank)
    learned = rows.filter(~held).withColumn("shard", F.pmod(F.shiftright("h", 16), F.lit(shards)).cast("int"))
    share = of(False, 1)[1] / (of(False, 0)[1] + of(False, 1)[1])
    net = trained(learned, shards, share, fresh())
    halves = max(1, shards // 2)
    judged = rows.filter(held).withColumn("shard", F.pmod(F.shiftright("h", 16), F.lit(halves)).cast("int"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def work(part: list, n: np.ndarray) -> pa.Table:
        z = np.concatenate([sent.value.forward(*shown(part[at : at + 512]))[0] for at in range(0, len(part), 512)])
        return pa.table({"z": np.round(z.astype(np.float64), 3), "label": np.array([r[4] for r in part], np.int32), "n": n.astype(np.int64)})

    # Scores at three decimals are the rows of a table whose size does not follow the findings.
    scores = per_shard(judged, halves, work, "z double, label int, n bigint").groupBy("z", "label").agg(F.sum("n").alias("n")).orderBy("z", "label").toArrow()
    return calibrate_scores(net, *(scores[c].to_numpy().astype(np.float64) for c in ("z", "label", "n")), recall)


def model_spans(found: list[tuple[str, int, int]], net: Network) -> list[float]:
    """Probability of each candidate (text, start, end), the best of its windows."""
    parts, owner = [], []
    for i, (t, start, end) in enumerate(found):
        for w in windows(t, start, end):
            parts.append(w)
            owner.append(i)
    best = np.zeros(len(found))
    for at in range(0, len(parts), 512):
        p = net.probability(*encode(parts[at : at + 512]))
        np.maximum.at(best, owner[at : at + 512], p)
    return best.tolist()


def scan(
    docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` and spans (array of kind, start, end, score) of every row, by start and kind."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list[Span]] = []
            scores: list[dict[Span, float]] = []
            asked, where = [], []
            for i, value in enumerate(batch.column(len(keep))):
                t = value.as_py() or ""
                own = base_spans(t)
                spans.append(own)
                scores.append({})
                if net is None:
                    continue
                for s in own:
                    asked.append((t, s[0], s[1]))
                    where.append((i, s))
                for a, b in candidates(t):
                    if not overlaps(own, a, b):
                        asked.append((t, a, b))
                        where.append((i, (a, b, "model")))
            for (i, s), p in zip(where, model_spans(asked, net) if asked else []):
                if s[2] != "model":
                    scores[i][s] = p
                elif p >= net.threshold:
                    spans[i] = [*spans[i], s]
                    scores[i][s] = p
            rows = [
                [
                    {"kind": s[2], "start": s[0], "end": s[1], "score": scores[i].get(s)}
                    for s in sorted(own, key=lambda s: (s[0], KINDS.index(s[2])))
                ]
                for i, own in enumerate(spans)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(rows, pa.list_(item))], [*keep, "spans"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(
        run, f"{kept}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    )
