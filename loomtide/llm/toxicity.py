"""Toxicity by a convolutional text classifier trained in numpy.

Words are runs of letters, digits and non-ASCII bytes with A-Z lowered. A word's
embedding is the pair of rows that two hashes pick from two tables, so two words are
confused only if both hashes meet. Filters of several widths slide over the
whole text, their largest activations are pooled, and a logistic layer scores
them. Rows that training never touched are set to zero: unseen words say nothing,
however many a text has.

Training is stochastic and takes a bounded sample of labelled rows: at most
``positives`` and ``negatives`` of the two labels, those of the smallest hash of their id. Each of several first
weights is trained on the sample in a task; the driver gets the sample's ids and labels and the models, about
2 MB each, but no words. The score is set back to the labels' true shares. Per language, the threshold is the
one of best F1 over all labelled rows that took no part in training, or the common one where a
language has fewer than ``LEAST`` toxic rows there. Those rows are scored and counted by score bin
on Spark; the rows of each label stand for all of that label, so thresholds are for the labels' true shares at
every size.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import buffers as B
from .storage import cut, small_batches

TABLE_BITS, DIM, FILTERS, WIDTHS = 16, 4, 8, (1, 2, 3)
POSITIVES, NEGATIVES, STEPS, LEAST = 4000, 8000, 2500, 20
SEEDS = (11, 12, 13)
PAD = max(WIDTHS) - 1
#: Score bins a unit of log odds.
BINS = 20
MARKS = np.zeros(256, bool)
MARKS[:128] = [not (chr(b).isalnum()) for b in range(128)]


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (64-bit) of all texts in one array, and n + 1 offsets."""
    data, offsets = B.text_bytes(column)
    hashes, counts = [], []
    for i, j in B.pieces(offsets):
        part, off = B.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = B.word_spans(part, off, MARKS)
        hashes.append(B.span_hashes(part, starts, ends))
        counts.append(np.diff(first))
    counts = np.concatenate([*counts, np.zeros(0, np.int64)])
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


@dataclass
class Model:
    tables: np.ndarray  # 2 x rows + 1 x DIM; the last row is the padding's
    filters: list[np.ndarray]  # per width: width x 2 DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def padded(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of both tables for the texts one after another, each with padding behind; starts and lengths (at least 1)."""
        sizes = np.diff(offsets)
        held = np.maximum(sizes, 1)
        starts = np.concatenate([[0], np.cumsum(held + PAD)])[:-1]
        rows = np.full((2, int((held + PAD).sum())), 1 << TABLE_BITS, np.int32)
        at = np.repeat(starts - offsets[:-1], sizes) + np.arange(len(hashes))
        rows[0, at] = (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int32)
        rows[1, at] = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        return rows, starts, held

    def activations(self, rows: np.ndarray) -> list[np.ndarray]:
        x = np.concatenate([self.tables[0][rows[0]], self.tables[1][rows[1]]], axis=1)
        out = []
        for f, w in enumerate(self.filters):
            n = len(x) - len(w) + 1
            z = x[:n] @ w[0]
            for j in range(1, len(w)):
                z += x[j : j + n] @ w[j]
            z += self.bias[f]
            out.append(z)
        return out

    def scores(self, hashes: np.ndarray, offsets: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
        logits = np.zeros(len(offsets) - 1)
        # A text longer than the piece is pooled over overlapping parts, so memory stays bounded; each
        # window begins in one part, and only those at the text's end reach into padding.
        for i, j in B.pieces(offsets, piece):
            pooled = None
            if j == i + 1 and offsets[j] - offsets[i] > piece:
                for s in range(int(offsets[i]), int(offsets[j]), piece):
                    e = min(s + piece + PAD, int(offsets[j]))
                    part = self._pooled(hashes[s:e], np.array([0, e - s]), piece)
                    pooled = part if pooled is None else np.maximum(pooled, part)
            else:
                pooled = self._pooled(hashes[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            logits[i:j] = np.maximum(pooled, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))

    def _pooled(self, hashes: np.ndarray, offsets: np.ndarray, most: int | None = None) -> np.ndarray:
        rows, starts, held = self.padded(hashes, offsets)
        cells = np.stack([starts, starts + (held if most is None else np.minimum(held, most))], axis=1).ravel()
        out = []
        for z in self.activations(rows):
            z = np.concatenate([z, np.full((PAD + 1, z.shape[1]), -np.inf, z.dtype)])
            out.append(np.maximum.reduceat(z, cells, axis=0)[::2])
        return np.concatenate(out, axis=1)


def train(hashes: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 11, batch: int = 32, rate: float = 0.05) -> Model:
    """About ``steps`` batches, in 3 to 80 rounds over the texts, of Adagrad on the logistic loss.

    Gradients reach the embeddings through the pooled places alone.
    """
    epochs = 0 if not len(hashes) else min(80, max(3, -(-steps * batch // len(hashes))))
    rng = np.random.default_rng(seed)
    size = (1 << TABLE_BITS) + 1
    m = Model(
        rng.normal(0, 0.05, (2, size, DIM)).astype(np.float32),
        [rng.normal(0, 0.5, (w, 2 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full((len(WIDTHS), FILTERS), 0.05, np.float32),
        rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float64),
        0.0,
    )
    m.tables[:, -1] = 0
    touched = np.zeros((2, size), bool)
    g_tables = np.full(m.tables.shape, 1e-3, np.float32)
    g_filters, g_bias = [np.full(w.shape, 1e-2, np.float32) for w in m.filters], np.full(m.bias.shape, 1e-2, np.float32)
    g_out, g_out_bias = np.full(m.out.shape, 1e-2), 1e-2
    sizes = np.array([len(h) for h in hashes])
    for _ in range(epochs):
        order = rng.permutation(len(hashes))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            offsets = np.concatenate([[0], np.cumsum(sizes[pick])]).astype(np.int64)
            rows, starts, held = m.padded(np.concatenate([*(hashes[i] for i in pick), np.zeros(0, np.uint64)]), offsets)
            touched[0, rows[0]] = touched[1, rows[1]] = True
            acts = m.activations(rows)
            places = np.stack([[s + z[s : s + n].argmax(0) for s, n in zip(starts, held, strict=True)] for z in acts])  # width, text, filter
            pooled = np.stack([np.take_along_axis(z, p, 0) for z, p in zip(acts, places, strict=True)])
            alive = np.maximum(pooled, 0).transpose(1, 0, 2).reshape(len(pick), -1).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(alive @ m.out + m.out_bias, -40, 40)))
            d = (p - labels[pick]) / len(pick)
            back = (np.outer(d, m.out).reshape(len(pick), len(WIDTHS), FILTERS).transpose(1, 0, 2) * (pooled > 0)).astype(np.float32)
            grad = alive.T @ d + 1e-5 * m.out
            g_out += grad**2
            m.out -= rate * grad / np.sqrt(g_out)
            g_out_bias += float(d.sum()) ** 2
            m.out_bias -= rate * float(d.sum()) / np.sqrt(g_out_bias)
            at_rows, at_grads = [[], []], [[], []]
            for f, w in enumerate(m.filters):
                gw = np.zeros_like(w)
                for j in range(len(w)):
                    r = rows[:, (places[f] + j).ravel()]
                    x = np.concatenate([m.tables[0][r[0]], m.tables[1][r[1]]], axis=1).reshape(len(pick), FILTERS, -1)
                    gw[j] = np.einsum("nfd,nf->df", x, back[f])
                    gx = (back[f][:, :, None] * w[j].T[None]).reshape(-1, 2 * DIM)
                    for t in (0, 1):
                        at_rows[t].append(r[t])
                        at_grads[t].append(gx[:, t * DIM : (t + 1) * DIM])
                g_filters[f] += gw**2
                m.filters[f] -= rate * gw / np.sqrt(g_filters[f])
                gb = back[f].sum(0)
                g_bias[f] += gb**2
                m.bias[f] -= rate * gb / np.sqrt(g_bias[f])
            for t in (0, 1):
                which, inverse = np.unique(np.concatenate(at_rows[t]), return_inverse=True)
                g = np.zeros((len(which), DIM), np.float32)
                np.add.at(g, inverse, np.concatenate(at_grads[t]))
                g[which == size - 1] = 0
                g_tables[t, which] += g**2
                m.tables[t, which] -= rate * g / np.sqrt(g_tables[t, which])
    m.tables[~touched] = 0
    return m


def held_out(labels: np.ndarray) -> np.ndarray:
    """Whether a text is kept from training: every fifth, or none where too few or only one label would be left."""
    test = np.arange(len(labels)) % 5 == 0
    if not labels[~test].any() or labels[~test].all() or len(labels) < 50:
        test[:] = False
    return test


def packed(hashes: np.ndarray) -> np.ndarray:
    """The bits of word hashes that pick rows of the tables, in 32 bits; ``unpacked`` puts them back in their places."""
    return (hashes >> np.uint64(64 - TABLE_BITS) << np.uint64(TABLE_BITS) | hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.uint32)


def unpacked(bits: np.ndarray) -> np.ndarray:
    wide = bits.astype(np.uint64)
    return wide >> np.uint64(TABLE_BITS) << np.uint64(64 - TABLE_BITS) | wide & np.uint64((1 << TABLE_BITS) - 1)


def _attempt(rows: pa.Table) -> pa.Table:
    """The model of one seed, trained on the sample, and its loss on the texts held out."""
    seed = rows["seed"][0].as_py()
    ids, labels, words = (rows[c].to_pylist() for c in ("doc_id", "label", "words"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], words[i]))
    y, texts = np.array([labels[i] for i in order], np.float64), [unpacked(np.frombuffer(words[i], np.uint32)) for i in order]
    test = held_out(y)
    model, loss = train([w for w, t in zip(texts, test, strict=True) if not t], y[~test], seed=seed), 0.0
    if test.any():
        held = [w for w, t in zip(texts, test, strict=True) if t]
        p = model.scores(np.concatenate(held), np.concatenate([[0], np.cumsum([len(w) for w in held])]).astype(np.int64))
        p = np.clip(p, 1e-9, 1 - 1e-9)
        loss = float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
    return pa.table({"seed": pa.array([seed], pa.int32()), "loss": [loss], "model": [pickle.dumps(model)]})


def best_of(sample: DataFrame, seeds: tuple[int, ...] = SEEDS) -> Model:
    """The model of several first weights that has the smallest loss on held-out texts; few texts make training depend on its start.

    ``sample`` has doc_id, label and words. Ranges let the seeds be trained side by side, but their bounds
    are sampled, so that two seeds may meet in one task, one after the other.
    """
    each = sample.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).repartitionByRange(len(seeds), "seed")
    models = each.groupBy("seed").applyInArrow(_attempt, "seed int, loss double, model binary")
    return pickle.loads(models.orderBy("loss", "seed").first()["model"])


def best_threshold(toxic: np.ndarray, clean: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The threshold of best F1 between bins of falling score, halfway from a bin's lowest to the next one's highest; 0.5 without both labels."""
    if not toxic.any() or not clean.any():
        return 0.5
    hits = np.cumsum(toxic)
    i = int(np.argmax(2 * hits / (hits + np.cumsum(clean) + hits[-1])))
    return float((low[i] + (high[i + 1] if i + 1 < len(high) else 0)) / 2)


def calibrate(scored: DataFrame) -> dict[str, float]:
    """Thresholds by language, the common one under "", from rows (lang, label, held, score, bin).

    Only held rows are compared; they count as many as all rows of their label. What comes to the driver is
    at most a row for each bin, label and language of ``LEAST`` held toxic rows.
    """
    spread = F.min("score").alias("low"), F.max("score").alias("high")
    bins = cut(scored.groupBy("lang", "label", "held", "bin").agg(F.count("*").alias("n"), *spread), "bins")
    rows = bins.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), F.col("n"))).alias("held")).collect()
    weights = {r["label"]: r["n"] / r["held"] for r in rows if r["held"]}

    def best(counted: list) -> float:
        at = {}
        for r in counted:
            x = at.setdefault(r["bin"], [0.0, 0.0, 1.0, 0.0])
            x[0 if r["label"] else 1] += r["n"] * weights[r["label"]]
            x[2], x[3] = min(x[2], r["low"]), max(x[3], r["high"])
        return best_threshold(*np.array([at[k] for k in sorted(at, reverse=True)]).reshape(-1, 4).T)

    held = bins.where("held")
    whole = held.groupBy("label", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = {"": best(whole.collect())}
    enough = held.where("label = 1 and lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("lang")
    langs = {}
    for r in held.join(enough, "lang").collect():
        langs.setdefault(r["lang"], []).append(r)
    return out | {lang: best(counted) for lang, counted in langs.items() if lang}


def _hashes(batches):
    for b in batches:
        hashes, offsets = word_ids(b.column(b.schema.get_field_index("text")))
        bits = packed(hashes)
        blobs = [bits[offsets[i] : offsets[i + 1]].tobytes() for i in range(b.num_rows)]
        cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "label")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(blobs, pa.binary())], ["doc_id", "label", "words"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on documents joined with their labels.

    Rows without an id or a label of 0 or 1 take no part; of a repeated id all rows
    may. With one label only, or none, the model scores every text with the labels' share
    (0 without labels). ``lang`` chooses thresholds and is no input of the score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    # Whole texts are read for the sample's ids alone.
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(7), "doc_id")
    sample = known.where("label = 1").orderBy(order, "doc_id").limit(positives).union(known.where("label = 0").orderBy(order, "doc_id").limit(negatives))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    sample = cut(rows.mapInArrow(_hashes, "doc_id long, label int, words binary"), "sample")
    held = sample.select("doc_id", "label").orderBy("doc_id", "label").toArrow()
    y = np.array(held["label"].to_pylist(), np.float64)
    if not y.any() or y.all():
        share = float(y.mean()) if len(y) else 0.0
        empty = train([], np.zeros(0), 0)
        empty.out[:] = 0
        empty.out_bias = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20))
        return empty
    test = held_out(y)
    model = best_of(sample, SEEDS if test.any() else SEEDS[:1])
    model.out_bias += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    if test.any():
        trained = sorted({i for i, t in zip(held["doc_id"].to_pylist(), test, strict=True) if not t})
        trained = spark.createDataFrame([(i, False) for i in trained], "doc_id long, held boolean")
        shared = spark.sparkContext.broadcast(model)

        def run(batches):
            for b in batches:
                s = shared.value.scores(*word_ids(b.column(2)))
                odds = np.log(np.maximum(s, 1e-18)) - np.log(np.maximum(1 - s, 1e-18))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(np.floor(odds * BINS).astype(np.int32))], ["doc_id", "lang", "score", "bin"])

        every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("doc_id is not null")
        scored = every.mapInArrow(run, "doc_id long, lang string, score double, bin int").join(known, "doc_id")
        model.thresholds = calibrate(scored.join(F.broadcast(trained), "doc_id", "left").withColumn("held", F.coalesce("held", F.lit(True))))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with toxicity double (0 to 1) and toxic boolean, by the language's threshold.

    Null and empty texts are scored as a text without known words; an unknown or null language
    uses the common threshold. Texts of any length are scored whole, rows that repeat an id or have none each
    on their own. Columns named toxicity or toxic are replaced. The model (about 2 MB whatever the data) is
    broadcast, and of each row only the text goes to Python and only the score comes back.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(*word_ids(texts)))

    scored = docs.drop("toxicity", "toxic").withColumn("toxicity", toxicity(F.col(text_col)))
    common = model.thresholds.get("", 0.5)
    limit = F.lit(common)
    for lang, t in sorted(model.thresholds.items()):
        if lang:
            limit = F.when(F.col(lang_col) == lang, t).otherwise(limit)
    return scored.withColumn("toxic", F.col("toxicity") >= limit)
