"""Quality by kernel ridge regression on document statistics.

Each text is described by about twenty statistics. Random Fourier features approximate
a Gaussian kernel over the standardised statistics; ridge weights come from normal equations
whose sums are taken per partition and added up in two levels, so all labelled rows
take part and the driver sees at most ``FINAL`` sums. Isotonic regression over ``BINS`` score
bins makes the ridge output a share of good documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import buffers as B
from .storage import cut, small_batches

FEATURES, RIDGE, BINS, FINAL = 256, 1e-3, 1000, 32
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digits", "spaces", "newlines", "stops", "marks", "exclaims", "pipes", "symbols",
    "high_bytes", "distinct_words", "repeated_lines", "log_lines", "line_words", "loud_words", "odd_words", "repeated_pairs",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


ORD = np.arange(256)
CLASSES = [
    (ORD >= 65) & (ORD <= 90), (ORD >= 97) & (ORD <= 122), (ORD >= 48) & (ORD <= 57), _class(" "), _class("\n"), _class("."), _class(",;:?'\"()-"), _class("!"), _class("|"), _class("#$%&*@^~<>{}[]\\/=+_`"),
    ORD >= 128,
]
LETTER = CLASSES[0] | CLASSES[1] | CLASSES[10]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; all finite, also for empty texts."""
    data, offsets = B.text_bytes(column)
    rows = []
    for i, j in B.pieces(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = np.diff(off).astype(float)
        counts = np.stack([_sums(c[part], off) for c in CLASSES]).astype(float)
        starts, ends, first = B.word_spans(part, off)
        sizes = (ends - starts).astype(float)
        words = np.diff(first).astype(float)
        w = np.maximum(words, 1)
        mean = _sums(sizes, first) / w
        sd = np.sqrt(np.maximum(0, _sums(sizes**2, first) / w - mean**2))
        upper, letter = (np.concatenate([[0], np.cumsum(x[part])]) for x in (CLASSES[0], LETTER))
        tail = part[ends - 1] if len(ends) else part[:0]
        loud = (upper[ends] - upper[starts] >= 2) & (2 * (upper[ends] - upper[starts]) >= letter[ends] - letter[starts])
        odd = CLASSES[7][tail] | CLASSES[8][tail] | CLASSES[9][tail]
        h = B.span_hashes(B.LOWER[part], starts, ends)
        # A pair of words counts at the text of its first word, without the pairs that reach into the next text.
        pair = B.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
        inside = np.ones(len(pair), bool)
        inside[(first[1:-1] - 1)[(first[1:-1] > 0) & (first[1:-1] <= len(pair))]] = False
        pairs_before = np.concatenate([[0], np.cumsum(inside)])[np.minimum(first, len(pair))]
        # Lines begin after each line feed and at each text.
        line_starts = np.union1d(off[:-1], np.flatnonzero(part == 10) + 1)
        line_first = np.searchsorted(line_starts, off)
        ends_at = np.append(line_starts[1:], off[-1])
        ends_at = ends_at - (part[np.maximum(ends_at - 1, 0)] == 10) * (ends_at > line_starts) if len(part) else ends_at
        out = np.zeros((j - i, len(STATISTICS)))
        out[:, 14] = B.distinct_counts(h, first) / w
        pairs = np.diff(pairs_before)
        out[:, 20] = np.where(pairs > 0, 1 - B.distinct_counts(pair[inside], pairs_before) / np.maximum(pairs, 1), 0)
        held = np.diff(line_first)
        out[:, 15] = np.where(held > 0, 1 - B.distinct_counts(B.span_hashes(part, line_starts, ends_at), line_first) / np.maximum(held, 1), 0)
        size = np.maximum(n, 1)
        letters = np.maximum(counts[0] + counts[1], 1)
        lines = counts[4] + 1
        for c, x in enumerate((np.log1p(n), np.log1p(words), np.minimum(mean, 60), np.minimum(sd, 60), counts[0] / letters, counts[2] / size, counts[3] / size, counts[4] / size, counts[5] / w, counts[6] / w, counts[7] / w, counts[8] / w, counts[9] / w, counts[10] / size)):
            out[:, c] = x
        out[:, 16], out[:, 17] = np.log1p(lines), np.minimum(words / lines, 200)
        out[:, 18], out[:, 19] = _sums(loud, first) / w, _sums(odd, first) / w
        rows.append(out)
    return np.concatenate([*rows, np.zeros((0, len(STATISTICS)))])


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return run[offsets[1:]] - run[offsets[:-1]]


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -5, 5)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([waves, 0.1 * z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share; a hundredth of the ridge output keeps documents of one step in order."""
        r = self.raw(x)
        level = np.interp(r, self.knots, self.levels) if len(self.knots) else np.clip(r, 0, 1)
        return np.clip(0.99 * level + 0.01 * np.clip(r, 0, 1), 0, 1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nearest non-decreasing sequence by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([*([v] * int(n) for v, _, n in pools), np.zeros(0)])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ``STATISTICS`` of every row as x array<double>; texts are read here and nowhere else."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            at = pa.array((np.arange(len(x) + 1) * len(STATISTICS)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, x array<double>")


def _matrix(batch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(described: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", seed: int = 5) -> Model:
    """Fit on all rows of ``describe`` that have a label of 0 or 1.

    Rows without an id or such a label take no part; repeated rows count each. Without labelled
    rows the model scores 0 everywhere, with one label only its share. What is joined and shuffled are
    the statistics, never texts.
    """
    spark = described.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = cut(described.join(known, "doc_id").select("label", "x"), "labelled")
    d = len(STATISTICS)
    moments = rows.agg(F.count("*").alias("n"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d))).first()
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    sd = np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(d)])
    model = Model(mean, sd, rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + d + 1), np.zeros(0), np.zeros(0))
    if not moments["n"]:
        return model
    shared = spark.sparkContext.broadcast(model)

    def partial_sums(batches):
        width = FEATURES + d + 1
        gram, moment = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            z, y = shared.value.features(_matrix(b)), b.column(b.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            gram += z.T @ z
            moment += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], ["gram", "moment"])

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x, np.float64) for x in table[c].to_pylist()) for c in ("gram", "moment")]
        return pa.table([pa.array([t.tobytes()], pa.binary()) for t in total], ["gram", "moment"])

    sums = rows.mapInArrow(partial_sums, "gram binary, moment binary").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(FINAL)))
    added = sums.groupBy("k").applyInArrow(lambda key, table: add_up(key, table), "gram binary, moment binary").collect()
    gram = sum(np.frombuffer(r["gram"], np.float64) for r in added).reshape(FEATURES + d + 1, -1)
    moment = sum(np.frombuffer(r["moment"], np.float64) for r in added)
    model.weights = np.linalg.solve(gram + RIDGE * moments["n"] * np.eye(len(moment)) / len(moment), moment)
    final = spark.sparkContext.broadcast(model)

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("label")), pa.array(final.value.raw(_matrix(b)))], ["label", "r"])

    at = F.floor(F.least(F.greatest("r", F.lit(-1.0)), F.lit(2.0)) * (BINS / 3)).cast("int")
    bins = rows.mapInArrow(raw, "label int, r double").groupBy(at.alias("bin")).agg(F.avg("r").alias("r"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots = np.maximum.accumulate(np.array([b["r"] for b in bins]))
    model.levels = isotonic(np.array([b["y"] for b in bins]), np.array([float(b["n"]) for b in bins]))
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """Every row of ``describe`` with quality_score double, 0 to 1: doc_id, quality_score.

    Null and empty texts are scored by the statistics of an empty text; repeated rows and null ids are
    kept; texts of any length are read whole, a piece at a time. The model, under 1 MB whatever the
    data, is broadcast.
    """
    shared = described.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(shared.value.scores(_matrix(b)))], ["doc_id", "quality_score"])

    return described.mapInArrow(run, f"doc_id {dict(described.dtypes)['doc_id']}, quality_score double")
