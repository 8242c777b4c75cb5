"""Operator 10: quality scores by random Fourier features, ridge and isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, release, table

#: Random features, the kernel's width in standard deviations, and the ridge.
FEATURES, WIDTH, RIDGE, SEED = 256, 6.0, 1e-2, 7
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 50_000
#: Bins of the calibration.
BINS = 512
_WORD = re.compile(r"[^\W\d_]+")
_CAPS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
STATS = ("log_words", "word_len", "digit", "upper", "space", "newline", "punct", "symbol", "wide", "distinct", "letters",
         "caps", "line_len", "line_distinct", "sentence", "long_word", "short_word", "vowel", "top_word", "control", "end_mark", "non_word")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; a null text counts as an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lens = [len(w) for w in words]
    lines = raw.split(b"\n")
    share = lambda s: float(b[list(s)].sum()) / n
    letters = len(_WORD.findall(text))
    caps = len(_CAPS.findall(text))
    return [
        float(np.log1p(len(words))), sum(lens) / m, share(b"0123456789"), float(b[65:91].sum()) / n, float(b[32]) / n, float(b[10]) / n,
        share(b".,;:!?'\"()-"), share(b"#$%&*+/<=>@[\\]^_`{|}~"), float(b[128:].sum()) / n, len(seen) / m, letters / m,
        caps / m, float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), share(b".!?") * n / m, sum(x > 15 for x in lens) / m, sum(x < 4 for x in lens) / m,
        share(b"aeiouAEIOU"), max(seen.values(), default=0) / m, float(b[:9].sum() + b[14:32].sum() + b[127]) / n,
        sum(w[-1:] in b".!?" for w in words) / m, 1 - float(sum(w.isalpha() for w in words)) / m,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x: the statistics of the whole text) of every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "x": [statistics(t) for t in p["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>")


class Model:
    """Centre and scale of the statistics, the ridge weights, and the calibration's steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        r = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = r.normal(size=(len(mean), FEATURES)) / WIDTH
        self.b = r.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.edges, self.values = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        r = np.concatenate([self.raw(x[a : a + 512]) for a in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        fitted = np.interp(r, self.edges, self.values)
        return np.clip(0.98 * fitted + 0.02 * np.clip(r, 0, 1), 0.0, 1.0)  # the ridge score orders what calibrates alike


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``y`` by weighted squares (pooling neighbours)."""
    value, mass, size = [], [], []
    for v, w in zip(y, weight, strict=True):
        value.append(float(v)); mass.append(float(w)); size.append(1)  # noqa: E702
        while len(value) > 1 and value[-2] >= value[-1]:
            v1, w1, s1 = value.pop(), mass.pop(), size.pop()
            value[-1] = (value[-1] * mass[-1] + v1 * w1) / (mass[-1] + w1)
            mass[-1] += w1
            size[-1] += s1
    return np.repeat(value, size)


def fit(labelled: DataFrame) -> Model:
    """Fit on all rows of (x, y, w, calibrate), w the weight; those with ``calibrate`` only shape the calibration.

    Each partition adds up its part of the normal equations, a matrix of a fixed size; the parts
    are summed row of the matrix by row of the matrix, so that the driver gets one matrix. Without
    rows of both kinds every score is 0.5.
    """
    k = len(STATS)
    x, w = [F.element_at("x", i + 1) for i in range(k)], F.col("w")
    moments = labelled.agg(F.sum(w).alias("w"), *[F.sum(c * w).alias(f"m{i}") for i, c in enumerate(x)], *[F.sum(c * c * w).alias(f"s{i}") for i, c in enumerate(x)]).first()
    n = moments["w"] or 1.0
    mean = np.array([(moments[f"m{i}"] or 0.0) / n for i in range(k)])
    scale = np.sqrt(np.maximum(0, np.array([(moments[f"s{i}"] or 0.0) / n for i in range(k)]) - mean**2))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))

    def equations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for p in parts:
            if len(p):
                x, y, w = np.stack(p["x"].to_numpy()), p["y"].to_numpy(float), p["w"].to_numpy(float)
                for s in (slice(i, i + 512) for i in range(0, len(x), 512)):
                    a = model.features(x[s])
                    b = a * w[s, None]
                    total += np.hstack([b.T @ a, (b.T @ y[s])[:, None]])
        yield pd.DataFrame({"row": np.arange(len(total)), "v": list(total)})

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [p["row"].iloc[0]], "v": [np.sum(np.stack(p["v"].to_numpy()), axis=0)]})

    shape = "row int, v array<double>"
    rows = labelled.where("NOT calibrate").select("x", "y", "w").mapInPandas(equations, shape).groupBy("row").applyInPandas(add, shape).collect()
    if rows:
        m = np.stack([np.array(r["v"]) for r in sorted(rows, key=lambda r: r["row"])])
        model.beta = np.linalg.solve(m[:, : FEATURES + 1] + RIDGE * np.eye(FEATURES + 1), m[:, FEATURES + 1])

    def raw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                r = model.raw(np.stack(p["x"].to_numpy()))
                yield pd.DataFrame({"bin": np.clip(np.floor((r + 0.5) / 2 * BINS), 0, BINS - 1).astype(int), "y": p["y"].to_numpy(float), "w": p["w"].to_numpy(float)})

    bins = labelled.where("calibrate").select("x", "y", "w").mapInPandas(raw, "bin int, y double, w double").groupBy("bin").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("n")).orderBy("bin").collect()
    if bins:
        n = np.array([r["n"] for r in bins], float)
        y = (np.array([r["y"] for r in bins]) * n + 0.5) / (n + 1)
        model.edges, model.values = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5, isotonic(y, n)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    It learns from documents whose CRC-32 of the id, as text, leaves no 0 by 5: remainders 2 to 4 give
    the ridge, 1 the calibration. Beyond ``SAMPLE`` labelled ids, it learns from those whose hash lies
    below the share that gives about so many (the classifier's documented bound; all documents are
    scored). Only the texts of these are described.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    marks = marks.withColumn("fold", _fold(F.col("_id"))).where("fold <> 0").groupBy("_id", "y", "fold").agg(F.count(F.lit(1)).cast("double").alias("w"))
    marks = keep(marks, "labels")
    share = SAMPLE / max(SAMPLE, marks.count())
    some = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = F.broadcast(some.select("_id").distinct())  # about SAMPLE rows at most
    described = describe(docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"), "left_semi"))
    labelled = keep(described.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("x", "y", "w", (F.col("fold") == 1).alias("calibrate")), "labelled")
    model = fit(labelled)
    release(marks, labelled)
    return model


def _fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(1))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text), by ``train``.

    Only statistics of the text enter a score. Null labels and labels of unknown documents count for
    nothing, of repeated ones each counts; null and empty texts get the score that their statistics
    have; a null id is never held out; other columns are not read, whatever their names; repeated
    rows are scored each; an empty table gives an empty one.
    """
    model = train(docs, labels)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = model.score(np.array([statistics(t) for t in p["text"]])) if len(p) else np.zeros(0)
            yield pd.DataFrame({"doc_id": p["doc_id"], "held_out": p["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_fold(F.col("doc_id")) == 0).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns: each row is judged by its own
    text, whatever ids repeat or are null, in the pass that reads it."""
    model = train(docs, labels)
    text = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (whole.slice(a, 512) for whole in parts for a in range(0, whole.num_rows, 512)):
            if p.num_rows:
                yield p.filter(pa.array(model.score(np.array([statistics(t) for t in p.column(text).to_pylist()])) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
