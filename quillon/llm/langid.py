"""Language identification: multinomial logistic regression on TF-IDF character n-grams, FTRL-proximal, calibrated.

Rows with a null language are not learned from; every other language is. A null text, or one without a letter, is `und` with score 0. Repeated rows count as
often as they occur. With no labelled row at all every text is `und`. Equal probabilities go to the language that
is first by name. Texts are read SLAB code points at a time, each lower-cased by itself, so that very long ones take
no more memory. The temperature comes from cross-validation, and with one fitted row it is 1. Columns
other than the named ones are dropped by predict() except those asked for, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.llm.shared import id_remainder, map_batches, unused

#: Hashed n-gram buckets, n-gram lengths 1 to 3.
DIMS = 1 << 15
#: Most labelled rows that the classifier is fitted on; document frequencies cover all labelled rows.
FIT_ROWS = 8000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.02, 0.02
#: Parts of the cross-validation that calibrates.
FOLDS = 2
SLAB = 1 << 20


def _letters() -> np.ndarray:
    """Of each code point: itself if a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(known, points, 0).astype(np.uint32)


_table: np.ndarray | None = None


def features(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Counts of hashed n-grams of letters, a run of other characters being one blank; None without a letter."""
    global _table
    if _table is None:
        _table = _letters()
    counts = np.zeros(dims, np.int64)
    shift = np.uint32(32 - (dims.bit_length() - 1))

    def count(c: np.ndarray, full: int) -> None:
        """Count the n-grams that begin at the first `full` of these letters and blanks."""
        one = c * np.uint32(2654435761)
        two = (one[:-1] + c[1:] + np.uint32(0x9E37)) * np.uint32(2246822519)
        three = (two[:-1] + c[2:] + np.uint32(0x79B9)) * np.uint32(3266489917)
        counts[:] += np.bincount(np.concatenate((one[:full], two[:full], three[:full])) >> shift, minlength=dims)

    # what is left to count begins with a blank, and gets a blank at the end
    left, lettered = np.zeros(1, np.uint32), False
    for at in range(0, len(text or ""), SLAB):
        code = np.concatenate((left, _table[np.frombuffer(text[at : at + SLAB].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]))
        blank = code == 0
        code = code[~(blank & np.concatenate(([False], blank[:-1])))]
        lettered = lettered or bool(code.any())
        if len(code) > 2:
            count(code, len(code) - 2)
        left = code[-2:]
    if not lettered:
        return None
    left = left if left[-1] == 0 else np.append(left, np.uint32(0))
    for k in range(len(left)):
        tail = left[k:]
        count(np.concatenate((tail, np.zeros(3 - len(tail), np.uint32))), 1) if len(tail) >= 3 else _count_short(counts, tail, shift, dims)
    return counts


def _count_short(counts: np.ndarray, tail: np.ndarray, shift: np.uint32, dims: int) -> None:
    """The one-gram and, of two, the two-gram at the end of a text."""
    one = tail * np.uint32(2654435761)
    grams = np.concatenate((one[:1], (one[:-1] + tail[1:] + np.uint32(0x9E37)) * np.uint32(2246822519)))
    counts += np.bincount(grams >> shift, minlength=dims)


@dataclass
class Model:
    """Weights by bucket and language; probabilities are softmax(logits / temperature)."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = scaled(counts, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = features(text, len(self.idf)) if self.langs else None
        if counts is None:
            return "und", 0.0
        p = _softmax(self.logits(counts) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def scaled(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present and their TF-IDF weights, of unit length."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after EPOCHS passes of FTRL-proximal with L1 and L2 penalties; biases are not penalised."""
    z, n = np.zeros((dims + 1, n_langs)), np.zeros((dims + 1, n_langs))
    free = np.array([dims])

    def weights(at: np.ndarray) -> np.ndarray:
        zi, l1 = z[at], np.where(at == dims, 0.0, L1)[:, None]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(at == dims, 0.0, L2)[:, None]), 0.0)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = np.concatenate((at, free)), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            n_old = n[at]
            n_new = n_old + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n_old)) / ALPHA * w
            n[at] = n_new
    w = weights(np.arange(dims + 1))
    return w[:dims].astype(np.float32), w[dims].astype(np.float32)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden-section search over its logarithm.

    As in Platt's method the targets are smoothed to (n + 1) / (n + k), so that separable rows don't drive it to 0.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), y] = (n + 1) / (n + k)
    loss = lambda s: -(target * np.log(np.maximum(_softmax(logits / np.exp(s)), 1e-300))).sum(axis=1).mean()
    low, high, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_calibrated(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, dims: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and biases of all rows, and the temperature of models of the other folds, by which each row is judged."""
    model, aside, logits = fit_ftrl(rows, n_langs, dims), [], []
    for k in range(min(FOLDS, len(rows)) if len(rows) > 1 else 0):
        weights, bias = fit_ftrl([r for i, r in enumerate(rows) if i % FOLDS != k], n_langs, dims)
        logits += [x @ weights[at] + bias for at, x, _ in rows[k::FOLDS]]
        aside += rows[k::FOLDS]
    return *model, best_temperature(np.array(logits), np.array([y for _, _, y in aside])) if aside else 1.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, dims: int = DIMS) -> Model:
    """Learn from the rows of docs with a language.

    Document frequencies are summed over all of them, at most dims numbers from each task. The fitted rows are
    drawn by a hash of their id, an even share for each language, fit_rows at most, and ordered by that hash over the
    language's odds, so that languages alternate in proportion; their sparse counts go to the one task that fits.
    The driver gets the model: dims x languages numbers. The task that fits holds 20 bytes for each of these; the
    number of languages is that of distinct names, which dims can be set against.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    per_lang = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language, as the model has
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.zeros((dims, 0), np.float32), np.zeros(0, np.float32), np.ones(dims))
    share = fit_rows / len(langs)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(dims, np.int64)
        for b in batches:
            for t in b.column(0):
                if (c := features(t.as_py(), dims)) is not None:
                    total += 1
                    df += c > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], total), pa.int64())], ["bucket", "n"])

    seen = map_batches(labelled.select("text"), frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = max(1, int(seen.loc[seen.bucket == -1, "n"].sum()))
    seen = seen[seen.bucket >= 0]
    df = np.zeros(dims)
    df[seen.bucket.to_numpy()] = seen.n.to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1

    ticket = F.pmod(F.xxhash64(F.lit(7), F.col("id").cast("string")), F.lit(1 << 30)).alias("ticket")
    odds = docs.sparkSession.createDataFrame([(lang, min(1.0, share / n)) for lang, n in per_lang.items()], "lang string, odds double")
    drawn = labelled.join(F.broadcast(odds), "lang").select("text", "lang", ticket, "odds").filter(F.col("ticket") < F.col("odds") * (1 << 30))
    drawn = drawn.select("text", "lang", F.floor(F.col("ticket") / F.col("odds")).alias("ticket"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [features(t.as_py(), dims) for t in b.column(0)]
            at = [None if c is None else np.flatnonzero(c).astype(np.int32) for c in counts]
            of = [None if c is None else c[a].astype(np.int32) for c, a in zip(counts, at)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(of, pa.list_(pa.int32()))], ["lang", "ticket", "at", "counts"])

    drawn = map_batches(drawn, sparse, "lang string, ticket long, at array<int>, counts array<int>").filter("at is not null").orderBy("ticket", "lang", F.xxhash64("at", "counts")).limit(fit_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        rows, number = [], {lang: i for i, lang in enumerate(langs)}
        for b in batches:
            for lang, at, counts in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                at = at.values.to_numpy()
                x = np.log1p(counts.values.to_numpy()) * idf[at]
                rows.append((at.astype(np.int64), x / max(np.sqrt(x @ x), 1e-12), number[lang]))
        if not rows:
            return
        weights, bias, temperature = fit_calibrated(rows, len(langs), dims)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (weights, bias)] + [pa.array([temperature])]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "bias", "temperature"])

    model = drawn.coalesce(1).mapInArrow(fit, "weights binary, bias binary, temperature double").first()
    if model is None:
        return Model([], np.zeros((dims, 0), np.float32), np.zeros(0, np.float32), idf)
    weights = np.frombuffer(bytes(model.weights), np.float32).reshape(dims, len(langs))
    return Model(langs, weights, np.frombuffer(bytes(model.bias), np.float32), idf, model.temperature)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, then language and score under the given names. The model, a weight for each bucket and language, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column(0)]
            columns = b.columns[1:] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    schema = StructType([*fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return map_batches(docs.select(F.col(text_col).alias(unused("__text", list(keep))), *[F.col(f"`{c}`") for c in keep]), run, schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Predictions for all rows of docs by a model learned from those whose id's crc32 modulo 5 is not 0."""
    return predict(docs, train(docs.filter(id_remainder("doc_id", 5) != 0)), keep=keep, names=names)


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is predicted with a calibrated score of at least `least`, with their own columns."""
    lang, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    found = identify(docs, keep=tuple(docs.columns), names=(lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
