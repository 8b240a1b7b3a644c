"""Language identification with string kernels.

Two texts are compared by the blended spectrum of their byte n-grams of one to four bytes: the kernel is the number of
n-grams present in both, over the root of the product of the two numbers (presence, not frequency; n-grams fall into
65,536 hashed places). The kernel matrix is approximated by Nyström landmarks, and one-versus-rest kernel ridge
regression on them gives a weight for each landmark and language. A text is scored by two batched matrix products:
its n-grams with the landmarks' n-grams, and the kernel values with the weights.

Texts that are null or have no letter are `und` with score 0. Any number of languages is learned from rows with a
language; without any such row all texts are `und`. Ties go to the alphabetically first language. Rows are judged one
by one, so repeated rows repeat their result (and are learned from once); extra columns are ignored, and columns named
lang_pred or score are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _UPPER_TO_LOWER, SLICE_BYTES, remainder, row_slices, small_batches, text_bytes

PLACES = 1 << 16
#: Bounds of what is learned from: labelled rows for each language, and landmarks among them; and of all languages
#: together, but for one landmark and eight rows that each language has at least.
ROWS_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 400, 32
ALL_ROWS, ALL_LANDMARKS = 8_000, 512
#: Rows of one matrix product.
BATCH = 128
RIDGE = 1e-3
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the n-grams present in each row, one row after the other, and how many each row has."""
    found, sizes, mark = [], np.zeros(len(offsets) - 1, np.int64), np.zeros(PLACES, bool)
    for i in range(len(offsets) - 1):
        row = data[offsets[i] : offsets[i + 1]]
        for at in range(0, max(1, len(row) - 3), 1 << 20):
            part = _UPPER_TO_LOWER[row[at : at + (1 << 20) + 3]].astype(np.uint32)
            code = np.zeros(len(part), np.uint32)
            for n in range(4):
                if n >= len(part):
                    break
                code = (code[: len(part) - n] if n else code) * np.uint32(257) + part[n:] + np.uint32(1)
                mark[(code * _FACTORS[n]) >> np.uint32(16)] = True
        own = np.flatnonzero(mark)
        mark[own] = False
        found.append(own)
        sizes[i] = len(own)
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), sizes


class KernelModel:
    """Landmarks' presence matrix (place by landmark), their sizes, and a weight for each landmark and language."""

    def __init__(self, languages: list[str], grams: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        self.languages, self.grams, self.sizes, self.weights = languages, grams, sizes, weights

    def kernel(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The rows' kernel values with the landmarks: a product of two presence matrices for each batch of rows."""
        out = np.zeros((len(sizes), self.grams.shape[1]), np.float32)
        ends, index = np.cumsum(sizes), np.zeros(PLACES, np.int64)
        for lo in range(0, len(sizes), BATCH):
            hi = min(len(sizes), lo + BATCH)
            held = places[ends[lo] - sizes[lo] : ends[hi - 1]]
            index[:] = 0
            index[held] = 1
            own = np.flatnonzero(index)
            index[own] = np.arange(len(own))
            batch = np.zeros((hi - lo, len(own)), np.float32)
            batch[np.repeat(np.arange(hi - lo), sizes[lo:hi]), index[held]] = 1
            out[lo:hi] = batch @ self.grams[own].astype(np.float32)
        return out / np.sqrt(np.maximum(sizes, 1)[:, None] * self.sizes[None, :])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernel(*present(data, offsets)) @ self.weights


def trained(rows: list[np.ndarray], languages: list[str]) -> KernelModel:
    """The model of labelled rows, each given by its places."""
    known = sorted(set(languages))
    sizes = np.array([len(x) for x in rows], np.int64)
    marks: list[int] = []
    for language in known:
        marks += [i for i, x in enumerate(languages) if x == language][: max(1, min(LANDMARKS_PER_LANGUAGE, ALL_LANDMARKS // len(known)))]
    grams = np.zeros((PLACES, len(marks)), np.uint8)
    for j, i in enumerate(marks):
        grams[rows[i], j] = 1
    model = KernelModel(known, grams, np.maximum(sizes[marks], 1), np.zeros((len(marks), len(known)), np.float32))
    cross = model.kernel(np.concatenate(rows), sizes).astype(float)
    values, vectors = np.linalg.eigh(cross[marks])
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = cross @ root
    goal = np.where(np.array(languages)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    balance = np.array([1.0 / languages.count(x) for x in languages])[:, None] * len(languages) / max(1, len(known))
    inner = features.T @ (features * balance) + RIDGE * len(languages) * np.eye(features.shape[1])
    model.weights = (root @ np.linalg.solve(inner, features.T @ (goal * balance))).astype(np.float32)
    return model


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        places, sizes = present(data, offsets)
        ends = np.cumsum(sizes)
        held = [places[e - n : e].astype(np.uint16).tobytes() for n, e in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], names=["lang", "h", "places"])


def sample(documents: DataFrame, folds: int = 5) -> list[tuple[str, np.ndarray]]:
    """(lang, places): for each language the labelled training rows with the smallest hashes, up to the bound.

    One pass counts the hashes' leading zeros for each language; a second takes the rows with enough of them. What
    reaches the driver of a row is the places of its n-grams, at most 128 KB however long its text is.
    """
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", folds) != 0))
    hashed = rows.select("lang", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), "text")
    zeros = (F.lit(63) - F.length(F.bin("h"))).alias("zeros")
    counted = hashed.select("lang", zeros, "h").groupBy("lang", "zeros").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    sizes: dict[str, dict[int, int]] = {}
    for r in counted:
        sizes.setdefault(r["lang"], {})[r["zeros"]] = r["n"]
    if not sizes:
        return []
    wanted, bounds = max(8, min(ROWS_PER_LANGUAGE, ALL_ROWS // len(sizes))), []
    for language, own in sizes.items():
        held, least = 0, 0
        for level in sorted(own, reverse=True):
            held += own[level]
            if held >= 1.2 * wanted:
                least = level
                break
        bounds.append((language, (1 << (63 - least)) - 1))
    most = documents.sparkSession.createDataFrame(bounds, "lang string, most long")  # a row for each language
    near = hashed.join(F.broadcast(most), "lang").where("h <= most").groupBy("lang", "h").agg(F.first("text").alias("text"))
    # The exact bound among these, so that no places but the sample's own reach the driver.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= wanted).select("lang", "h", "text")
    got = picked.mapInArrow(_presence, "lang string, h long, places binary").collect()
    return [(r["lang"], np.frombuffer(r["places"], np.uint16).astype(np.int64)) for r in sorted(got, key=lambda r: (r["lang"], r["h"]))]


def with_language(documents: DataFrame, folds: int = 5) -> DataFrame:
    """documents(doc_id, text, lang, ...) with lang_pred and score; score is between 0 and 1."""
    documents = documents.drop("lang_pred", "score")
    small_batches(documents.sparkSession)
    learned = sample(documents, folds)
    model = trained([x for _, x in learned], [x for x, _ in learned]) if learned else None

    @F.arrow_udf("lang_pred string, score double")
    def judge(column: pa.Array) -> pa.Array:
        named, sure = np.full(len(column), "und", object), np.zeros(len(column))
        data, offsets = text_bytes(column)
        for lo, hi in row_slices(offsets, SLICE_BYTES // 4, 500) if model is not None else ():
            scores = model.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for i, text in enumerate(column.slice(lo, hi - lo)):
                text = text.as_py()
                if text and any(c.isalpha() for c in text):
                    k = int(scores[i].argmax())
                    named[lo + i], sure[lo + i] = model.languages[k], 1 / (1 + np.exp(-4 * float(scores[i, k])))
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(sure)], ["lang_pred", "score"])

    judged = documents.withColumn("_judged", judge(F.col("text")))
    return judged.select(*documents.columns, "_judged.lang_pred", "_judged.score")


def identify(documents: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents(doc_id, text, lang)."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return with_language(documents, folds).select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
