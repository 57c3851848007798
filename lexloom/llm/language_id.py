"""Operator 3: language ID by nearest centroid of normalised TF-IDF n-gram vectors.

Features: letters lower-cased, runs of anything else one gap; 1- to 3-grams of characters
hashed to DIMENSIONS counts of the whole text; log(1 + count) x IDF, length 1. Each language
has up to CENTROIDS centroids (spherical k-means, farthest-first start, so the fit is
deterministic). A text gets the language of the centroid of highest cosine (ties: the first
in order of language) and that cosine as its score; if the cosine is below what all but
REJECT_SHARE of the centroid's training texts reach, less MARGIN, ``rejected`` is true.

The fit uses a bounded sample: SAMPLE_PER_LANG documents a language (fewer with very many
languages: SAMPLE_TOTAL in all, the most frequent that many), those of the smallest 63-bit
hash of id and text among the labelled ones that are not held out; of equal hashes one. What
reaches the driver is about 1.3 times that at any size of the table. IDF belongs to the fit. Prediction runs over every whole text.

Null texts and texts without a letter are ``und`` with score 0, not rejected. With nothing
to learn from, every text is ``und``. A null id is not held out. Repeated rows are judged
one by one; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import text_batches

DIMENSIONS = 8192
CENTROIDS = 4
SAMPLE_PER_LANG = 300
SAMPLE_TOTAL = 20_000
REJECT_SHARE = 0.005
MARGIN = 0.05
UNKNOWN = "und"
SCHEMA = "held_out boolean, lang_pred string, score double, rejected boolean"
_HASH = 1 << 63


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return table


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap behind each run of letters
    code = np.concatenate([[0], code[keep], [0]]).astype(np.uint32)
    shift = np.uint32(32 - 13)
    one = code * np.uint32(0x9E3779B1)
    two = one[:-1] + code[1:] * np.uint32(0x85EBCA6B) + np.uint32(1)
    three = two[:-1] * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F)
    counts = np.zeros(DIMENSIONS, np.int64)
    for part in (one[code > 0], two, three):
        part = part ^ part >> np.uint32(15)
        counts += np.bincount((part * np.uint32(0x2C1B3C6D)) >> shift, minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        found = np.log1p(counts, dtype=np.float32) * self.idf
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
        if not self.langs:
            return out
        held, places = [], []
        for place, text in [*enumerate(texts), (None, None)]:
            if place is None or len(held) == 256:
                if held:
                    cosine = self.vectors(np.stack(held)) @ self.centroids.T
                    best = cosine.argmax(axis=1)
                    for p, row, b in zip(places, cosine, best):
                        out[p] = self.langs[b], float(min(1, max(0, row[b]))), bool(row[b] < self.floors[b])
                held, places = [], []
            if place is not None and (counts := ngram_counts(text)) is not None:
                held.append(counts)
                places.append(place)
        return out


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    centres = [rows.mean(axis=0)]
    start = [int((rows @ centres[0]).argmax())]
    while len(start) < min(k, len(rows)):
        start.append(int((rows @ rows[start].T).max(axis=1).argmin()))
    centres = rows[start]
    for _ in range(10):
        of = (rows @ centres.T).argmax(axis=1)
        centres = np.stack([rows[of == c].sum(axis=0) for c in range(len(centres)) if (of == c).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(samples: list[tuple[str, np.ndarray]]) -> Model:
    """samples: (language, counts)."""
    model = Model(np.ones(DIMENSIONS, np.float32), [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    if not samples:
        return model
    counts = np.stack([c for _, c in samples])
    model.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    vectors = model.vectors(counts)
    found, floors = [], []
    names = np.array([lang for lang, _ in samples])
    for lang in sorted(set(names.tolist())):
        rows = vectors[names == lang]
        centres = _cluster(rows, CENTROIDS)
        cosine = rows @ centres.T
        of = cosine.argmax(axis=1)
        for c in range(len(centres)):
            own = cosine[of == c, c]
            floors.append(float(np.quantile(own, REJECT_SHARE)) - MARGIN if len(own) else 0.0)
            model.langs.append(lang)
        found.append(centres)
    model.centroids, model.floors = np.concatenate(found), np.array(floors)
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def hash_limit(each: int, count: int) -> int:
    """The largest hash that about 1.3 * ``each`` (and a few more) of ``count`` distinct hashes reach."""
    return min(_HASH - 1, _HASH * (13 * each + 100) // (10 * max(1, count)))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, np.ndarray]]:
    """(language, counts) of the bounded sample; ids and texts stay on the executors."""
    labelled = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(
        ~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    labelled = labelled.withColumn("place", F.shiftrightunsigned(F.xxhash64("key", "text"), 1))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("place").alias("count")).orderBy(F.desc("count"), "lang").limit(SAMPLE_TOTAL).collect()
    if not sizes:
        return []
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE_TOTAL // len(sizes)))
    limits = docs.sparkSession.createDataFrame([(r["lang"], hash_limit(each, r["count"])) for r in sizes], "lang string, most long")
    # At most SAMPLE_TOTAL rows, so the broadcast is bounded.
    picked = labelled.join(F.broadcast(limits), "lang").filter(F.col("place") <= F.col("most"))

    def run(batches):
        for batch in batches:
            rows = []
            for place, text, lang in zip(batch["place"].to_pylist(), batch["text"].to_pylist(), batch["lang"].to_pylist()):
                if (counts := ngram_counts(text)) is not None:
                    at = np.flatnonzero(counts)
                    rows.append((place, lang, at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes()))
            columns = [list(c) for c in zip(*rows)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["place", "lang", "counts"])

    out: list[tuple[str, np.ndarray]] = []
    taken: dict[str, int] = {}
    counted = picked.select("place", "text", "lang").mapInArrow(run, "place long, lang string, counts binary")
    for _, lang, data in sorted(counted.dropDuplicates(["lang", "place"]).collect()):
        if taken.get(lang, 0) == each:
            continue
        taken[lang] = taken.get(lang, 0) + 1
        n = len(data) // 6
        counts = np.zeros(DIMENSIONS, np.int64)
        counts[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<u4", n, 2 * n)
        out.append((lang, counts))
    return out


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and the columns of SCHEMA."""

    def run(batches):
        for batch in batches:
            out = batch["held"].to_pylist()
            at = 0
            for keys, texts in text_batches(iter([batch]), "key", "text"):
                lang, score, rejected = (list(c) for c in zip(*model.predict(texts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(out[at : at + len(keys)], pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[id_col, "held_out", "lang_pred", "score", "rejected"],
                )
                at += len(keys)

    picked = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held"))
    return picked.mapInArrow(run, f"`{id_col}` long, {SCHEMA}")


def learn_and_predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return language_id(docs, fit(training_sample(docs, id_col, text_col, lang_col)), id_col, text_col)
