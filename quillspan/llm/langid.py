"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is its counts of byte n-grams (1 to ``longest``) of the lower-cased text with every run of non-letters as one
space, hashed to ``size`` features: sqrt(count) * idf, scaled to length 1.  idf counts *all* training texts.  Each language's
vectors, of about ``sample`` different training texts a language (those with the least hashes; a documented bound), of one at
least, are clustered by spherical k-means into ``centroids`` centroids.  A text gets the language of the centroid with the greatest
cosine; the cosine is the score.  A text farther than its centroid's own reach (the ``reach`` quantile of the cosines of the
centroid's own training vectors, less ``slack``) is marked ``rejected``; ``language`` with reject=True then says ``und``.

Very long texts are read whole, their n-grams are counted in pieces.  Nulls: a null text, or one without a letter (Unicode
class L), is ``und`` with score 0.  Texts with a null language are not learned from.  Repeated rows count as often as they come
in idf and once in the clusters.  More than ``most_languages`` languages are an error, for one row of each comes to the
driver.  No training rows: all are ``und``.  Ties go to the first language in alphabetical order.  Other columns, of any names,
are kept or ignored.  Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import text_bytes

_PIECE = 1 << 20
_KEYS = 1 << 30
RESULT = "language string, score double, rejected boolean"


def features(texts: pa.Array, size: int, longest: int) -> np.ndarray:
    """texts x size counts (float32) of hashed n-grams; texts are lower-case already."""
    data, offsets = text_bytes(texts)
    out = np.zeros((len(texts), size), np.float32)
    bits = np.uint32(32 - (size - 1).bit_length())
    plain = np.arange(256, dtype=np.uint8)
    plain[[b for b in range(128) if not chr(b).isalpha()]] = 32
    for row in range(len(texts)):
        text = plain[data[int(offsets[row]) : int(offsets[row + 1])]]
        if len(text) > 1:
            text = text[np.append(True, (text[1:] != 32) | (text[:-1] != 32))]
        for low in range(0, len(text), _PIECE):  # n-grams that start in the piece
            starts = min(_PIECE, len(text) - low)
            piece = text[low : low + starts + longest - 1]
            code = np.zeros(len(piece), np.uint32)
            for n in range(1, longest + 1):
                if len(piece) < n:
                    break
                code = code[: len(piece) - n + 1] * np.uint32(256) + piece[n - 1 :] + np.uint32(1)
                mixed = code[:starts]
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 % 2**32)
                out[row] += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> bits, minlength=size)[:size]
    return out


def _vectors(texts: pa.Array, idf: np.ndarray, longest: int) -> np.ndarray:
    v = np.sqrt(features(texts, len(idf), longest)) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and each vector's centroid.  Starts: farthest vectors, from the mean on."""
    k = min(k, len(v))
    centre = v.mean(0)
    picks = [int(np.argmax(v @ centre))]
    near = v @ v[picks[0]]
    while len(picks) < k:
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[picks[-1]])
    centroids = v[picks].copy()
    own = np.zeros(len(v), int)
    for _ in range(rounds):
        new = np.argmax(v @ centroids.T, axis=1)
        for c in range(k):
            if (new == c).any():
                m = v[new == c].mean(0)
                centroids[c] = m / (np.linalg.norm(m) or 1)
        if np.array_equal(new, own):
            break
        own = new
    return centroids, own


class Model:
    """Centroids by language, in alphabetical order of the languages."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, reach: np.ndarray, longest: int):
        self.idf, self.languages, self.centroids, self.reach, self.longest = idf, languages, centroids, reach, longest

    def predict(self, docs: DataFrame, keep: list[Column], reject: bool = False) -> DataFrame:
        """The kept columns with language, score, rejected for each row of docs(text)."""
        kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
        sent, n = docs.sparkSession.sparkContext.broadcast(self), len(keep)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    part = batch.slice(low, 256)
                    texts = part.column(n).to_pylist()
                    letter = np.array([any(map(str.isalpha, t or "")) for t in texts])
                    cosine = np.zeros((len(texts), 0))
                    if len(model.languages):
                        cosine = _vectors(pa.array([(t or "").lower() for t in texts], pa.large_string()), model.idf, model.longest) @ model.centroids.T
                    best = np.argmax(cosine, axis=1) if cosine.shape[1] else np.zeros(len(texts), int)
                    score = np.clip(cosine[np.arange(len(texts)), best], 0, 1) if cosine.shape[1] else np.zeros(len(texts))
                    known = letter & bool(cosine.shape[1])
                    far = ~known | (score < (model.reach[best] if cosine.shape[1] else 1))
                    named = known & ~far if reject else known
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([model.languages[b] if k else "und" for b, k in zip(best, named, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0).astype(float)), pa.array(far)], [*part.schema.names[:n], "language", "score", "rejected"])

        head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:n])
        return kept.mapInArrow(work, f"{head}, {RESULT}")


def train(docs: DataFrame, size: int = 8192, longest: int = 3, centroids: int = 4, sample: int = 1500, reach: float = 0.01, slack: float = 0.05, most_languages: int = 10_000) -> Model:
    """Learn from docs(text, lang): counts of all rows, centroids of about ``sample`` rows a language."""
    spark = docs.sparkSession
    rows = docs.select(F.lower(F.col("text").cast("string")).alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                seen += (features(part.column(0), size, longest) > 0).sum(0)
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.append(n, seen))], ["feature", "n"])

    counts = rows.select("text").mapInArrow(document_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # size + 1 rows
    seen = np.zeros(size + 1)
    for r in counts:
        seen[r.feature + 1] = r.n
    idf = np.log1p(seen[0] / (1 + seen[1:])).astype(np.float32)
    key = F.xxhash64("text").bitwiseAND(_KEYS - 1)
    keyed = rows.withColumn("key", key)
    by = keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.min("key").alias("least")).limit(most_languages + 1).collect()
    if len(by) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not by:
        return Model(idf, [], np.zeros((0, size), np.float32), np.zeros(0), longest)
    limits = spark.createDataFrame([(r.lang, max(r.least, int(_KEYS * min(1.0, sample / r.n)))) for r in by], "lang string, most long")

    def fit(lang: tuple, table: pa.Table) -> pa.Table:
        v = _vectors(table.column("text").combine_chunks(), idf, longest)
        centre, own = _cluster(v, centroids)
        cosine = (v * centre[own]).sum(1)
        least = [float(np.quantile(cosine[own == c], reach)) - slack if (own == c).any() else 1.0 for c in range(len(centre))]
        return pa.table({"lang": pa.array([lang[0].as_py()] * len(centre), pa.string()), "reach": least, "centroid": pa.array(list(centre), pa.list_(pa.float32()))})

    chosen = keyed.join(F.broadcast(limits), "lang").filter("key <= most").select("lang", "text").dropDuplicates(["lang", "text"])
    found = chosen.groupBy("lang").applyInArrow(fit, "lang string, reach double, centroid array<float>").collect()  # centroids x languages
    found = sorted(found, key=lambda r: r.lang)
    return Model(idf, [r.lang for r in found], np.array([r.centroid for r in found], np.float32), np.array([r.reach for r in found]), longest)
