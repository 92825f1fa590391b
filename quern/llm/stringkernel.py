"""Language identification by string kernels.

Kernel: blended spectrum of presence. A text is the set of its character n-grams for n = 1 to 3 (letters in lower
case, everything else one blank), each hashed to one of ``SLOTS`` slots; k(x, y) is the number of slots that both
have, divided by the geometric mean of their numbers. Landmarks are a part of the training texts; the Nyström map
sends x to K(x, landmarks) K(landmarks, landmarks)^(-1/2), and one-versus-rest ridge regression with targets +1 and
-1 is solved there. Since the kernel is linear in presence, landmarks and weights are folded into one matrix of
slots by languages, and whole batches are scored by one product of their presence matrix with it.

Training reads a bounded sample (``PER_LANG`` texts a language, ``MAX_LANGS`` languages; more are an
error), those with the smallest hashes of their text; what reaches the driver is their presence bitmaps of SLOTS / 8 bytes each.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import besides, documents, materialise

SLOTS = 1 << 15
PER_LANG, LANDMARKS_PER_LANG, MAX_LANGS = 240, 48, 64
PARTS = 16
#: Rows of the presence matrix that the driver unpacks at once: 8 MB of float32.
BLOCK = 64
RIDGE = 1.0
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 32 for what isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def slots_of(text: str) -> np.ndarray:
    """Distinct slots of the n-grams of a whole text; empty without letters."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (codes != 32).any():
        return np.empty(0, np.int64)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    seen = np.zeros(SLOTS, bool)
    mixed = np.zeros(len(codes), np.uint32)
    for n, mult in enumerate(_MULT, 1):
        # mixed[i] is a hash of codes[i - n + 1 .. i]
        mixed[n - 1 :] = (mixed[n - 1 :] if n == 1 else mixed[n - 2 : -1]) * np.uint32(31) + codes[n - 1 :] * np.uint32(mult)
        grams = mixed[n - 1 :]
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x3D4D51CB % 2**32)
        seen[grams >> np.uint32(32 - SLOTS.bit_length() + 1)] = True
    return np.flatnonzero(seen)


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows by SLOTS presence matrix, number of slots of each row); rows without letters are zero."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            row[slots_of(text)] = 1
    return out, out.sum(1)


def fit(bits: np.ndarray, langs: list[str], landmarks: int, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Kernel ridge regression on Nyström features: (languages, weights of slots by languages).

    ``bits``: presence matrix of the training texts; each language's first ``landmarks`` rows are landmarks.
    """
    return fit_packed(np.packbits(bits.astype(bool), axis=1), bits.shape[1], langs, landmarks, ridge)


def fit_packed(packed: np.ndarray, slots: int, langs: list[str], landmarks: int, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """``fit`` on bitmaps of ``slots`` bits a row. ``BLOCK`` rows are unpacked at once, so the driver never holds a presence matrix."""
    names = sorted(set(langs))
    marks = np.concatenate([[i for i, x in enumerate(langs) if x == name][:landmarks] for name in names]).astype(int)
    target = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    blocks = lambda n: [slice(at, at + BLOCK) for at in range(0, n, BLOCK)]
    unpack = lambda rows: np.unpackbits(rows, axis=1, count=slots).astype(np.float32)
    few = packed[marks]
    norms = np.sqrt(np.maximum(np.bitwise_count(few).sum(1, dtype=np.int64), 1))

    def kernel(rows: np.ndarray) -> np.ndarray:
        """Of these rows with all landmarks; the slots that two have in common are counted exactly."""
        size, rows = np.bitwise_count(rows).sum(1, dtype=np.int64), unpack(rows)
        common = np.concatenate([rows @ unpack(few[at]).T for at in blocks(len(few))], 1)
        return common / np.sqrt(np.maximum(size, 1))[:, None] / norms

    values, vectors = np.linalg.eigh(np.concatenate([kernel(few[at]) for at in blocks(len(few))]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    gram, right = ridge * np.eye(root.shape[1] + 1), np.zeros((root.shape[1] + 1, len(names)))
    for at in blocks(len(packed)):
        features = kernel(packed[at]) @ root
        features = np.concatenate([features, np.ones((len(features), 1))], 1)
        gram += features.T @ features
        right += features.T @ target[at]
    dual = np.linalg.solve(gram, right)
    by_mark = root @ dual[:-1] / norms[:, None]
    weights = np.zeros((slots + 1, len(names)))
    weights[-1] = dual[-1]
    for at in blocks(len(few)):
        weights[:-1] += unpack(few[at]).T @ by_mark[at]
    return names, weights.astype(np.float32)


def _sample(labelled: DataFrame, per_lang: int) -> DataFrame:
    """Presence bitmaps of the texts with the smallest hashes, ``per_lang`` for each language."""
    hashed = labelled.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("part", F.spark_partition_id() % PARTS)
    # Each rank filter keeps at most per_lang rows a task and group before its shuffle; a language's last group has PARTS * per_lang rows
    # at most, however many tasks there are.
    ranked = hashed
    for by in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= per_lang).drop("r")
    bounds = materialise(ranked.groupBy("lang").agg(F.max("h").alias("most")), "languages")
    if (found := bounds.count()) > MAX_LANGS:
        raise ValueError(f"{found} languages are labelled, {MAX_LANGS} can be learned at most")
    chosen = labelled.withColumn("h", F.xxhash64("text")).join(F.broadcast(bounds), "lang").filter(F.col("h") <= F.col("most"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # as many as the sample has texts at most: a copy's bitmap is made once a task
        for batch in batches:
            names, hashes, out = batch["lang"].to_pylist(), batch["h"].to_pylist(), {}
            for k, pair in enumerate(zip(names, hashes, strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    out[pair] = np.packbits(presence([batch["text"][k].as_py()])[0][0].astype(bool)).tobytes()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([p[0] for p in out], pa.string()), "h": pa.array([p[1] for p in out], pa.int64()), "bits": pa.array(list(out.values()), pa.binary())})

    return chosen.select("lang", "h", "text").mapInArrow(bitmaps, "lang string, h long, bits binary").dropDuplicates(["lang", "h"])


def train(labelled: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Fit on (text, lang) rows; null texts and languages and texts without letters are left out."""
    rows = sorted(_sample(labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")), per_lang).collect(), key=lambda r: (r["lang"], r["h"]))
    if not rows:
        return [], np.zeros((SLOTS + 1, 0), np.float32)
    packed = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)
    return fit_packed(packed, SLOTS, [r["lang"] for r in rows], landmarks)


def predict(names: list[str], weights: np.ndarray, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
    """Language and score (0 to 1, 0.5 where the best regression says 0) of each text."""
    langs, scores = [], []
    for at in range(0, len(texts), batch):
        rows, size = presence(texts[at : at + batch])
        found = (rows @ weights[:-1]) / np.sqrt(np.maximum(size, 1))[:, None] + weights[-1]
        best = found.argmax(1) if len(names) else np.zeros(len(rows), int)
        for k, (b, n) in enumerate(zip(best, size, strict=True)):
            known = n > 0 and len(names) > 0
            langs.append(names[b] if known else "und")
            scores.append(float(np.clip((found[k, b] + 1) / 2, 0, 1)) if known else 0.0)
    return langs, scores


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with lang_pred and score for every row. `und` and 0 for null texts and those without letters.

    The text alone decides. Repeated rows get equal results; an empty input gives no rows; with no language
    learned all is `und`. Of equal regressions the first language by name is taken. Columns of ``keep`` named like an output are
    left out.
    """
    keep = besides(keep, "lang_pred", "score", "__text")
    shared = df.sparkSession.sparkContext.broadcast((json.dumps(model[0]), model[1]))
    chosen = df.select(*keep, F.col(text_col).alias("__text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weights = json.loads(shared.value[0]), shared.value[1]
        for frame in frames:
            texts = [x if isinstance(x, str) else None for x in frame.pop("__text")]
            frame["lang_pred"], frame["score"] = predict(names, weights, texts)
            yield frame

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    return chosen.mapInPandas(run, f"{kept}, lang_pred string, score double")


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned where crc32(doc_id) mod 4 isn't 2."""
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 4) == 2
    model = train(docs.filter(~held).select("text", "lang"))
    return identify(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), model, "text", ["doc_id", "held_out"])
