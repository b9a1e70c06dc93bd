"""Language identification (operator 1): multinomial naive Bayes over hashed character n-grams.

The counts of n-grams per language are added up by Spark; the log-probability
matrix (buckets x languages) is broadcast, its size fixed by ``BUCKETS`` and
``MAX_LANGUAGES``. A batch is scored by gathering the matrix rows of its
n-grams and summing them per text, the product with its sparse count matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.batches import chunks, flat_text, map_batches
from pulsegrid.llm.store import held_out, read_table

BUCKETS = 1 << 16
MAX_LANGUAGES = 500
#: Training documents per language, about; a language with fewer gives all. A bound of the fit only.
TRAIN_ROWS = 2000
UNKNOWN = "und"
_BLOCK = 1 << 17
_ORDERS = ((0x9E3779B1,), (0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0xB5297A4D))


class Grams:
    """Buckets of the letter 1- to 3-grams of lower-cased texts; runs of other characters count as one border."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes with two borders behind each text, starts of the texts, letters in each text)."""
        lowered = [t.lower() for t in texts]
        lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
        flat = np.frombuffer("".join(t + "  " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letter[np.minimum(flat, 0xFFFF)]
        for far in np.unique(flat[flat > 0xFFFF]):
            is_letter[flat == far] = chr(far).isalpha()
        codes = np.where(is_letter, flat, np.uint32(0))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[starts] = True
        keep[ends - 1] = keep[ends - 2] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(is_letter)])
        return codes[keep], place[starts], letters[ends] - letters[starts]

    def buckets(self, codes: np.ndarray, low: int, high: int):
        """Bucket arrays of the n-grams that start in codes[low:high], one per order."""
        n = high - low
        part = np.zeros(n + 2, np.uint32)
        have = codes[low : high + 2]
        part[: len(have)] = have
        for weights in _ORDERS:
            h = np.zeros(n, np.uint32)
            for j, w in enumerate(weights):
                h += part[j : j + n] * np.uint32(w)
                h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 16)

    def text_sums(self, texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the matrix rows of each text's n-grams, letters of each text)."""
        codes, starts, letters = self.codes(texts)
        sums = np.zeros((len(texts), matrix.shape[1]))
        for low in range(0, len(codes), _BLOCK):
            high = min(low + _BLOCK, len(codes))
            rows = np.zeros((high - low, matrix.shape[1]), np.float32)
            for h in self.buckets(codes, low, high):
                rows += matrix[h]
            first = int(np.searchsorted(starts, low, "right")) - 1
            last = int(np.searchsorted(starts, high, "left"))
            cuts = np.maximum(starts[first:last] - low, 0)
            sums[first:last] += np.add.reduceat(rows, cuts, axis=0, dtype=np.float64)
        return sums, letters


def fit(docs: DataFrame, text: str, label: str, key: str, rows_per_language: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix, log priors) from the rows with a label and a text.

    About ``rows_per_language`` rows of each language are read, chosen by a hash of
    ``key``; the priors come from all rows. Without any labelled row the
    list is empty and every text is ``und``.
    """
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    counted = {r["label"]: r["count"] for r in labelled.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counted)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    draw = F.crc32(F.concat(F.lit("lang:"), F.coalesce("key", F.lit(""))).cast("binary"))
    share = F.lit(0.0)
    for name, n in counted.items():
        share = F.when(F.col("label") == name, min(1.0, rows_per_language / n)).otherwise(share)
    sample = labelled.where(draw < share * 2.0**32).select("text", "label")
    index = {name: i for i, name in enumerate(languages)}

    def count(batches):
        grams, total = Grams(), np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            labels = np.fromiter((index[x] for x in batch.column("label").to_pylist()), np.int64, len(batch))
            for code in np.unique(labels):
                texts = batch.column("text").filter(pa.array(labels == code))
                _, offsets = flat_text(texts)
                for low, high in chunks(offsets):
                    codes, _, _ = grams.codes(texts.slice(low, high - low).to_pylist())
                    for at in range(0, len(codes), _BLOCK):
                        for h in grams.buckets(codes, at, min(at + _BLOCK, len(codes))):
                            total[code] += np.bincount(h, minlength=BUCKETS)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)), pa.array(total[where])], names=["code", "bucket", "n"]
        )

    table = sample.mapInArrow(count, "code int, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n"))
    found = table.toPandas()  # at most BUCKETS rows per language
    counts = np.full((BUCKETS, len(languages)), 0.5)
    counts[found["bucket"].to_numpy(int), found["code"].to_numpy(int)] += found["n"].to_numpy(float)
    matrix = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    priors = np.log(np.array([counted[x] for x in languages], float) / sum(counted.values()))
    return languages, matrix, priors


def predict(docs: DataFrame, text: str, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    A null text and a text without a letter is ``und`` with score 0. The score is
    the posterior of the chosen language with the evidence of a long text
    damped to that of about 40 n-grams. Ties go to the first language in text
    order. Columns of these names are replaced.
    """
    languages, matrix, priors = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix, priors))
    state: dict = {}

    def score(batch: pa.RecordBatch) -> dict:
        names, matrix, priors = shared.value
        grams = state.setdefault("grams", Grams()) if names else None
        column = batch.column(batch.schema.get_field_index(text))
        preds, scores = [], []
        _, offsets = flat_text(column)
        column = pc.fill_null(column, "")
        for low, high in chunks(offsets):
            texts = column.slice(low, high - low).to_pylist()
            if not names:
                preds += [UNKNOWN] * len(texts)
                scores += [0.0] * len(texts)
                continue
            sums, letters = grams.text_sums(texts, matrix)
            grams_of = np.maximum(3.0 * letters, 1)[:, None]
            best = np.argmax(sums + priors, axis=1)
            damped = sums * np.minimum(1.0, 40.0 / grams_of) + priors
            odds = np.exp(damped - damped.max(axis=1, keepdims=True))
            chosen = odds[np.arange(len(best)), best] / odds.sum(axis=1)
            preds += [names[b] if n else UNKNOWN for b, n in zip(best, letters)]
            scores += np.where(letters > 0, chosen, 0.0).tolist()
        return {"lang_pred": preds, "score": scores}

    return map_batches(docs, score, [("lang_pred", T.StringType()), ("score", T.DoubleType())])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    scored = predict(docs.select("doc_id", "text"), "text", model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
