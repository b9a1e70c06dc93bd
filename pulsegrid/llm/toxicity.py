"""Toxicity (operator 5): nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Terms are word stems: the first 3 to 8 bytes of each lower-cased word, hashed.
A bounded sample of labelled documents fixes the vocabulary (terms whose
document frequency differs between the classes) and the examples; document
frequencies for the IDF are counted over all documents. One more term, found in every text,
stands for all its words, so the cosine sees how dense the other terms are.

The examples lie in blocks; for each term a block keeps its largest weight. A
query sums these maxima to bounds, visits blocks from the highest bound down and
stops when no bound can reach its k-th best cosine, so the k nearest are exact.
Votes are weighted by distance and calibrated on leave-one-out votes of the examples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.batches import BYTE, U64, RangeHash, chunks, flat_text, map_batches, word_ranges
from pulsegrid.llm.store import held_out, read_table

STEMS = (3, 4, 5, 6, 7, 8)
TERM_BITS = 22
#: Examples per class, about, and terms of the vocabulary: bounds of the fit.
EXAMPLES = 1500
VOCABULARY = 1024
LEAST_Z = 5.0
K, BLOCK, ANY_WORD = 25, 64, 0.05


class Stems:
    """Term numbers of whole texts."""

    def __init__(self) -> None:
        self.hasher = RangeHash()

    def __call__(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term) of every stem of every word, and the words of each row."""
        data, at = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
        starts, ends = word_ranges(data, at)
        counts = np.diff(np.searchsorted(starts, at))
        row = np.repeat(np.arange(len(counts)), counts)
        folded = data.copy()  # upper-case letters of two bytes after 0xC3 become lower-case ones
        accents = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        folded[accents] += 0x20
        prefix = self.hasher.prefix(BYTE[folded])
        rows, terms = [], []
        for n in STEMS:
            long = ends - starts >= n
            rows.append(row[long])
            terms.append((self.hasher.ranges(prefix, starts[long], starts[long] + n) >> U64(64 - TERM_BITS)).astype(np.int64))
        return np.concatenate(rows), np.concatenate(terms), counts

    def counted(self, flat: np.ndarray, offsets: np.ndarray, index: np.ndarray | None = None):
        """(row, term, count) of the distinct pairs and the words of each row; with ``index`` terms map to it, -1 is left out."""
        rows, terms, words = self(flat, offsets)
        if index is not None:
            terms = index[terms]
            rows, terms = rows[terms >= 0], terms[terms >= 0]
        pairs, times = np.unique((rows << TERM_BITS) | terms, return_counts=True)
        return pairs >> TERM_BITS, pairs & ((1 << TERM_BITS) - 1), times, words


class Nearest:
    """The examples as a block-max inverted index."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> None:
        """``vectors`` are (terms, weights) of unit length; examples of similar weight profile should be neighbours."""
        self.n, self.block = len(vectors), block
        blocks = max(1, -(-self.n // block))
        self.maxima = np.zeros((n_terms, blocks))
        self.postings = []
        for b in range(blocks):
            part = vectors[b * block : (b + 1) * block]
            terms = np.concatenate([t for t, _ in part]) if part else np.zeros(0, np.int64)
            weights = np.concatenate([w for _, w in part]) if part else np.zeros(0)
            owner = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])
            order = np.argsort(terms, kind="stable")
            terms, weights, owner = terms[order], weights[order], owner[order]
            np.maximum.at(self.maxima[:, b], terms, weights)
            self.postings.append((np.searchsorted(terms, np.arange(n_terms + 1)), owner, weights, len(part)))

    def scores(self, b: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of the query with the examples of a block, term lists added up."""
        edges, owner, weight, size = self.postings[b]
        low, n = edges[terms], edges[terms + 1] - edges[terms]
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(owner[at], weights=weight[at] * np.repeat(weights, n), minlength=size)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, exactly; ties go to the lower example number."""
        bounds = weights @ self.maxima[terms]
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if len(found) >= k and bounds[b] < cosines[k - 1] - 1e-12:
                break
            own = self.scores(b, terms, weights)
            ids = b * self.block + np.arange(len(own))
            if without >= 0:
                keep = ids != without
                own, ids = own[keep], ids[keep]
            found, cosines = np.concatenate([found, ids]), np.concatenate([cosines, np.round(own, 12)])
            order = np.lexsort((found, -cosines))[:k]
            found, cosines = found[order], cosines[order]
        return found, cosines


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y on x: (break points, values)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, last x
    for value, target, weight in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        blocks.append([target, weight, value])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][2] == blocks[-1][2]):
            mean, weight, last = blocks.pop()
            total = blocks[-1][1] + weight
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + mean * weight) / total, total, last]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    """Vocabulary, IDF, examples and calibration."""

    def __init__(self, index, idf, vectors, labels, weights, keys) -> None:
        self.index, self.idf = index, idf  # term number -> place in the vocabulary or -1; IDF by place
        self.nearest = Nearest(vectors, len(idf) + 1)
        self.labels, self.weights, self.keys = labels, weights, keys
        self.breaks = self.values = np.zeros(0)
        votes = np.array([self.vote(*self.nearest.search(t, w, K, i)) for i, (t, w) in enumerate(vectors)])
        if len(vectors):
            self.breaks, self.values = _monotone(votes, labels.astype(float), weights)

    def vector(self, places: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector of a text with ``words`` words."""
        terms = np.append(places, len(self.idf))
        weights = np.append(counts * self.idf[places], max(words, 1) * ANY_WORD)
        return terms, weights / np.sqrt((weights**2).sum())

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each weighted by nearness and by the documents it stands for."""
        if not len(examples):
            return 0.0
        weight = self.weights[examples] / (np.sqrt(np.maximum(0, 2 - 2 * cosines)) + 0.02)
        return float((weight * self.labels[examples]).sum() / weight.sum())

    def calibrated(self, vote: float) -> float:
        if not len(self.breaks):
            return 0.0
        at = min(int(np.searchsorted(self.breaks, vote)), len(self.values) - 1)
        return float(min(1.0, max(0.0, 0.02 * vote + 0.98 * self.values[at])))


def _examples(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """(key, text, label) of about ``per_class`` labelled documents of each class, and the rows of each class.

    The rows are chosen by a hash of the key; only rows outside the held-out fold are seen.
    """
    rows = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    draw = F.crc32(F.concat(F.lit("example:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    share = F.when(F.col("label") == 1, min(1.0, per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_class / max(1, sizes.get(0, 0))))
    chosen = rows.where(draw < share * 2.0**32)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sizes


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int = EXAMPLES) -> tuple:
    """Parts of a :class:`Model`, learned from labels(doc_id, label 0/1) joined to docs(doc_id, text).

    The broadcast of the chosen labels has about 2 * ``per_class`` rows. Only term counts of the
    examples and vectors of ``VOCABULARY`` terms at most reach the driver. Without examples every score is 0.
    """
    examples, sizes = _examples(docs, labels, label, per_class)

    def term_counts(batches):
        stems = Stems()
        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            of = np.array(batch.column("label").to_pylist(), np.int64)
            for low, high in chunks(offsets):
                row, term, _, _ = stems.counted(flat, offsets[low : high + 1])
                toxic = of[low:high][row]
                terms, place = np.unique(term, return_inverse=True)
                columns = [pa.array(terms.astype(np.int32))] + [
                    pa.array(np.bincount(place, weights=toxic == c, minlength=len(terms)).astype(np.int64)) for c in (0, 1)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "df0", "df1"])

    n0, n1 = (max(1.0, min(per_class, sizes.get(c, 0))) for c in (0, 1))
    p0, p1 = F.col("df0") / n0, F.col("df1") / n1
    pooled = (F.col("df0") + F.col("df1")) / (n0 + n1)
    z = (p1 - p0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    terms = examples.mapInArrow(term_counts, "term int, df0 long, df1 long").groupBy("term").agg(F.sum("df0").alias("df0"), F.sum("df1").alias("df1"))
    terms = terms.withColumn("z", F.abs(z)).where((F.col("z") >= LEAST_Z) & (F.col("df0") + F.col("df1") >= 5))
    chosen = [r["term"] for r in terms.orderBy(F.desc("z"), "term").limit(VOCABULARY).collect()]
    index = np.full(1 << TERM_BITS, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    places = docs.sparkSession.sparkContext.broadcast(np.array(chosen, np.int64))

    def lookup() -> np.ndarray:
        table = np.full(1 << TERM_BITS, -1, np.int64)
        table[places.value] = np.arange(len(places.value))
        return table

    def frequencies(batches):
        stems, table, total = Stems(), lookup(), np.zeros(len(places.value) + 1, np.int64)
        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            for low, high in chunks(offsets):
                _, place, _, _ = stems.counted(flat, offsets[low : high + 1], table)
                total[:-1] += np.bincount(place, minlength=len(total) - 1)
                total[-1] += high - low
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "df"])

    df = np.zeros(len(chosen) + 1)
    for r in docs.select("text").mapInArrow(frequencies, "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():
        df[r["place"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches):
        stems, table = Stems(), lookup()
        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            for low, high in chunks(offsets):
                row, place, times, words = stems.counted(flat, offsets[low : high + 1], table)
                cuts = np.searchsorted(row, np.arange(high - low + 1))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("label"), pa.array(words, pa.int64()),
                        pa.array([place[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64())),
                        pa.array([times[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "label", "words", "places", "times"],
                )

    made = examples.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, words long, places array<long>, times array<long>").collect()
    # Examples with the same strongest term become neighbours, which keeps the block maxima tight.
    def profile(r):
        weights = np.array(r["times"], float) * idf[r["places"]] if r["places"] else np.zeros(1)
        return (r["places"][int(np.argmax(weights))] if r["places"] else -1, float(weights.sum()) / max(1, r["words"]), r["doc_id"], r["label"])

    made.sort(key=profile)
    return index, idf, [(r["places"], r["times"], r["words"], r["label"], r["doc_id"]) for r in made], sizes


def build(parts: tuple) -> Model:
    """The model from the parts :func:`fit` returns."""
    index, idf, rows, sizes = parts
    labels = np.array([r[3] for r in rows], np.int64)
    stands = np.array([sizes[c] / max(1, int((labels == c).sum())) for c in labels.tolist()])
    shell = Model(index, idf, [], labels, stands, [])
    vectors = [shell.vector(np.array(p, np.int64), np.array(t, float), w) for p, t, w, _, _ in rows]
    return Model(index, idf, vectors, labels, stands, [r[4] for r in rows])


def score(docs: DataFrame, text: str, parts: tuple) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``evidence``: keys of the nearest examples and their cosines.

    A null text counts as empty; like any text without vocabulary terms it gets
    the score of such texts among the examples. Columns of these names are replaced.
    """
    index, idf, rows, sizes = parts
    model = build(parts)
    used = np.flatnonzero(index >= 0)
    plain = (used, index[used], idf, model.nearest.maxima, model.nearest.postings, model.labels, model.weights, model.keys, model.breaks, model.values)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    state: dict = {}

    def load() -> tuple[Model, Stems]:
        used, places, idf, maxima, postings, labels, weights, keys, breaks, values = shared.value
        index = np.full(1 << TERM_BITS, -1, np.int64)
        index[used] = places
        model = Model(index, idf, [], labels, weights, keys)
        model.nearest.maxima, model.nearest.postings, model.nearest.n = maxima, postings, len(keys)
        model.breaks, model.values = breaks, values
        return model, Stems()

    def apply(batch: pa.RecordBatch) -> dict:
        model, stems = state.get("model") or state.setdefault("model", load())
        flat, offsets = flat_text(batch.column(batch.schema.get_field_index(text)))
        scores, evidence = [], []
        for low, high in chunks(offsets):
            row, place, times, words = stems.counted(flat, offsets[low : high + 1], model.index)
            cuts = np.searchsorted(row, np.arange(high - low + 1)).tolist()
            for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a == b and "empty" in state:
                    answer = state["empty"]
                else:
                    examples, cosines = model.nearest.search(*model.vector(place[a:b], times[a:b].astype(float), int(words[r])), K)
                    near = ",".join(f"{model.keys[e]}:{c:.3f}" for e, c in zip(examples[:3].tolist(), cosines[:3].tolist()))
                    answer = (model.calibrated(model.vote(examples, cosines)), near)
                    if a == b:
                        state["empty"] = answer
                scores.append(answer[0])
                evidence.append(answer[1])
        return {"score": scores, "evidence": evidence}

    return map_batches(docs, apply, [("score", T.DoubleType()), ("evidence", T.StringType())])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    parts = fit(docs, labels, "toxic")
    scored = score(docs.select("doc_id", "text"), "text", parts)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )
