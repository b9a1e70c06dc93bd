"""Document fingerprints (operator 7): I-Match with randomised lexicon subsets.

Terms are words, hashed to ``TERMS`` numbers. Document frequencies are counted over all
distinct texts; the lexicon holds the terms whose inverse document frequency lies
in a band, as one bit per term number, so its size is fixed. A document keeps
its distinct terms in the lexicon, sorted, and hashes what falls into each of
several random subsets of the lexicon. The subsets are nested in levels, each
half as dense as the one before; a document uses the two levels that leave it about
one term per subset, so long and short documents are equally sensitive.
Likeness is the share of equal hashes over the levels two fingerprints have in common.

The terms outside the lexicon give a second pair of levels, from the rarer half of them by
document frequency. A text with too few lexicon terms (one of a large family of near copies, or of common
words) has these alone, and likeness to it goes by them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.batches import U64, Words, chunks, flat_text, mix, numbers
from pulsegrid.llm.store import bitmap, partitions, read_table

TERM_BITS = 20
TERMS = 1 << TERM_BITS
SUBSETS = 32
#: Least and greatest share of distinct texts that hold a term of the lexicon; a term must be in two of them.
BAND = (0.0, 0.02)
#: A text with a smaller share of its terms in the lexicon is compared by its other terms.
FEW = 1 / 8
_COPY_BITS = 23
_HEX = 8
_NONE = "-" * _HEX
_TAG = numbers(SUBSETS + 1, 11)


def _terms(words: Words, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, term) pairs."""
    hashes, counts = words(flat, offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique((row << TERM_BITS) | (hashes >> U64(64 - TERM_BITS)).astype(np.int64))
    return pairs >> TERM_BITS, pairs & (TERMS - 1)


def frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(number of distinct texts with each term, number of distinct texts). A null text counts as empty.

    A bitmap of the hashes that more than one row has tells which texts to count where they
    are; of the others each task sends the terms of a text once, grouped by the hash.
    ``TERMS`` numbers at most reach the driver.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    copied = texts.groupBy("hash").count().where("count > 1")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(copied, F.shiftrightunsigned("hash", 64 - _COPY_BITS), _COPY_BITS))

    def totals(df):
        used = np.flatnonzero(df)
        return [pa.array(used.astype(np.int32)), pa.array(df[used])]

    def count(batches):
        words, df, seen = Words(), np.zeros(TERMS + 1, np.int64), set()
        for batch in batches:
            hashes = batch.column("hash").to_numpy()
            slot = hashes.view(U64) >> U64(64 - _COPY_BITS)
            several = ((shared.value[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1)).astype(bool)
            flat, offsets = flat_text(batch.column("text"))
            for low, high in chunks(offsets):
                row, term = _terms(words, flat, offsets[low : high + 1])
                once = ~several[low:high]
                df[:TERMS] += np.bincount(term[once[row]], minlength=TERMS)
                df[TERMS] += int(once.sum())
                cuts = np.searchsorted(row, np.arange(high - low + 1))
                sent = []
                for i in np.flatnonzero(~once).tolist():
                    h = int(hashes[low + i])
                    if h not in seen:
                        seen.add(h)
                        sent.append((h, term[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes()))
                if sent:
                    none = pa.nulls(len(sent), pa.int32()), pa.nulls(len(sent), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sent], pa.int64()), *none, pa.array([t for _, t in sent], pa.binary())], names=_COUNTED)
        term, n = totals(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), term, n, pa.nulls(len(n), pa.binary())], names=_COUNTED)

    def add_copied(batches):
        df = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            counted = batch.filter(batch.column("term").is_valid())
            df[counted.column("term").to_numpy()] += counted.column("df").to_numpy()
            for terms in batch.filter(batch.column("hash").is_valid()).column("terms"):
                df[np.frombuffer(terms.as_buffer(), np.int32)] += 1
                df[TERMS] += 1
        yield pa.RecordBatch.from_arrays(totals(df), names=["term", "df"])

    table = texts.mapInArrow(count, "hash long, term int, df long, terms binary")
    table = table.groupBy("hash", "term").agg(F.sum("df").alias("df"), F.first("terms").alias("terms"))
    table = table.mapInArrow(add_copied, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(TERMS + 1, np.int64)
    df[table.column("term").to_numpy()] = table.column("df").to_numpy()
    return df[:TERMS], int(df[TERMS])


_COUNTED = ["hash", "term", "df", "terms"]


def in_band(df: np.ndarray, total: int, band: tuple[float, float] = BAND) -> np.ndarray:
    """One flag per term number: its document frequency among ``total`` texts is in the band."""
    return (df >= max(2.0, band[0] * total)) & (df <= max(2.0, band[1] * total))


def lexicon(docs: DataFrame, text: str, band: tuple[float, float] = BAND) -> np.ndarray:
    """One flag per term number: its document frequency, counted over all distinct texts, is in the band."""
    return in_band(*frequencies(docs, text), band)


def by_rarity(df: np.ndarray) -> np.ndarray:
    """Term numbers, the rarest first, ties in the order of the number."""
    return np.argsort(df, kind="stable").astype(np.int32)


class Fingerprints:
    """Fingerprints of texts for one lexicon and one order of the terms by rarity."""

    def __init__(self, flags: np.ndarray, order: np.ndarray) -> None:
        self.flags, self.order, self.words = flags, order, Words()
        self.rank = np.zeros(TERMS, np.int64)
        self.rank[order] = np.arange(TERMS)

    def __call__(self, texts: list[str]) -> list[str]:
        """A string per text: ``level:hashes`` of two levels of its lexicon terms if it has enough, and of
        two levels of the rarer half of its other terms, marked ``c``; ``x:digest`` without a term.
        """
        out: list[str] = []
        flat, offsets = flat_text(pa.array(texts, pa.string()))
        for low, high in chunks(offsets):
            out += self._chunk(texts[low:high], flat, offsets[low : high + 1])
        return out

    def _chunk(self, texts: list[str], flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        n = len(texts)
        row, term = _terms(self.words, flat, offsets)
        known = self.flags[term]
        enough = np.bincount(row[known], minlength=n) >= np.maximum(1, FEW * np.bincount(row, minlength=n))
        main = known & enough[row]
        found = self._levels(row[main], term[main], n, "")
        ranked = np.sort((row[~known] << TERM_BITS) | self.rank[term[~known]])
        row, term = ranked >> TERM_BITS, self.order[ranked & (TERMS - 1)].astype(np.int64)
        counts = np.bincount(row, minlength=n)
        rarer = np.arange(len(row)) - (np.cumsum(counts) - counts)[row] < ((counts + 1) // 2)[row]
        others = self._levels(row[rarer], term[rarer], n, "c")
        return [
            "|".join(filter(None, parts)) or f"x:{hashlib.md5(t.encode('utf-8', 'surrogatepass')).hexdigest()}"
            for t, *parts in zip(texts, found, others)
        ]

    def _levels(self, row: np.ndarray, term: np.ndarray, n: int, mark: str) -> list[str]:
        """``level:hashes`` of two levels for each of ``n`` rows, empty for a row without a term."""
        term = term.astype(U64) + U64(1)
        counts = np.bincount(row, minlength=n)
        level = np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / 0.75))).astype(np.int64)
        present = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[present]
        value = mix(term ^ _TAG[SUBSETS])
        hashes = np.zeros((len(present), 2, SUBSETS), U64)
        for j in range(SUBSETS if len(present) else 0):
            draw = mix(term ^ _TAG[j])
            for step in (0, 1):
                inside = draw <= (~U64(0) >> (level[row] + step).astype(U64))
                hashes[:, step, j] = np.add.reduceat(np.where(inside, value, U64(0)), starts)
        hashes = np.where(hashes > 0, mix(hashes) >> U64(64 - 4 * _HEX), U64(0))
        found = [""] * n
        for i, both in zip(present.tolist(), hashes.tolist()):
            found[i] = "|".join(
                f"{mark}{level[i] + step}:" + "".join(f"{h:0{_HEX}x}" if h else _NONE for h in both[step]) for step in (0, 1)
            )
        return found


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets that either has terms in, over the common levels; 1 for equal fingerprints.

    Levels of the lexicon count where both have them, else those of the other terms.
    """
    if a == b:
        return 1.0
    if a.startswith("x") or b.startswith("x"):
        return 0.0
    one, two = (dict(part.split(":") for part in x.split("|")) for x in (a, b))
    common = a.startswith("c") or b.startswith("c")
    equal = used = 0
    for level in one.keys() & two.keys():
        if level.startswith("c") != common:
            continue
        x, y = one[level], two[level]
        for at in range(0, len(x), _HEX):
            p, q = x[at : at + _HEX], y[at : at + _HEX]
            if p != _NONE or q != _NONE:
                used += 1
                equal += p == q
    return equal / used if used else 0.0


_LOWEST = -(2**63)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, ahead, id, hash, key, text): buckets of descending ids with the first row of the next bucket at the end.

    One shuffle of the texts: splitters come from the quantiles of the ids, and each
    bucket's first row is also sent, marked ``ahead``, to the bucket before it; the
    last bucket gets the first row of all. Null ids count as the lowest. Ties are
    in the order of the text's hash.
    """
    spark = docs.sparkSession
    buckets = 2 * partitions(spark)
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64(F.col(text)).alias("hash"),
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    quantiles = rows.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    splitters = np.unique(np.array(quantiles, float)).astype(np.int64)

    def first_rows(batches):
        for batch in batches:
            ids, hashes = batch.column("id").to_numpy(), batch.column("hash").to_numpy()
            bucket = np.searchsorted(splitters, ids, "right")
            order = np.lexsort((hashes, ids))
            last = order[np.append(bucket[order][1:] != bucket[order][:-1], True)] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(bucket[last].astype(np.int32)), pa.array(ids[last]), pa.array(hashes[last])], names=["bucket", "id", "hash"])

    heads = rows.select("id", "hash").mapInArrow(first_rows, "bucket int, id long, hash long")
    heads = heads.groupBy("bucket").agg(F.max(F.struct("id", "hash")).alias("m")).select("bucket", "m.id", "m.hash").collect()
    order = sorted(row["bucket"] for row in heads)
    before = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}  # the bucket whose last row comes just before b's first
    head = {(row["id"], row["hash"]): before[row["bucket"]] for row in heads}

    def dealt(batches):
        for batch in batches:
            ids, hashes = batch.column("id").to_numpy(), batch.column("hash").to_numpy()
            bucket = np.searchsorted(splitters, ids, "right")
            ahead = {}
            for i in np.flatnonzero(np.isin(ids, np.array([k for k, _ in head], np.int64))).tolist():
                to = head.get((int(ids[i]), int(hashes[i])))
                if to is not None:
                    ahead[to] = i
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array(np.zeros(len(ids), np.int32)), *batch.columns],
                names=["bucket", "ahead", *batch.schema.names],
            )
            if ahead:
                more = batch.take(pa.array(list(ahead.values())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(ahead), pa.int32()), pa.array([1] * len(ahead), pa.int32()), *more.columns],
                    names=["bucket", "ahead", *batch.schema.names],
                )

    placed = rows.mapInArrow(dealt, "bucket int, ahead int, id long, hash long, key long, text string")
    placed = placed.repartitionById(buckets, F.col("bucket"))
    return placed.sortWithinPartitions("ahead", F.desc("id"), F.desc("hash"))


def fingerprint_edits(docs: DataFrame, key: str, text: str, flags: np.ndarray, order: np.ndarray) -> DataFrame:
    """Fingerprints of each text, of its edited form and their likeness, and that to the next document's.

    The edited form has the last third of the code points replaced by the first as many (or
    all) of the next document in descending order of the integer ``key``, after the
    last the first. A null text counts as empty. Repeated rows are each other's next.
    """
    lex = docs.sparkSession.sparkContext.broadcast((np.packbits(flags), order))

    def run(batches):
        prints = Fingerprints(np.unpackbits(lex.value[0]).astype(bool), lex.value[1])
        held: tuple | None = None  # the last row so far: (key, text, fingerprint)

        def finish(rows):
            columns = [[] for _ in range(7)]
            edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for (_, t, _), (_, after, _) in rows]
            for ((k, t, fp), (_, _, next_fp)), e, efp in zip(rows, edited, prints(edited)):
                digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                for column, value in zip(columns, (k, len(t), digest, fp, efp, likeness(fp, efp), likeness(fp, next_fp))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_OUT)

        closed = False
        for batch in batches:
            _, offsets = flat_text(batch.column("text"))
            for low, high in chunks(offsets):
                if closed:
                    break
                part = batch.slice(low, high - low)
                texts = part.column("text").to_pylist()
                ahead = part.column("ahead").to_numpy()
                rows = list(zip(part.column("key").to_pylist(), texts, prints(texts)))
                if ahead.any():
                    rows = rows[: int(np.argmax(ahead)) + 1]
                    closed = True
                chain = ([held] if held else []) + rows
                held = chain[-1]
                pairs = list(zip(chain, chain[1:]))
                if pairs:
                    yield finish(pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInArrow(run, schema)


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, lexicon over all distinct texts."""
    docs = read_table(spark, sf_dir, "documents")
    df, total = frequencies(docs, "text")
    return fingerprint_edits(docs, "doc_id", "text", in_band(df, total), by_rarity(df))
