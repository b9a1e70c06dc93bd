"""Benchmark decontamination (operator 4): size-partitioned MinHash containment search.

A test item is a set Q of 5-word shingles (of its own width if it has fewer
words). A document X contains it when 100 * |Q & X| >= 75 * |Q|. The item is
indexed by the shingles with the smallest hashes. At most |Q| - need shingles
may be missing from X, so a sketch of one more than that always meets X: the
search has no false negatives. Items are partitioned by |Q|; a band is probed
only with the shingles of documents large enough to contain one of its items.
Every candidate is verified on the full sets.

Documents are never shuffled. Items are broadcast in blocks of about
``BLOCK_SHINGLES`` shingles; more items mean more passes, not a larger block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pulsegrid.llm.batches import U64, Words, chunks, flat_text, map_batches, shingles
from pulsegrid.llm.store import read_table, stored

WIDTH, PERCENT = 5, 75
BLOCK_SHINGLES = 1 << 21
_FILTER_BITS = 22


def item_sets(items: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(item, width, hashes) of each item: its distinct shingle hashes, sorted, as bytes. Items without words give none."""
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text"))

    def sets(batches):
        words = Words()
        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            widths, sets = [], []
            for row in range(len(batch)):
                hashes, counts = words(flat, offsets[row : row + 2])
                own = max(1, min(width, int(counts[0])))
                widths.append(own)
                sets.append(np.unique(shingles(hashes, counts, own)[0]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(widths, pa.int32()), pa.array(sets, pa.binary())], names=["item", "width", "hashes"]
            )

    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(sets, f"item {kind}, width int, hashes binary").where(F.length("hashes") > 0)


class _Index:
    """Sketches of a block of items, by shingle width and size band."""

    def __init__(self, sets: list[tuple[int, np.ndarray]], percent: int) -> None:
        self.sets = [hashes for _, hashes in sets]
        self.need = np.array([-(-percent * len(hashes) // 100) for hashes in self.sets], np.int64)
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (width, hashes) in enumerate(sets):
            groups.setdefault((width, len(hashes).bit_length()), []).append(i)
        self.bands: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self.filters: dict[int, np.ndarray] = {}
        for (width, _), members in sorted(groups.items()):
            sketches = [self.sets[i][: len(self.sets[i]) - max(int(self.need[i]), 1) + 1] for i in members]
            hashes = np.concatenate(sketches)
            owners = np.repeat(members, [len(s) for s in sketches])
            order = np.argsort(hashes, kind="stable")
            self.bands.setdefault(width, []).append((int(self.need[members].min()), hashes[order], owners[order]))
            filter_ = self.filters.setdefault(width, np.zeros(1 << _FILTER_BITS, bool))
            filter_[(hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, width: int, hashes: np.ndarray, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (row, item) pairs, as row * items + item, that share a sketch shingle."""
        at = np.flatnonzero(self.filters[width][(hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        hashes, row = hashes[at], row[at]
        found = [np.zeros(0, np.int64)]
        for least, sketch, owners in self.bands[width]:
            large = counts[row] >= least
            probe, rows = hashes[large], row[large]
            low, high = np.searchsorted(sketch, probe, "left"), np.searchsorted(sketch, probe, "right")
            n = high - low
            place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(np.repeat(rows, n) * len(self.sets) + owners[place])
        return np.unique(np.concatenate(found))


class _Searcher:
    """Finds the items of one block in Arrow batches; one per task."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int) -> None:
        self.table, self.words, self.percent = _Index(items, percent), Words(), percent

    def pairs(self, column: pa.Array):
        """(row, item, shared shingles) of every verified pair."""
        flat, offsets = flat_text(column)
        table, n_items = self.table, len(self.table.sets)
        for low, high in chunks(offsets):
            hashes, counts = self.words(flat, offsets[low : high + 1])
            for width in table.bands:
                made, sizes = shingles(hashes, counts, width)
                row = np.repeat(np.arange(high - low), sizes)
                ends = np.cumsum(sizes)
                own, at = None, -1
                for pair in table.candidates(width, made, row, sizes).tolist():
                    r, item = divmod(pair, n_items)
                    if r != at:
                        own, at = np.unique(made[ends[r] - sizes[r] : ends[r]]), r
                    q = table.sets[item]
                    common = int((own[np.minimum(np.searchsorted(own, q), len(own) - 1)] == q).sum())
                    if 100 * common >= self.percent * len(q):
                        yield low + r, item, common


def _blocks(items: DataFrame, item_key: str, item_text: str):
    """Blocks of about ``BLOCK_SHINGLES`` shingles: (item names, their sets), each small enough to broadcast."""
    sets = stored(item_sets(items, item_key, item_text), "item-sets")
    total = sets.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    for block in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("hashes", "item"), F.lit(blocks)) == block).collect()
        yield [row["item"] for row in rows], [(row["width"], np.frombuffer(row["hashes"], U64)) for row in rows]


def contained_items(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, percent: int = PERCENT
) -> DataFrame:
    """(doc, item, n_item, n_shared): each document with each item that it contains to ``percent`` percent.

    Null and empty texts contain nothing; items without a word are never found.
    Repeated documents and repeated items give a row each. Keys may be null or
    repeat, and further columns of either table are ignored.
    """
    documents = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    item_type = items.schema[item_key].dataType
    schema = f"doc {documents.schema['doc'].dataType.simpleString()}, item {item_type.simpleString()}, n_item long, n_shared long"

    def found(block):
        shared, kind = docs.sparkSession.sparkContext.broadcast(block), to_arrow_type(item_type)

        def search(batches):
            names, sets = shared.value
            searcher = _Searcher(sets, percent)
            for batch in batches:
                pairs = list(searcher.pairs(batch.column("text")))
                if pairs:
                    rows, picked, common = zip(*pairs)
                    columns = [
                        batch.column("doc").take(pa.array(rows)), pa.array([names[i] for i in picked], type=kind),
                        pa.array([len(sets[i][1]) for i in picked], pa.int64()), pa.array(common, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "item", "n_item", "n_shared"])

        return documents.mapInArrow(search, schema)

    return reduce(DataFrame.unionByName, [found(block) for block in _blocks(items, item_key, item_text)])


def count_contained(
    docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, percent: int = PERCENT, name: str = "n_items"
) -> DataFrame:
    """``docs`` with ``name``: how many items each row contains. All rows stay; a column ``name`` is replaced."""
    docs = docs.withColumn(name, F.lit(0).cast("long"))
    for block in _blocks(items, item_key, item_text):
        shared, state = docs.sparkSession.sparkContext.broadcast(block), {}

        def count(batch, shared=shared, state=state):
            searcher = state.get("searcher") or state.setdefault("searcher", _Searcher(shared.value[1], percent))
            n = batch.column(batch.schema.get_field_index(name)).to_numpy().copy()
            for row, _, _ in searcher.pairs(batch.column(batch.schema.get_field_index(text))):
                n[row] += 1
            return {name: n}

        docs = map_batches(docs, count, [(name, T.LongType())])
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items they contain: (doc_id, item_id, n_item, n_shared, containment)."""
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = contained_items(docs, "doc_id", "text", items, "item_id", "text")
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )
