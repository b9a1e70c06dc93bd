"""Hard-negative mining (operator 11) by threshold joins in the manner of L2AP.

Rows are packed once into blocks of integer matrices. Anchors go over all
blocks in chunks of bounded size, each with a score threshold. In a block the
dimensions are ordered by energy; a row's lists end where the norms of the
remaining dimensions can no longer lift a score to the threshold. Partial
scores are summed slab by slab, pairs that the remaining norms cannot save are
dropped, and only candidates read the dimensions that were left out. Windows
that have too few rows get lower thresholds in the next round, down to their
floor, so the result is exact whatever the first guess was.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.store import read_table, shared_folder, stored

#: Rows of a packed block, and values it holds at most unless one vector is longer.
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 20
#: Bytes of the anchors (as 8-byte values) that one round sends to the tasks.
CHUNK_BYTES = 8 << 20
#: Anchors that are multiplied with a block at once.
GROUP = 128
#: Entries a task gathers before it keeps only the best of each window.
GATHERED = 1 << 18
#: The first threshold aims at so many times the rows a window needs.
AIM = 4
#: Rounds before a window's threshold falls to its floor.
ROUNDS = 5
#: Rows of a squared norm from here on take no part: their scores might not fit a long.
NORM_LIMIT = 2.0**62
LEAST = -(2**62)

PACK = "part int, block int, n int, width int, kind string, ids binary, known binary, labels binary, vectors binary"
HIT = "window int, score long, id long, last boolean"


def _matrix(pack: dict) -> np.ndarray:
    return np.frombuffer(pack["vectors"], pack["kind"]).reshape(pack["n"], pack["width"])


def _smallest(values: np.ndarray) -> np.ndarray:
    """``values`` in the smallest integer type that holds them."""
    top = int(np.abs(values).max(initial=0))
    return values.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")


def pack_rows(rows: DataFrame, row_id: str, label: Column, vector: str, scale: float) -> DataFrame:
    """Blocks of the rows that take part: ids, labels and floor(``scale`` * x) of all components x.

    A block is known by its task and number; stored once, these do not change.
    """
    source = rows.select(F.col(f"`{row_id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []
        rows, width = 0, 1

        def flush() -> pa.RecordBatch:
            nonlocal block, rows, width
            matrix = np.zeros((rows, width), np.int64)
            low = 0
            for _, _, _, values, lengths in waiting:
                high = low + len(lengths)
                at = np.repeat(np.arange(low, high), lengths)
                inside = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                matrix[at, inside] = values
                low = high
            small = _smallest(matrix)
            ids, known, labels = (np.concatenate([w[i] for w in waiting]) for i in range(3))
            values = [part, block, rows, width, small.dtype.str, ids.tobytes(), known.tobytes(), labels.tobytes(), small.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]
            waiting.clear()
            block, rows, width = block + 1, 0, 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "block", "n", "width", "kind", "ids", "known", "labels", "vectors"])

        for batch in batches:
            for piece in _usable(batch, scale):
                size = len(piece[4])
                wide = max(width, int(piece[4].max(initial=1)))
                if rows and (rows + size > BLOCK_ROWS or (rows + size) * wide > BLOCK_VALUES):
                    yield flush()
                waiting.append(piece)
                rows, width = rows + size, max(width, int(piece[4].max(initial=1)))
        if rows:
            yield flush()

    return source.mapInArrow(pack, PACK)


def _usable(batch: pa.RecordBatch, scale: float) -> Iterator[tuple]:
    """(ids, known, labels, values, lengths) of the rows that take part, in pieces that fit a block."""
    ids, labels, vectors = batch.column(0), batch.column(1), batch.column(2)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    numbers = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * numbers)
        squares = scaled * scaled
    starts = np.cumsum(lengths) - lengths
    norms = np.zeros(len(lengths))
    full = lengths > 0
    if full.any():
        norms[full] = np.add.reduceat(squares, starts[full])
    keep = ~labels.is_null().to_numpy(zero_copy_only=False) & ~vectors.is_null().to_numpy(zero_copy_only=False) & (norms < NORM_LIMIT)  # false for NaN too
    known = ~ids.is_null().to_numpy(zero_copy_only=False)
    number = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    mark = pc.fill_null(labels, 0).to_numpy(zero_copy_only=False)
    order = np.flatnonzero(keep)
    step = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, int(lengths[order].max(initial=1)))))
    for low in range(0, len(order), step):
        take = order[low : low + step]
        at = np.repeat(starts[take] - (np.cumsum(lengths[take]) - lengths[take]), lengths[take]) + np.arange(int(lengths[take].sum()))
        yield number[take], known[take], mark[take], scaled[at].astype(np.int64), lengths[take]


@dataclass
class Wanted:
    """A round's anchors and windows, as the tasks get them."""

    place: np.ndarray  # (part, block, row) of each anchor, which is not its own partner
    label: np.ndarray
    vectors: np.ndarray
    window: np.ndarray  # number of each window, its anchor, highest and lowest score, and whether the lowest is its floor
    anchor: np.ndarray
    cap: np.ndarray
    low: np.ndarray
    last: np.ndarray
    same: bool  # partners have the anchor's label, or another
    best: int  # rows a window takes

    def slots(self) -> list[np.ndarray]:
        """For each anchor its first window, its second and so on; -1 where it has no more."""
        order = np.argsort(self.anchor, kind="stable")
        starts = np.flatnonzero(np.diff(self.anchor[order], prepend=-1))
        turn = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        slots = []
        for t in range(int(turn.max(initial=-1)) + 1):
            slot = np.full(len(self.label), -1)
            slot[self.anchor[order[turn == t]]] = order[turn == t]
            slots.append(slot)
        return slots

    def groups(self) -> list[np.ndarray]:
        """Anchors in groups of about one threshold, and of one label if partners have the anchor's."""
        low = self.lowest(self.low)
        if not self.same:
            order = np.argsort(-low, kind="stable")
            return [order[a : a + GROUP] for a in range(0, len(order), GROUP)]
        order = np.lexsort((-low, self.label))
        edges = np.flatnonzero(np.diff(self.label[order])) + 1
        return [part[a : a + GROUP] for part in np.split(order, edges) for a in range(0, len(part), GROUP)]

    def lowest(self, low: np.ndarray) -> np.ndarray:
        """Of each anchor the least threshold of its windows."""
        out = np.full(len(self.label), np.iinfo(np.int64).max)
        np.minimum.at(out, self.anchor, low)
        return out


@dataclass
class Best:
    """The best rows of each window that a task has seen."""

    wanted: Wanted
    kept: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def __post_init__(self) -> None:
        self.low = self.wanted.low.copy()

    def add(self, window: np.ndarray, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        self.kept.append(np.stack([window, score, ~known, ids]))
        self.size += len(window)
        if self.size > GATHERED:
            self.compact()

    def compact(self) -> np.ndarray:
        """All kept rows; beyond the best of each window they go, and full windows raise their threshold."""
        rows = np.concatenate(self.kept, axis=1) if self.kept else np.zeros((4, 0), np.int64)
        window, score, missing, ids = rows
        rows = rows[:, np.lexsort((ids, missing, -score, window))]
        window = rows[0]
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        rank = np.arange(len(window)) - np.repeat(starts, np.diff(np.append(starts, len(window))))
        rows = rows[:, rank < self.wanted.best]
        filled = rank[rank < self.wanted.best] == self.wanted.best - 1
        at = rows[0][filled]
        self.low[at] = np.maximum(self.low[at], rows[1][filled])
        self.kept, self.size = [rows], rows.shape[1]
        return rows


class Lists:
    """Inverted lists of a block: slabs of dimensions by falling energy, and the norms of what is left after each."""

    def __init__(self, vectors: np.ndarray, largest: float) -> None:
        values = vectors.astype(np.float64)
        squares = values * values
        self.order = np.argsort(-squares.sum(axis=0), kind="stable")
        width = len(self.order)
        self.cuts = sorted({0, width // 2, width * 3 // 4, width * 7 // 8, width})
        squares = squares[:, self.order]
        tails = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([tails, np.zeros((len(values), 1))], axis=1)[:, self.cuts])
        most = float(self.rest[:, 0].max(initial=0)) * largest
        self.kind = np.float32 if most < 2**24 else np.float64 if most < 2**50 else np.int64
        self.values = (vectors if self.kind is np.int64 else values)[:, self.order].astype(self.kind)

    def pairs(self, anchors: np.ndarray, low: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) with a score of at least the anchor's ``low``, among the block's ``rows``."""
        width = min(anchors.shape[1], len(self.order))
        query = np.zeros((len(anchors), len(self.order)), np.int64)
        query[:, :width] = anchors[:, :width]
        query = query[:, self.order]
        values, rest = self.values[rows], self.rest[rows]
        if self.kind is np.int64:
            score = query @ values.T
            i, j = np.nonzero(score >= low[:, None])
            return i, j, score[i, j]
        squares = query.astype(np.float64) ** 2
        tails = np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(query), 1))], axis=1)
        left = np.sqrt(tails[:, self.cuts])
        query, floor, least = query.astype(self.kind), low.astype(self.kind), float(low.min())
        columns = np.arange(len(values))
        partial = np.zeros((len(query), len(values)), self.kind)
        found: list[tuple] = []
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            # Lists end where the remaining norms cannot reach the least threshold; what is alive there is summed pair by pair.
            listed = rest[columns, s] * left[:, s].max() >= least - 1
            if not listed.all():
                ended = columns[~listed]
                i, j = self._alive(partial[:, ~listed], left[:, s], rest[ended, s], floor)
                found.append(self._finish(query, values, rest, left, floor, i, ended[j], partial[:, ~listed][i, j], s))
                columns, partial = columns[listed], partial[:, listed]
                if not len(columns):
                    break
            partial += query[:, a:b] @ values[columns, a:b].T
        if len(columns):
            i, j = np.nonzero(partial >= floor[:, None])
            found.append((i, columns[j], partial[i, j]))
        i, j, score = (np.concatenate(x) for x in zip(*found))
        return i, j, score.astype(np.int64)

    @staticmethod
    def _alive(partial, left, rest, floor) -> tuple[np.ndarray, np.ndarray]:
        reach = np.multiply.outer((left * (1 + 1e-6)).astype(partial.dtype), rest.astype(partial.dtype))
        return np.nonzero(partial + reach + partial.dtype.type(0.5) >= floor[:, None])

    def _finish(self, query, values, rest, left, floor, i, j, score, s) -> tuple:
        """Candidates whose lists ended before slab ``s``, with their whole scores where these reach the threshold."""
        step = max(1, (1 << 21) // max(b - a for a, b in zip(self.cuts, self.cuts[1:])))
        done = []
        for low in range(0, len(i), step):
            row, column, total = i[low : low + step], j[low : low + step], score[low : low + step]
            for at, (a, b) in enumerate(zip(self.cuts[s:], self.cuts[s + 1 :]), s + 1):
                total = total + np.einsum("ij,ij->i", query[row, a:b], values[column, a:b])
                alive = total + left[row, at] * rest[column, at] * (1 + 1e-6) + 0.5 >= floor[row]
                row, column, total = row[alive], column[alive], total[alive]
            exact = total >= floor[row]
            done.append((row[exact], column[exact], total[exact]))
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (i, j, score)


def _search_block(pack: dict, wanted: Wanted, largest: float, best: Best, groups: list[np.ndarray], slots: list[np.ndarray]) -> None:
    vectors = _matrix(pack)
    ids, known, labels = np.frombuffer(pack["ids"], np.int64), np.frombuffer(pack["known"], bool), np.frombuffer(pack["labels"], np.int64)
    place = np.arange(len(labels))
    if wanted.same:
        place = np.argsort(labels, kind="stable")
        vectors, ids, known, labels = vectors[place], ids[place], known[place], labels[place]
    lists = Lists(vectors, largest)
    here = (wanted.place[:, 0] == pack["part"]) & (wanted.place[:, 1] == pack["block"])
    low = wanted.lowest(best.low)
    for group in groups:
        rows = slice(0, len(labels))
        if wanted.same:
            label = wanted.label[group[0]]
            rows = slice(int(np.searchsorted(labels, label)), int(np.searchsorted(labels, label, "right")))
            if rows.start == rows.stop:
                continue
        i, j, score = lists.pairs(wanted.vectors[group], low[group], rows)
        i, j = group[i], j + rows.start
        partner = ~(here[i] & (wanted.place[i, 2] == place[j]))
        if not wanted.same:
            partner &= wanted.label[i] != labels[j]
        i, j, score = i[partner], j[partner], score[partner]
        for slot in slots:
            window = slot[i]
            fits = window >= 0
            fits[fits] = (score[fits] <= wanted.cap[window[fits]]) & (score[fits] >= best.low[window[fits]])
            best.add(window[fits], score[fits], known[j[fits]], ids[j[fits]])


def _search(packs: DataFrame, wanted: Wanted, folder: str) -> None:
    """Writes the ``wanted.best`` best rows (or as many as there are) of each window that is filled or at its floor."""
    shared = packs.sparkSession.sparkContext.broadcast(vars(wanted))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(**shared.value)
        best, groups, slots = Best(wanted), wanted.groups(), wanted.slots()
        largest = float(np.sqrt((wanted.vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        for batch in batches:
            for pack in batch.to_pylist():
                _search_block(pack, wanted, largest, best, groups, slots)
        rows = best.compact()
        for a in range(0, rows.shape[1], 1 << 16):
            window, score, missing, ids = rows[:, a : a + (1 << 16)]
            columns = [pa.array(wanted.window[window], pa.int32()), pa.array(score), pa.array(ids, mask=missing.astype(bool)), pa.array(wanted.last[window])]
            yield pa.RecordBatch.from_arrays(columns, names=["window", "score", "id", "last"])

    by = Window.partitionBy("window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    hits = packs.mapInArrow(search, HIT).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= wanted.best)
    hits = hits.withColumn("size", F.count("*").over(Window.partitionBy("window")))
    filled = (F.col("size") >= wanted.best) | F.col("last")
    hits.where(filled).select("window", "rank", "score", "id").write.parquet(folder)
    shared.destroy()


class Chunk:
    """One chunk of anchors: fills windows round by round; results stay in stored tables."""

    def __init__(self, packs: DataFrame, rows: pa.Table, moments: tuple[np.ndarray, np.ndarray], total: int, path: str) -> None:
        self.packs, self.path, self.total = packs, path, total
        rows = rows.sort_by("no")
        column = lambda name: rows.column(name).to_numpy()
        self.place = np.stack([column("part"), column("block"), column("row")], axis=1).astype(np.int64)
        self.label, self.same = column("label"), column("n_same")
        vectors = [np.frombuffer(v, k) for v, k in zip(rows.column("vector").to_pylist(), rows.column("kind").to_pylist())]
        self.vectors = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
        for at, v in enumerate(vectors):
            self.vectors[at, : len(v)] = v
        mean, spread = moments
        width = min(self.vectors.shape[1], len(mean))
        exact = self.vectors[:, :width].astype(np.float64)
        by_dimension = "ij,j->i"  # no BLAS on the driver, whose threads may not survive the fork that starts Spark's JVM
        self.mean, self.spread = np.einsum(by_dimension, exact, mean[:width]), np.sqrt(np.einsum(by_dimension, exact**2, spread[:width]))

    def fill(self, name: str, anchor: np.ndarray, cap: np.ndarray, floor: np.ndarray, number: np.ndarray, same: bool, best: int) -> None:
        """Writes the best rows of all windows to the folder ``name``; ``number`` names the windows."""
        if not len(anchor):
            return
        rows = self.same[anchor] - 1 if same else self.total - self.same[anchor]
        low = np.maximum(floor, [self._first(a, c, best * AIM, n) for a, c, n in zip(anchor, cap.tolist(), rows.tolist())])
        step = np.maximum(1, self.spread[anchor] / 4).astype(np.float64)
        for turn in range(ROUNDS + 1):
            if turn == ROUNDS:
                low = floor
            used, at = np.unique(anchor, return_inverse=True)
            wanted = Wanted(self.place[used], self.label[used], self.vectors[used], number, at, cap, low, low <= floor, same, best)
            folder = f"{self.path}/{name}/turn={turn}"
            _search(self.packs, wanted, folder)
            done = self.packs.sparkSession.read.schema("window int").parquet(folder).distinct().toArrow().column("window").to_numpy()
            open_ = ~np.isin(number, done) & (low > floor)
            anchor, cap, floor, number, low, step = (x[open_] for x in (anchor, cap, floor, number, low, step))
            if not len(anchor):
                return
            low = np.maximum(floor, low - np.minimum(step, 2.0**60).astype(np.int64))
            step = step * 2

    def _first(self, anchor: int, cap: int, aim: int, rows: int) -> int:
        """A threshold above which, up to ``cap``, about ``aim`` of ``rows`` would lie if scores were normal."""
        mean, spread = float(self.mean[anchor]), float(self.spread[anchor])
        if rows <= 2 * aim or spread <= 0:
            return LEAST
        above = 0.5 * math.erfc(min(40.0, (cap - mean) / spread / math.sqrt(2)))
        tail = above + aim / rows
        return LEAST if tail >= 0.99 else min(cap, math.floor(mean - spread * NormalDist().inv_cdf(tail)))


def mine(
    rows: DataFrame, row_id: str, vector: str, label: str | Column, is_anchor: Column, *, positives: int = 5, negatives: int = 3,
    least_percent: int = 50, most_percent: int = 95, scale: float = 256.0,
) -> DataFrame:
    """Hard negatives of every anchor: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x become floor(``scale`` * x); a score is an integer inner
    product. An anchor's positives are its ``positives`` best other rows of
    the same label. For each, the ``negatives`` best rows of another label
    whose score lies between the two percentages of the positive's. Higher
    scores come first, ties by smaller id, a null id last.

    ``is_anchor`` is a condition on the column ``id``. Rows with a null label, a null vector or a null or non-finite component take no
    part, nor do rows whose squared norm reaches 2**62. A shorter vector is
    zero in the dimensions it lacks. Equal rows are rows of their own: one may
    be the other's positive, and each anchor among them gets its result. An
    anchor without a positive, or a positive without a row in its window,
    gives no row. Columns besides the three named are not read.
    """
    spark = rows.sparkSession
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    packs = stored(pack_rows(rows, row_id, label, vector, scale), "negatives-rows")
    shape = packs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("width").alias("width")).first()
    anchors = stored(_numbered(_anchors(packs, is_anchor), packs, shape.width or 1), "negatives-anchors", "chunk")
    path = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    chunks = sorted(r.chunk for r in anchors.select("chunk").distinct().collect())
    moments = _moments(packs, shape.n, shape.width) if chunks else None
    for chunk in chunks:
        columns = ["no", "part", "block", "row", "label", "n_same", "kind", "vector"]
        one = Chunk(packs, anchors.where(F.col("chunk") == chunk).select(*columns).toArrow(), moments, shape.n, f"{path}/chunk={chunk}")
        count = len(one.label)
        everyone = np.arange(count)
        one.fill("kind=positive", everyone, np.full(count, -LEAST), np.full(count, LEAST), everyone, True, positives)
        found = spark.read.schema("window int, rank int, score long").parquet(f"{path}/chunk={chunk}/kind=positive").toArrow()
        anchor, rank, score = (found.column(c).to_numpy().astype(np.int64) for c in ("window", "rank", "score"))
        whole, part = score // 100, score % 100  # apart, so that no product passes a long
        cap, floor = whole * most_percent + part * most_percent // 100, whole * least_percent - (-part * least_percent // 100)
        some = cap >= floor
        number = anchor * positives + rank - 1
        one.fill("kind=negative", anchor[some], cap[some], floor[some], number[some], False, negatives)
    if not chunks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    results = spark.read.schema("window int, rank int, score long, id long, chunk int, kind string, turn int").parquet(path)
    best = results.where("kind = 'positive'").select("chunk", F.col("window").alias("no"), (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = results.where("kind = 'negative'").select(
        "chunk", F.floor(F.col("window") / positives).cast("int").alias("no"), (F.col("window") % positives).alias("place"),
        "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    names = anchors.select("chunk", "no", F.col("id").alias("anchor_id"))
    return hard.join(best, ["chunk", "no", "place"]).join(names, ["chunk", "no"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _anchors(packs: DataFrame, is_anchor: Column) -> DataFrame:
    """One row per row that may be an anchor: its place, id, label and vector."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                n, vectors = pack["n"], _matrix(pack)
                known = np.frombuffer(pack["known"], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, pack["part"], np.int32)), pa.array(np.full(n, pack["block"], np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(np.frombuffer(pack["ids"], np.int64), mask=~known), pa.array(np.frombuffer(pack["labels"], np.int64)),
                        pa.array([pack["kind"]] * n), pa.array([v.tobytes() for v in vectors], pa.binary()),
                    ],
                    names=["part", "block", "row", "id", "label", "kind", "vector"],
                )

    return packs.mapInArrow(unpack, "part int, block int, row int, id long, label long, kind string, vector binary").where(is_anchor)


def _numbered(anchors: DataFrame, packs: DataFrame, width: int) -> DataFrame:
    """``anchors`` with the rows of their label, dealt by hash into chunks of bounded size and numbered there."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for labels in batch.column(0).to_pylist():
                values, counts = np.unique(np.frombuffer(labels, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["label", "n"])

    sizes = packs.select("labels").mapInArrow(count, "label long, n long").groupBy("label").agg(F.sum("n").alias("n_same"))
    chunks = max(1, -(-anchors.count() * width * 8 // CHUNK_BYTES))
    dealt = anchors.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("part", "block", "row"), F.lit(chunks)).cast("int"))
    return dealt.withColumn("no", F.row_number().over(Window.partitionBy("chunk").orderBy("part", "block", "row")) - 1)


def _moments(packs: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of every dimension over all rows; as many rows as dimensions reach the driver."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                values = _matrix(pack).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.shape[1], dtype=np.int32)), pa.array(values.sum(axis=0)), pa.array((values**2).sum(axis=0))], names=["dim", "s", "q"])

    found = packs.mapInArrow(sums, "dim int, s double, q double").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow()
    mean, square = np.zeros(width), np.zeros(width)
    at = found.column("dim").to_numpy()
    mean[at], square[at] = found.column("s").to_numpy() / total, found.column("q").to_numpy() / total
    return mean, np.maximum(square - mean**2, 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every 50th row of embeddings; every 7th row's label counts as the next one."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows, "vec_id", "embedding", label, F.col("id") % 50 == 0)


#: The same by brute force; components are exact in doubles.
OP11_SQL = """
WITH taking AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM taking a JOIN taking b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
    s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) <= 3
"""
