"""Packing of tokenized documents into fixed-length sequences (operator 12) by cutting-stock column generation.

Documents are tokenized once and stored. What counts for packing is the
histogram of what is left of each document after whole sequences are cut off
its head: at most one number per length. On it a linear program over patterns
(how many documents of each length class share a sequence) is solved by column
generation: a knapsack dynamic program over the dual prices finds the next
pattern. Rounded patterns are dealt to the documents by their rank among those
of the same length, which is arithmetic: no document moves to be packed.
Documents that no rounded pattern takes form a line that is cut to fill the
gaps of the patterns; its end is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.batches import chunks, flat_text
from pulsegrid.llm.store import read_table, stored

#: Length classes of the linear program; it is exact where there are no more lengths than that.
CLASSES = 256
#: Programs solved one after the other on what rounding left, and times that one may ask for new patterns.
PASSES, PRICINGS = 4, 20
#: Weight of the lower bound's prices where new patterns are priced, and steps of the simplex method between pricings.
CALM, PIVOTS = 0.9, 300
#: The program ends when no whole number of sequences can be better by more than this share.
GAP = 1e-3
#: Bytes of text tokenized at once, and words a task keeps.
CHUNK_BYTES, KEPT_WORDS = 2 << 20, 300_000

# The split pattern of the word tokenizer, and what it cuts off letters in lower-cased Latin-1 text.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
CUT = f"('s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^\\t-\\r {_LETTERS}{_NUMBERS}]+)"
#: What the library itself must read: characters beyond Latin-1, white space beyond ASCII, and what may hold a special token.
OTHER = "[^\\x00-\\x{ff}]|[\\x{85}\\x{a0}]|<\\|"


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Table:
    """Keys with the ids of each, in one flat array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.start = self.count = np.zeros(0, np.int64)

    def add(self, keys: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.place)
        self.place.update(zip(keys, range(first, first + len(keys))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[places]
        return self.flat[spread(self.start[places], counts)], counts


class Encoder:
    """Token ids of whole texts; equal to the library's, which sees each distinct piece of a task about once.

    The tokenizer drops white space, so a text's ids are those of its parts
    between spaces. Latin-1 text is cut into pieces by Arrow, and pieces that
    are not known yet go to the library many at a time; parts with other
    characters go as they are. A tokenizer of another make-up is given whole
    texts.
    """

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_str(model)
        parts = json.loads(model)
        split = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_word = split == SPLIT and steps == ["NFC", "Replace", "Lowercase"] and bool(suffix)
        self.words, self.pieces = _Table(), _Table()
        if self.by_word:
            bare = json.loads(model) | {"normalizer": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(parts["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for token, i in parts["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); texts are not null."""
        if not self.by_word:
            return self._by_library(texts.to_pylist())
        if not pc.any(pc.match_substring_regex(texts, OTHER)).as_py():
            return self._plain(texts)
        split = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(split.values, OTHER)
        flat, counts = self._plain(split.values.filter(pc.invert(odd)))
        other, sizes = self._known(self.words, split.values.filter(odd), self._by_library)
        odd = odd.to_numpy(zero_copy_only=False)
        count, start = np.zeros(len(odd), np.int64), np.zeros(len(odd), np.int64)
        count[odd], start[odd] = sizes, len(flat) + np.cumsum(sizes) - sizes
        count[~odd], start[~odd] = counts, np.cumsum(counts) - counts
        flat = np.concatenate([flat, other])[spread(start, count)]
        return flat, np.diff(np.concatenate([[0], np.cumsum(count)])[split.offsets.to_numpy()])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(pc.utf8_lower(texts), CUT, " \\1 ")
        split = pc.ascii_split_whitespace(cut)
        flat, counts = self._known(self.pieces, split.values, self._merged)
        return flat, np.diff(np.concatenate([[0], np.cumsum(counts)])[split.offsets.to_numpy()])

    def _known(self, table: _Table, keys: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys, number of ids of each), learned where the table lacks them."""
        coded = keys.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(table.place) > KEPT_WORDS:
            table.__init__()
        fresh = [k for k in distinct if k not in table.place]
        if fresh:
            table.add(fresh, *learn(fresh))
        places = np.fromiter(map(table.place.__getitem__, distinct), np.int64, len(distinct))
        return table.ids(places[coded.indices.to_numpy()])

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each): many pieces in a line, cut after the tokens that end a word."""
        lines = [" ".join(pieces[a : a + 500]) for a in range(0, len(pieces), 500)]
        parts = [np.array(e.ids, np.uint32) for a in range(0, len(lines), 16) for e in self.bare.encode_batch(lines[a : a + 16], add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *parts])
        some = np.fromiter(map(bool, pieces), bool, len(pieces))  # between two spaces lies the empty piece, which has no ids
        last = np.flatnonzero(self.ends[flat])
        if len(last) != some.sum():
            return self._by_library(pieces)
        counts = np.zeros(len(pieces), np.int64)
        counts[some] = np.diff(last, prepend=-1)
        return flat, counts


def _portions(texts: pa.Array) -> Iterator[tuple[int, pa.Array, bool]]:
    """(first row, texts, whether they are parts of that row) of about ``CHUNK_BYTES``; a longer text is cut at spaces."""
    _, offsets = flat_text(texts)
    for low, high in chunks(offsets, CHUNK_BYTES):
        if offsets[high] - offsets[low] <= CHUNK_BYTES:
            yield low, texts.slice(low, high - low), False
            continue
        for row in range(low, high):
            text, at = texts[row].as_py(), 0
            while at < len(text) or not text:
                end = len(text) if len(text) - at <= CHUNK_BYTES else text.find(" ", at + CHUNK_BYTES)
                end = len(text) if end < 0 else end
                yield row, pa.array([text[at:end]]), True
                at = end
                if not text:
                    break


def token_rows(docs: DataFrame, doc_id: str, text: str, tokenizer_path: str, end_id: int, limit: int) -> DataFrame:
    """(part, doc_id, n, rank, before, ids): the ids of each whole text and ``end_id``.

    ``rank`` counts the rows before it in its partition whose n leaves the same
    remainder, ``before`` the whole sequences before it there.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide = max([end_id, *json.loads(model)["model"]["vocab"].values(), *(t["id"] for t in json.loads(model).get("added_tokens", []))]) >= 1 << 16
    kind = "<u4" if wide else "<u2"
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def tokenize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(shared.value), TaskContext.get().partitionId()
        seen, before = np.zeros(limit, np.int64), 0
        for batch in batches:
            ids: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for first, texts, parts in _portions(pc.fill_null(batch.column(1), "")):
                flat, counts = encoder.encode(texts)
                data, edges = flat.astype(kind).tobytes(), (np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize).tolist()
                for at, (a, b) in enumerate(zip(edges, edges[1:])):
                    ids[first if parts else first + at].append(data[a:b])
            end = np.array([end_id], kind).tobytes()
            ids = [b"".join([*found, end]) for found in ids]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
            left, whole = n % limit, n // limit
            order = np.argsort(left, kind="stable")
            starts = np.flatnonzero(np.diff(left[order], prepend=-1))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(starts, np.diff(np.append(starts, len(n))))
            rank += seen[left]
            seen += np.bincount(left, minlength=limit)
            columns = [pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(n), pa.array(rank), pa.array(before + np.cumsum(whole) - whole), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n", "rank", "before", "ids"])
            before += int(whole.sum())
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    fields = [T.StructField("part", T.IntegerType()), source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n", "rank", "before")), T.StructField("ids", T.BinaryType())]
    return source.mapInArrow(tokenize, T.StructType(fields))


# --- the linear program, on the histogram alone -------------------------------


def length_classes(counts: np.ndarray, most: int) -> list[np.ndarray]:
    """Lengths that occur, in at most ``most`` classes of neighbours; a class counts as its longest.

    The class that wastes most by that is split where it saves most.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []

    def entry(part: np.ndarray) -> tuple:
        n = counts[part]
        saved = np.cumsum(n)[:-1] * (part[-1] - part[:-1])  # if those up to here counted as the longest of them
        cut = int(np.argmax(saved)) + 1 if len(part) > 1 else 0
        return (-int((n * (part[-1] - part)).sum()), int(part[0]), cut, part)

    heap = [entry(lengths)]
    while len(heap) < most and heap[0][0] < 0:
        _, _, cut, part = heapq.heappop(heap)
        heapq.heappush(heap, entry(part[:cut]))
        heapq.heappush(heap, entry(part[cut:]))
    return sorted((e[3] for e in heap), key=lambda part: part[0])


def best_patterns(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, limit: int) -> np.ndarray:
    """Bounded knapsack by dynamic programming: how often each size is taken, to the greatest value within ``limit``.

    The first row is the best pattern; each other one the best that fits beside a further copy of one size.
    """
    worth = np.zeros(limit + 1)
    steps: list[tuple[int, int, int, np.ndarray]] = []
    for at in np.flatnonzero(values > 1e-12).tolist():
        size, left, times = int(sizes[at]), int(min(most[at], limit // sizes[at])), 1
        while left > 0:  # times 1, 2, 4, ... and the rest make every number of copies
            take = min(times, left)
            raised = worth[: limit + 1 - take * size] + take * values[at]
            better = np.zeros(limit + 1, bool)
            np.greater(raised, worth[take * size :] + 1e-12, out=better[take * size :])
            worth[take * size :][better[take * size :]] = raised[better[take * size :]]
            steps.append((at, take, take * size, better))
            left, times = left - take, times * 2
    room = np.concatenate([[limit], limit - sizes])
    patterns = np.concatenate([np.zeros((1, len(sizes)), np.int64), np.eye(len(sizes), dtype=np.int64)])
    for at, take, width, better in reversed(steps):
        taken = better[room]
        patterns[taken, at] += take
        room[taken] -= width
    return patterns[(patterns <= most).all(axis=1)]


def _product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector without BLAS, whose threads may not survive the fork that starts Spark's JVM."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan steps, without BLAS."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for at in range(n):
        best = at + int(np.argmax(np.abs(both[at:, at])))
        both[[at, best]] = both[[best, at]]
        both[at] /= both[at, at]
        factor = both[:, at].copy()
        factor[at] = 0
        both -= np.outer(factor, both[at])
    return both[:, n:]


def _first_fit(sizes: np.ndarray, demand: np.ndarray, limit: int) -> np.ndarray:
    """Patterns of first-fit decreasing: the longest that are left and still fit, each pattern as often as demand allows."""
    left, patterns = demand.copy(), []
    while left.any():
        room, pattern = limit, np.zeros(len(sizes), np.int64)
        for at in range(len(sizes) - 1, -1, -1):
            pattern[at] = min(left[at], room // sizes[at])
            room -= pattern[at] * sizes[at]
        left = left - pattern * int((left[pattern > 0] // pattern[pattern > 0]).min())
        patterns.append(pattern)
    return np.unique(np.array(patterns), axis=0)


def column_generation(sizes: np.ndarray, demand: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often each is used): a basic solution with the fewest sequences, fractions allowed.

    Revised simplex over one row per class. The first basis holds one class in
    each pattern, and first-fit patterns are known from the start; the dynamic
    program adds patterns at the prices of the moment, and the simplex method
    goes on over those it knows.
    """
    copies = np.minimum(limit // sizes, demand)
    patterns, inverse, used = np.diag(copies), np.diag(1.0 / copies), demand / copies
    least = float(sizes @ demand) / limit
    known = _first_fit(sizes, demand, limit)
    for turn in range(PRICINGS):
        prices, total = inverse.sum(axis=0), float(used.sum())
        if turn and total <= math.ceil(least) + GAP * least:
            break
        # Prices close to those of the lower bound give patterns that stay useful; the program's own end it.
        found = best_patterns(sizes, CALM * sizes / limit + (1 - CALM) * prices, demand, limit)
        if _product(found, prices).max() <= 1 + 1e-6:
            found = best_patterns(sizes, prices, demand, limit)
            worth = float(_product(found, prices).max())
            if worth <= 1 + 1e-9 or total <= total / worth * (1 + GAP):
                break
        known = np.unique(np.concatenate([known, found]), axis=0)
        for pivot in range(PIVOTS):
            gains = _product(known, prices)
            enters = int(np.argmax(gains))
            if gains[enters] <= 1 + 1e-7:
                break
            change = _product(inverse, known[enters])
            rows = np.flatnonzero(change > 1e-9)
            ratio = used[rows] / change[rows]
            leaves, amount = int(rows[np.argmin(ratio)]), max(0.0, float(ratio.min()))
            used = np.maximum(used - amount * change, 0)
            used[leaves] = amount
            line = inverse[leaves] / change[leaves]
            inverse -= np.outer(change, line)
            inverse[leaves] = line
            patterns[leaves] = known[enters]
            prices = prices + (1 - change.sum()) * line
            if pivot % 100 == 99:  # rounding errors of the updates
                inverse = _inverted(patterns.T.astype(float))
                prices, used = inverse.sum(axis=0), np.maximum(_product(inverse, demand), 0)
        known = known[_product(known, prices) > 0.9]
    return patterns, used


def rounded_patterns(sizes: np.ndarray, demand: np.ndarray, limit: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """([(pattern, times)], demand that none takes): solutions rounded down, then again for what is left."""
    taken: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    for _ in range(PASSES):
        there = np.flatnonzero(left)
        if not len(there):
            break
        patterns, used = column_generation(sizes[there], left[there], limit)
        for at in np.argsort(-used, kind="stable").tolist():
            pattern = np.zeros(len(sizes), np.int64)
            pattern[there] = patterns[at]
            if not pattern.any():
                continue
            times = min(int(np.ceil(used[at] - 1e-6)), int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if times > 0 and (used[at] >= 1 - 1e-6 or int(pattern @ sizes) >= 0.98 * limit):
                taken.append((pattern, times))
                left = left - times * pattern
    return taken, left


@dataclass
class Plan:
    """Where every document's rest goes; its size depends on the limit, not on the documents.

    Segments: the rests of one length with ranks from ``first`` on lie in the
    sequences from ``sequence`` on, one each, at ``offset``; or, where
    ``sequence`` is -1, in the line, from its place ``offset`` on. Zones cut
    the line: from ``start`` on, ``size`` places go to each of the sequences
    from ``zone_sequence`` on, there from ``zone_offset``.
    """

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    size: np.ndarray
    zone_sequence: np.ndarray
    zone_offset: np.ndarray
    sequences: int


RANK_BITS = 48


def make_plan(counts: np.ndarray, whole: int, limit: int) -> Plan:
    """The plan for ``counts[l]`` rests of each length l (below ``limit``) after ``whole`` full sequences."""
    counts = counts.copy()
    counts[0] = 0
    classes = length_classes(counts, CLASSES)
    sizes = np.array([part[-1] for part in classes], np.int64)
    demand = np.array([counts[part].sum() for part in classes], np.int64)
    taken = rounded_patterns(sizes, demand, limit)[0] if classes else []
    # Documents of a class by falling length: ranks of the class from edges[c][i] on have length lengths[c][i].
    lengths = [part[::-1] for part in classes]
    edges = [np.concatenate([[0], np.cumsum(counts[part])]) for part in lengths]
    given = np.zeros(len(classes), np.int64)
    parts: list[list] = []  # [unused places, times, [(length, first rank)]]
    for pattern, times in taken:
        slots = [(c, int(given[c]) + j * times) for c in np.flatnonzero(pattern).tolist() for j in range(int(pattern[c]))]
        given += pattern * times
        cuts = {0, times}
        for c, low in slots:
            inside = edges[c][(edges[c] > low) & (edges[c] < low + times)]
            cuts.update((inside - low).tolist())
        cuts_in_order = sorted(cuts)
        for a, b in zip(cuts_in_order, cuts_in_order[1:]):
            there = []
            for c, low in slots:
                i = int(np.searchsorted(edges[c], low + a, "right")) - 1
                there.append((int(lengths[c][i]), low + a - int(edges[c][i])))
            parts.append([limit - sum(length for length, _ in there), b - a, there])
    line: list[tuple[int, int, int]] = []  # (length, first rank, count)
    for c in range(len(classes)):
        for i, length in enumerate(lengths[c].tolist()):
            low, high = max(int(given[c]), int(edges[c][i])), int(edges[c][i + 1])
            if low < high:
                line.append((length, low - int(edges[c][i]), high - low))
    # Sequences with the widest gaps go to the line where it is too short to fill all gaps.
    short = sum(p[0] * p[1] for p in parts) - sum(length * n for length, _, n in line)
    for part in sorted(parts, key=lambda p: -p[0]):
        if short <= 0:
            break
        gone = min(part[1], -(-short // limit))
        part[1] -= gone
        short -= gone * limit
        line += [(length, first + part[1], gone) for length, first in part[2]]
    segments, zones = [], []
    sequence, gap = whole, 0
    for room, times, there in parts:
        if not times:
            continue
        offset = 0
        for length, first in there:
            segments.append((length, first, sequence, offset))
            offset += length
        if room:
            zones.append((gap, room, sequence, offset))
            gap += room * times
        sequence += times
    place = 0
    for length, first, n in line:
        segments.append((length, first, -1, place))
        place += length * n
    rest = place - gap
    if rest >= limit:
        zones.append((gap, limit, sequence, 0))
        sequence += rest // limit
        gap += rest // limit * limit
    for bit in reversed(range(limit.bit_length())):  # the end in sequences of powers of two, which need no padding
        if rest % limit >> bit & 1:
            zones.append((gap, 1 << bit, sequence, 0))
            sequence, gap = sequence + 1, gap + (1 << bit)
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 4)
    cut = np.array(zones, np.int64).reshape(-1, 4)
    return Plan((table[:, 0] << RANK_BITS) | table[:, 1], table[:, 1], table[:, 2], table[:, 3], cut[:, 0], cut[:, 1], cut[:, 2], cut[:, 3], sequence)


def _line_pieces(plan: Plan, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a rest at ``place`` of the line."""
    done = 0
    while done < length:
        at = place + done
        zone = int(np.searchsorted(plan.start, at, "right")) - 1
        turn, inside = divmod(at - int(plan.start[zone]), int(plan.size[zone]))
        take = min(int(plan.size[zone]) - inside, length - done)
        yield done, take, int(plan.zone_sequence[zone]) + turn, int(plan.zone_offset[zone]) + inside
        done += take


def pack(docs: DataFrame, doc_id: str, text: str, tokenizer_path: str, *, limit: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most ``limit`` tokens, none of which needs padding.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset): the ``length`` ids from ``start`` on of a document (its ids and
    ``end_id``) lie in a sequence at ``offset``; sequences are numbered from 0
    without gaps and their pieces leave none. Every sequence is full but a few
    of a power of two at the end. A null or empty text is its end id alone;
    rows with equal or null ids are documents of their own; an empty table
    gives no rows. Columns besides the two named are not read.
    """
    spark = docs.sparkSession
    tokens = stored(token_rows(docs, doc_id, text, tokenizer_path, end_id, limit), "packing-tokens", compression="zstd")
    left = (F.col("n") % limit).alias("left")
    cells = stored(tokens.groupBy("part", left).agg(F.count("*").alias("count"), F.sum(F.floor(F.col("n") / limit)).alias("whole")), "packing-cells")
    counts, whole = np.zeros(limit, np.int64), 0
    for row in cells.groupBy("left").agg(F.sum("count").alias("count"), F.sum("whole").alias("whole")).collect():  # one row per length
        counts[row.left] = row["count"]
        whole += row.whole
    shared = spark.sparkContext.broadcast(vars(make_plan(counts, whole, limit)))
    earlier = Window.partitionBy("left").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy("part").agg(F.sum("whole").alias("whole"))
    parts = parts.select("part", F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("wholes"))
    first = cells.select("part", "left", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("ranks")).join(parts, "part")
    placed = tokens.withColumn("left", F.col("n") % limit).join(first, ["part", "left"])
    source = placed.select("doc_id", "n", (F.col("rank") + F.col("ranks")).alias("rank"), (F.col("before") + F.col("wholes")).alias("before"), "ids")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(**shared.value)
        for batch in batches:
            n, rank, before = (batch.column(c).to_numpy() for c in (1, 2, 3))
            rest = n % limit
            segment = np.maximum(np.searchsorted(plan.key, (rest << RANK_BITS) | rank, "right") - 1, 0)
            rows: list[tuple] = []
            for at, (total, ids) in enumerate(zip(n.tolist(), batch.column(4).to_pylist())):
                values = np.frombuffer(ids, f"<u{len(ids) // total}").astype("<u4")
                pieces = [(k * limit, limit, int(before[at]) + k, 0) for k in range(total // limit)]
                if rest[at]:
                    s, start = segment[at], total - int(rest[at])
                    ahead = int(rank[at]) - int(plan.first[s])
                    if plan.sequence[s] >= 0:
                        pieces.append((start, int(rest[at]), int(plan.sequence[s]) + ahead, int(plan.offset[s])))
                    else:
                        line = _line_pieces(plan, int(plan.offset[s]) + ahead * int(rest[at]), int(rest[at]))
                        pieces += [(start + a, length, sequence, offset) for a, length, sequence, offset in line]
                rows += [(at, a, length, zlib.crc32(values[a : a + length].tobytes()), total, sequence, offset) for a, length, sequence, offset in pieces]
            table = np.array(rows, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(table[:, 0])), *(pa.array(table[:, c]) for c in range(1, 7))], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return source.mapInArrow(cut, T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names[1:])]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), "doc_id", "text", default_tokenizer())
