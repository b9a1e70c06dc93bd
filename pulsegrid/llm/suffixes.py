"""Suffix-array dedup (operator 8): remove every byte of a string of ``LENGTH`` bytes that starts elsewhere too.

Sorting all suffixes of a corpus ships every text about ``LENGTH`` times. This is a
sparse suffix array: of each window of ``LENGTH`` bytes one suffix is sampled, that
with the least hash of its leading ``LEAD`` bytes, so equal windows sample the same
suffix. First only the hashes of the leading bytes are counted. Suffixes whose
leading bytes occur once can be in no repeat; the others travel with
their context (the bytes of all windows that sampled them). They are range-
partitioned by their leading bytes with splitters from a sample, which keeps
equal leads on one side of every boundary, and each bucket is sorted by its lead,
eight bytes at a time. For each place of a window around the lead, equal windows
among the neighbours are found by a second sort. A window repeats exactly if
that happens, so the union of such windows is what has to go.

A lead that occurs more than ``HOT`` times (a period of a repeating text, a passage
of very many texts) would be one group however many buckets there are. Its suffixes send the hash
of each window that sampled them instead of contexts, dealt by that hash. Windows that
repeat within a task are settled there and sent once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.batches import U64, RangeHash, chunks, flat_text, mix, numbers
from pulsegrid.llm.store import bitmap, partitions, read_table, stored

LENGTH, LEAD = 200, 32
LEFT = LENGTH - LEAD  # bytes before the lead that a window can hold
SPAN = LEFT + LENGTH
_FLUSH_HASHES = 2_000_000
_FLUSH_CONTEXTS = 40_000
_FLUSH_WINDOWS = 1_000_000
#: A lead with more suffixes than this is judged by the hashes of its windows.
HOT = 4_000
_SAMPLE = 20_000
_VALUES = numbers(256, 21)


class Sampler:
    """Sampled suffixes of whole texts."""

    def __init__(self) -> None:
        self.hasher = RangeHash()

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes of the leads) of the suffixes that the windows of one text sample."""
        if len(data) < LENGTH:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        sampled, hashes, _ = self.windows(data)
        places = np.unique(sampled)
        return places, hashes[places]

    def windows(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place that each window samples, hash of the lead at each place, prefix sums) of a text of ``LENGTH`` bytes or more."""
        windows = len(data) - LENGTH + 1
        prefix = self.hasher.prefix(_VALUES[data])
        n = len(data) - LEAD + 1
        hashes = mix((prefix[LEAD:] - prefix[:-LEAD]) * self.hasher.inverses[:n])
        ranked = (hashes & ~U64(0xFFFFFFFF)) | np.arange(n, dtype=U64)  # ties go to the first
        width = LEFT + 1
        blocks = -(-n // width)
        padded = np.full(blocks * width, ~U64(0))
        padded[:n] = ranked
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        return (least & U64(0xFFFFFFFF)).astype(np.int64), hashes, prefix


def _text_name(data: np.ndarray, hasher: RangeHash) -> int:
    prefix = hasher.prefix(_VALUES[data])
    return int(hasher.ranges(prefix, np.array([0]), np.array([len(data)])).view(np.int64)[0])


def _texts(batches):
    """Each text of at least ``LENGTH`` bytes as a byte array; further equal texts of the task are left out."""
    hasher, seen = RangeHash(), set()
    for batch in batches:
        flat, offsets = flat_text(batch.column("text"))
        keys = batch.column("text_key").to_pylist()
        for row in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
            data = flat[offsets[row] : offsets[row + 1]]
            name = (keys[row], _text_name(data, hasher))
            if name not in seen:
                seen.add(name)
                yield keys[row], data


def _lead_hashes(buckets: int):
    """mapInArrow function: packed hashes of the leads by bucket, and a few leads for the splitters."""

    def run(batches):
        sampler, held, count = Sampler(), [], 0

        def flush():
            hashes = np.sort(np.concatenate(held))
            edges = np.searchsorted((hashes >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1, dtype=U64))
            rows = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            parts = [hashes[edges[b] : edges[b + 1]].tobytes() for b in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(parts, pa.binary()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())],
                names=["bucket", "hashes", "lead", "rank"],
            )

        for _, data in _texts(batches):
            places, hashes = sampler(data)
            held.append(hashes)
            count += len(hashes)
            few = np.flatnonzero(mix(hashes) < U64(2**64 // 256))
            if len(few):
                leads = [data[p : p + LEAD].tobytes() for p in places[few].tolist()]
                ranks = (mix(hashes[few]) >> U64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranks % buckets, pa.int32()), pa.nulls(len(few), pa.binary()), pa.array(leads, pa.binary()), pa.array(ranks)],
                    names=["bucket", "hashes", "lead", "rank"],
                )
            if count > _FLUSH_HASHES:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return run


def _repeated_hashes(batches):
    """mapInArrow function over one bucket: the hashes that occur more than once, with their number as rank; sampled leads pass."""
    held = []
    for batch in batches:
        is_lead = batch.column("lead").is_valid()
        if is_lead.true_count:
            part = batch.filter(is_lead)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), part.column("lead"), part.column("rank")], names=["hash", "lead", "rank"])
        held += [np.frombuffer(x, U64) for x in batch.column("hashes").to_pylist() if x is not None]
    if held:
        hashes = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        times = np.diff(np.append(starts, len(hashes)))
        again, times = hashes[starts[times > 1]], times[times > 1]
        yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.nulls(len(again), pa.binary()), pa.array(times)], names=["hash", "lead", "rank"])


def _bits(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the repeated hashes, eight bits for each within 2**20 to 2**28 bits; where it is full it spares less work."""
    size = max(20, min(28, int(8 * max(1, repeated.count()) - 1).bit_length()))
    return bitmap(repeated, F.shiftrightunsigned("hash", 64 - size), size), size


def _hot(repeated: DataFrame) -> np.ndarray:
    """Sorted hashes of the leads with more than ``HOT`` suffixes; there is at most one for that many suffixes."""
    return np.sort(repeated.where(F.col("rank") > HOT).select("hash").toArrow().column("hash").to_numpy().view(U64))


#: A blob holds, compressed, the text keys, places, bytes to the left and to the right, and contexts of ``n`` suffixes.
#: Instead, ``windows`` holds hash, text key and start of ``n`` windows (start -1: repeated, reported by its task), and
#: ``ranges`` text key, start and end of ``n`` ranges to report.
_CONTEXT = "bucket int, n int, blob binary, windows binary, ranges binary"
_CODEC = "zstd"


def _pack(keys: np.ndarray, places: np.ndarray, lefts: np.ndarray, rights: np.ndarray, body: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in (keys, places, lefts.astype(np.uint8), rights.astype(np.uint8), body))
    return pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=n * (18 + SPAN), codec=_CODEC, asbytes=True), np.uint8)
    keys, places, lefts, rights, body = np.split(raw, np.cumsum([8 * n, 8 * n, n, n]))
    return [keys.view(np.int64), places.view(np.int64), lefts.astype(np.int32), rights.astype(np.int32), body.reshape(n, SPAN)]


def _shipped(buckets: np.ndarray, sizes: np.ndarray, kind: str, blobs: list[bytes]) -> pa.RecordBatch:
    """A batch of ``_CONTEXT`` rows of one kind."""
    packed = [pa.array(blobs, pa.binary()) if name == kind else pa.nulls(len(blobs), pa.binary()) for name in ("blob", "windows", "ranges")]
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets.astype(np.int32)), pa.array(sizes.astype(np.int32)), *packed], names=["bucket", "n", "blob", "windows", "ranges"]
    )


def _columns(blobs: list[tuple[bytes, int]], width: int) -> np.ndarray:
    """The ``width`` columns of 64-bit words that compressed blobs of ``n`` rows each hold."""
    parts = [np.frombuffer(pa.decompress(x, decompressed_size=8 * width * n, codec=_CODEC, asbytes=True), np.int64).reshape(width, n) for x, n in blobs]
    return np.concatenate(parts, axis=1) if parts else np.zeros((width, 0), np.int64)


def _joined(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text_key, start, end) of the unions of windows that overlap or touch, of rows in order of (key, start)."""
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (starts[1:] - starts[:-1] > LENGTH)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(keys))[: len(at)] - 1
    return keys[at], starts[at], starts[last] + LENGTH


def _split_windows(hashes: np.ndarray, keys: np.ndarray, starts: np.ndarray, buckets: int):
    """``_CONTEXT`` rows of a task's windows: each hash once by its bucket, and the ranges of windows that repeat in the task."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.flatnonzero(first)
    again = np.diff(np.append(at, len(ranked))) > 1
    repeated = np.zeros(len(hashes), bool)
    repeated[order] = np.repeat(again, np.diff(np.append(at, len(ranked))))
    if repeated.any():
        place = np.flatnonzero(repeated)
        place = place[np.lexsort((starts[place], keys[place]))]
        found = np.stack(_joined(keys[place], starts[place]))
        owner = found[0].view(U64) % U64(buckets)
        found = found[:, np.argsort(owner, kind="stable")]
        owner = np.sort(owner).astype(np.int64)
        used, low = np.unique(owner, return_index=True)
        high = np.append(low[1:], len(owner))
        yield _shipped(used, high - low, "ranges", [pa.compress(found[:, a:b].tobytes(), codec=_CODEC, asbytes=True) for a, b in zip(low.tolist(), high.tolist())])
    sent = np.stack([ranked[at].view(np.int64), np.where(again, 0, keys[order[at]]), np.where(again, -1, starts[order[at]])])
    bucket = ((ranked[at] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    used, low = np.unique(bucket, return_index=True)
    high = np.append(low[1:], len(bucket))
    yield _shipped(used, high - low, "windows", [pa.compress(sent[:, a:b].tobytes(), codec=_CODEC, asbytes=True) for a, b in zip(low.tolist(), high.tolist())])


def _contexts(shared, splitters, buckets: int):
    """mapInArrow function: suffixes whose lead occurs again, with context, by bucket of the lead; of hot leads the windows."""

    def run(batches):
        bits, size, hot = shared.value
        cuts, sampler = np.array(splitters.value, f"S{LEAD}"), Sampler()
        keys, places, lefts, rights, bodies = [], [], [], [], []

        def flush():
            body = np.concatenate(bodies)
            leads = np.ascontiguousarray(body[:, LEFT : LEFT + LEAD]).view(f"S{LEAD}").ravel()
            order = np.argsort(leads, kind="stable")  # equal leads side by side compress well
            bucket = np.searchsorted(cuts, leads[order], "right")
            columns = [np.concatenate(x)[order] for x in (keys, places, lefts, rights)] + [body[order]]
            used, starts = np.unique(bucket, return_index=True)
            stops = np.append(starts[1:], len(bucket))
            blobs = [_pack(*(c[a:b] for c in columns)) for a, b in zip(starts.tolist(), stops.tolist())]
            return _shipped(used, stops - starts, "blob", blobs)

        count = pending = 0
        windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for key, data in _texts(batches):
            at, hashes = sampler(data)
            if len(hot):
                known = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
                if known.any():
                    sampled, _, prefix = sampler.windows(data)
                    begin = np.flatnonzero(np.isin(sampled, at[known]))
                    windows.append((sampler.hasher.ranges(prefix, begin, begin + LENGTH), np.full(len(begin), key, np.int64), begin))
                    pending += len(begin)
                    if pending >= _FLUSH_WINDOWS:
                        yield from _split_windows(*(np.concatenate(x) for x in zip(*windows)), buckets)
                        windows, pending = [], 0
                    at, hashes = at[~known], hashes[~known]
            slot = hashes >> U64(64 - size)
            at = at[(bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1]
            for low in range(0, len(at), _FLUSH_CONTEXTS):
                part = at[low : low + _FLUSH_CONTEXTS]
                padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                bodies.append(np.lib.stride_tricks.sliding_window_view(padded, SPAN)[part])
                keys.append(np.full(len(part), key, np.int64))
                places.append(part)
                lefts.append(np.minimum(part, LEFT).astype(np.int32))
                rights.append(np.minimum(len(data) - part, LENGTH).astype(np.int32))
                count += len(part)
                if count >= _FLUSH_CONTEXTS:
                    yield flush()
                    keys, places, lefts, rights, bodies = [], [], [], [], []
                    count = 0
        if count:
            yield flush()
        if pending:
            yield from _split_windows(*(np.concatenate(x) for x in zip(*windows)), buckets)

    return run


def sort_by_lead(body: np.ndarray) -> np.ndarray:
    """Order of contexts by their leads, eight bytes at a time from the last to the first."""
    words = np.ascontiguousarray(body[:, LEFT : LEFT + LEAD]).view(">u8").astype(U64)
    return np.lexsort([words[:, j] for j in reversed(range(words.shape[1]))])


def repeated_windows(body: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[context, o]: the window that begins o bytes before the lead lies in the text and equals that of another context."""
    powers = RangeHash()
    powers.prefix(np.zeros(SPAN, U64))
    windows = np.empty((LEFT + 1, len(body)), U64)
    for at in range(0, len(body), 1000):  # prefix sums of a few contexts at a time, however large the group
        part = body[at : at + 1000]
        prefix = np.zeros((len(part), SPAN + 1), U64)
        np.cumsum(_VALUES[part] * powers.powers[:SPAN], axis=1, out=prefix[:, 1:])
        for o in range(LEFT + 1):
            low = LEFT - o
            windows[o, at : at + 1000] = mix((prefix[:, low + LENGTH] - prefix[:, low]) * powers.inverses[low])
    out = np.zeros((len(body), LEFT + 1), bool)
    for o in range(LEFT + 1):
        inside = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        hashes = windows[o, inside]
        order = np.argsort(hashes)
        equal = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(inside), bool)
        again[1:] = equal
        again[:-1] |= equal
        out[inside[order[again]], o] = True
    return out


def _range_rows(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, ends)], names=["text_key", "start", "end"])


def _repeats(batches):
    """mapInArrow function over one bucket: (text_key, start, end) of the bytes that repeated windows cover."""
    parts, windows = [], []
    for batch in batches:
        for n, blob, packed, ranges in zip(*(batch.column(c).to_pylist() for c in ("n", "blob", "windows", "ranges"))):
            if blob is not None:
                parts.append(_unpack(blob, n))
            elif packed is not None:
                windows.append((packed, n))
            else:
                yield _range_rows(*_columns([(ranges, n)], 3))
    if windows:
        hashes, keys, starts = _columns(windows, 3)
        del windows
        order = np.argsort(hashes)
        same = np.diff(hashes[order]) == 0
        again = np.zeros(len(order), bool)
        again[1:] = same
        again[:-1] |= same
        place = order[again]
        place = place[starts[place] >= 0]
        place = place[np.lexsort((starts[place], keys[place]))]
        yield _range_rows(*_joined(keys[place], starts[place]))
    if not parts:
        return
    keys, places, left, right, body = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = sort_by_lead(body)
    lead = body[order, LEFT : LEFT + LEAD]
    fresh = np.concatenate([[True], (lead[1:] != lead[:-1]).any(axis=1)])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(order)))
    order = order[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):  # about 4,000 contexts at once, groups whole
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 4000, "right")) - 1)
        rows = order[edges[at] : edges[to]]
        found = repeated_windows(body[rows], left[rows], right[rows])
        padded = np.zeros((len(rows), LEFT + 3), np.int8)
        padded[:, 1:-1] = found
        step = np.diff(padded, axis=1)
        who, first = np.nonzero(step == 1)  # runs of o from first to last - 1
        _, last = np.nonzero(step == -1)
        start, end = places[rows[who]] - (last - 1), places[rows[who]] - first + LENGTH
        yield _range_rows(keys[rows[who]], start, end)
        at = to


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open ranges."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _cut(batches):
    """mapInArrow function: each text with its ranges to the digest of what is left."""
    for batch in batches:
        flat, offsets = flat_text(batch.column("text"))
        rows: list[list] = [[], [], [], []]
        for r, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            ranges = batch.column("ranges")[r].as_py() or []
            starts, ends = merged(np.array([x["start"] for x in ranges], np.int64), np.array([x["end"] for x in ranges], np.int64))
            data = flat[a:b]
            edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), b - a]
            kept = b"".join([data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])])
            for row, value in zip(rows, (b - a, b - a - len(kept), len(starts), hashlib.sha256(kept).hexdigest())):
                row.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(text_key, start, end): ranges of texts(text_key, text) that repeated windows cover, texts of several rows as a whole.

    ``text_key`` must be a function of the text.
    """
    spark = texts.sparkSession
    buckets = 2 * partitions(spark)
    hashed = texts.mapInArrow(_lead_hashes(buckets), "bucket int, hashes binary, lead binary, rank long")
    hashed = hashed.repartitionById(buckets, F.col("bucket")).mapInArrow(_repeated_hashes, "hash long, lead binary, rank long")
    hashed = stored(hashed, "leads")
    sample = hashed.where(F.col("lead").isNotNull()).orderBy("rank").limit(_SAMPLE).select("lead").collect()
    leads = np.unique(np.array([bytes(r["lead"]) for r in sample], f"S{LEAD}"))
    splitters = leads[np.unique(np.linspace(0, len(leads) - 1, buckets + 1).astype(int)[1:-1])].tolist() if len(leads) else []
    context = spark.sparkContext
    repeated = hashed.where(F.col("hash").isNotNull())
    shared = context.broadcast((*_bits(repeated.select("hash")), _hot(repeated)))
    found = texts.mapInArrow(_contexts(shared, context.broadcast(splitters), buckets), _CONTEXT)
    found = found.repartitionById(buckets, F.col("bucket")).mapInArrow(_repeats, "text_key long, start long, end long")
    sizes = texts.where(F.octet_length("text") >= LENGTH).groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("end"))
    copies = sizes.where("n > 1").select("text_key", F.lit(0).cast("long").alias("start"), "end")
    return stored(found.unionByName(copies), "repeats")


def remove_repeats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` with an integer ``key``.

    Judged on the input as a whole; matches don't cross texts. A null text counts as
    empty; texts under ``LENGTH`` bytes lose nothing. Repeated rows are copies of each
    other. Further columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    ranges = repeated_ranges(rows.select("text_key", "text"))
    ranges = ranges.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = rows.join(ranges, "text_key", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that occur elsewhere too."""
    return remove_repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text")
