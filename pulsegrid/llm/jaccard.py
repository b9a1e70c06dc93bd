"""N-gram Jaccard join (operator 2) by PartEnum signatures.

A document's set holds its distinct 5-word shingles. Sets of at least 75 percent
Jaccard similarity differ in at most (s + t) / 7 elements, s and t their sizes.
Sizes fall into bands [2**i, 2**(i + 1)); two similar sets meet in an instance,
which is one band or two neighbouring ones. An instance cuts the feature domain
(hash values) into a fixed number of ranges, a little more than the largest
possible difference d. The subsets enumerated are the single ranges: a
signature is the hash of a set's elements in one of them. Of m ranges in which a set
has elements at most d can differ, so with m > d the two sets share a
signature. A set with m <= d in one cut of the domain also signs a second, a third, ...
cut until m > d, and similar sets share the first cut in which either has m > d.

Signatures travel packed (6 bytes each and the keys of the documents); equal sets have one
key, so copies count once. Sets that share a signature form a group. A group of more
than ``HOT`` sets is needed only between sets without enough rarer signatures: a set
agrees with any similar one in m - d ranges or more, so one with fewer ranges in hot groups
meets all of its partners elsewhere. Sets with more (families of near copies, texts
that are mostly a common passage) are joined in blocks of some of their groups first.
What that links becomes one component, and all pairs of different
components that still share enough other signatures are verified exactly. Sets that may
meet in hot groups alone get a second level of signatures: single elements of their
beginnings in an order that puts what many of them have last, for each size of partner.
Of two sets of s and t elements that have c or more in common, the first s - c + 1 and t - c + 1
in any order share one, and a passage too short to link its sets lies behind them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.llm.batches import U64, Words, chunks, flat_text, mix, numbers, shingles, trim
from pulsegrid.llm.components import components
from pulsegrid.llm.store import bitmap, partitions, read_table, stored

WIDTH = 5
#: Signature groups above this size are split by the rule for hot signatures.
HOT = 16
HOMES = 12
BLOCK_ELEMENTS = 2_000_000
_CUTS = 24
_FLUSH = 1_000_000
_FLUSH_SECOND = 100_000
_BLOOM_BITS = 23
_TAGS = numbers(1 << 12, 7)
_SLOT_BITS, _SLOT_BLOCKS = 20, 64
#: Least sizes of the second level's bands, each about a tenth above the one before.
_EDGES = [1]
while _EDGES[-1] < 2**40:
    _EDGES.append(max(_EDGES[-1] + 1, _EDGES[-1] * 11 // 10))

_SCHEMA = "bucket int, doc_id long, carry long, n long, key long, own int, across int, gid long, size int, times int, sigs binary, owner binary, keys binary, members array<long>"


def _ranges(largest_difference: int) -> int:
    k = largest_difference
    return k + 9 * k // 20 + int(1.5 * math.sqrt(k)) + 1


def instances(n: int) -> list[tuple[int, int, int]]:
    """(instance, ranges of its domain, largest difference to a similar set in it) for a set of ``n`` elements."""
    band = n.bit_length() - 1
    top, below = 2 ** (band + 1) - 1, 2**band - 1
    partner = 4 * n // 3  # the largest set that can be similar
    found = [(2 * band, _ranges(2 * top // 7), (n + min(top, partner)) // 7)]
    if partner > top:
        found.append((2 * band + 1, _ranges((top + 4 * top // 3) // 7), (n + partner) // 7))
    if n <= 4 * below // 3:
        found.append((2 * band - 1, _ranges((below + 4 * below // 3) // 7), (n + below) // 7))
    return found


def signatures(elements: np.ndarray, plans: list[tuple[int, int, int]]) -> tuple[list[np.ndarray], list[int]]:
    """(signature arrays of a sorted set, its bounds in its own band's instance and in those of two bands).

    A bound is m - d: in how many ranges the set agrees with any similar one at least; 0
    where the first cut gives none. The lowest bit of a signature tells the kind of instance.
    """
    out, bounds = [], [1 << 30, 1 << 30]
    orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for instance, ranges, difference in plans:
        kind = instance & 1
        for cut in range(_CUTS + 1):
            if cut not in orders:
                placed = elements if cut == 0 else np.sort(mix(elements + _TAGS[cut]))
                orders[cut] = (placed, mix(placed ^ _TAGS[64]))
            placed, mixed = orders[cut]
            tag = _TAGS[128 + instance * (_CUTS + 1) + cut]
            if cut == _CUTS:  # elements one by one: m is the size of the set, which is more than d
                made, m = mix(mixed ^ tag), len(elements)
            else:
                part = ((placed >> U64(32)) * U64(ranges)) >> U64(32)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                made, m = mix(np.add.reduceat(mixed, starts) + mix(part[starts] ^ tag)), len(starts)
            out.append((made & ~U64(1)) | U64(kind))
            if m > difference:
                bounds[kind] = min(bounds[kind], m - difference if cut == 0 else 0)
                break
    return out, [0 if x == 1 << 30 else x for x in bounds]


def set_key(elements: np.ndarray) -> int:
    """64-bit name of a set, signed: equal sets have equal names; the lowest bit is that of the size band."""
    total = mix(np.add.reduce(mix(elements ^ _TAGS[65]), keepdims=True) + U64(len(elements)))
    band = U64((len(elements).bit_length() - 1) & 1)
    return int(((total & ~U64(1)) | band).view(np.int64)[0])


def _empty(n: int) -> dict[str, list]:
    return {name.split()[0]: [None] * n for name in _SCHEMA.split(", ")}


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [field.split() for field in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _signed_documents(buckets: int, width: int):
    """mapInArrow function: (doc_id, text) to document rows and packed signature rows."""

    def run(batches):
        trim()
        words, plans = Words(), {}
        pending: list[np.ndarray] = []
        owners: list[int] = []
        keys: list[int] = []
        margins: dict[int, list[int]] = {}
        held = 0

        def flush():
            if not pending:
                return
            sizes = np.fromiter(map(len, pending), np.int64, len(pending))
            sigs = np.concatenate(pending)
            owner = np.repeat(np.array(owners, np.int64), sizes)
            order = np.argsort(sigs)
            sigs, owner = sigs[order], owner[order]
            names = np.array(keys, np.int64)
            bucket = ((sigs >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[b], edges[b + 1])
                used, local = np.unique(owner[part], return_inverse=True)
                columns = _empty(1)
                columns["bucket"], columns["keys"] = [b], [names[used].tobytes()]
                columns["sigs"] = [(sigs[part] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes()]
                columns["owner"] = [local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes()]
                yield _batch(columns)
            pending.clear()
            owners.clear()
            keys.clear()
            margins.clear()

        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            ids, carry = batch.column("doc_id").to_pylist(), batch.column("carry").to_pylist()
            for low, high in chunks(offsets):
                hashes, counts = words(flat, offsets[low : high + 1])
                made, sizes = shingles(hashes, counts, width)
                ends = np.cumsum(sizes)
                columns = _empty(high - low)
                columns["doc_id"], columns["carry"] = ids[low:high], carry[low:high]
                columns["bucket"] = [x % buckets for x in range(low, high)]
                columns["n"] = [0] * (high - low)
                for r in np.flatnonzero(sizes).tolist():
                    elements = np.unique(made[ends[r] - sizes[r] : ends[r]])
                    n, key = len(elements), set_key(elements)
                    if key not in margins:
                        if n not in plans:
                            plans[n] = instances(n)
                        sigs, margins[key] = signatures(elements, plans[n])
                        for s in sigs:
                            pending.append(s)
                            owners.append(len(keys))
                            held += len(s)
                        keys.append(key)
                    columns["n"][r], columns["key"][r] = n, key
                    columns["own"][r], columns["across"][r] = margins[key]
                yield _batch(columns)
                if held > _FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _shared_signatures(batches):
    """mapInArrow function over one bucket: document rows pass, signatures become rows of the sets that share them."""
    trim()
    sigs, owners = [], []
    for batch in batches:
        is_doc = batch.column("sigs").is_null()
        if is_doc.true_count:
            yield batch.filter(is_doc)
        packed = batch.filter(pc.invert(is_doc))
        for low, owner, keys in zip(*(packed.column(c).to_pylist() for c in ("sigs", "owner", "keys"))):
            sigs.append(np.frombuffer(low, np.uint32))
            kind = np.uint16 if len(owner) == 2 * len(sigs[-1]) else np.uint32
            owners.append(np.frombuffer(keys, np.int64)[np.frombuffer(owner, kind)])
    if not sigs:
        return
    sigs, owners = np.concatenate(sigs), np.concatenate(owners)
    order = np.argsort(sigs)
    sigs = sigs[order]
    repeated = np.zeros(len(sigs), bool)
    repeated[1:] = sigs[1:] == sigs[:-1]
    repeated[:-1] |= repeated[1:]
    sigs, owners = sigs[repeated], owners[order[repeated]]
    order = np.lexsort((owners, sigs))
    sigs, owners = sigs[order], owners[order]
    fresh = np.ones(len(sigs), bool)
    fresh[1:] = (sigs[1:] != sigs[:-1]) | (owners[1:] != owners[:-1])
    sigs, owners = sigs[fresh], owners[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(sigs)))
    if not len(starts):
        return
    across = (sigs[starts] & 1).astype(bool)
    odd = np.add.reduceat(owners & 1, starts)
    useful = (sizes > 1) & (~across | ((odd > 0) & (odd < sizes)))
    starts, sizes, across = starts[useful], sizes[useful], across[useful]
    if not len(starts):
        return
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    owners = owners[place]
    starts = np.cumsum(sizes) - sizes
    lists = mix(np.add.reduceat(mix(owners.view(U64)), starts) + sizes.astype(U64))
    lists = ((lists & ~U64(1)) | across.astype(U64)).view(np.int64)
    lists, first, times = np.unique(lists, return_index=True, return_counts=True)
    for at in range(0, len(lists), 4096):
        columns = _empty(0)
        for gid, f, t in zip(lists[at : at + 4096].tolist(), first[at : at + 4096].tolist(), times[at : at + 4096].tolist()):
            members = owners[starts[f] : starts[f] + sizes[f]].tolist()
            for low in range(1, len(members), 1000):  # a large group goes in parts that all name its first member
                for name, value in (("gid", gid), ("size", len(members)), ("times", t), ("members", members[:1] + members[low : low + 1000])):
                    columns[name].append(value)
        n = len(columns["gid"])
        yield _batch({name: values or [None] * n for name, values in columns.items()})


def _bloom_slot():
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - _BLOOM_BITS)


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(key, elements) of the sets named by pairs(a, b): sorted hashes as bytes, from one document of each class.

    A class of rows without an id has a null ``doc_id``, found like any other; each task gives a set once. A Bloom filter of fixed size spares most other texts the work; the join settles which rows count.
    """
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = stored(classes.join(ends, "key").select("key", "doc_id"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, _bloom_slot(), _BLOOM_BITS))
    placed = docs.withColumn("slot", _bloom_slot())

    def sets(batches):
        trim()
        words, seen = Words(), set()
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((bits.value[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) == 1))
            flat, offsets = flat_text(batch.column("text"))
            for low, high in chunks(offsets):
                hashes, counts = words(flat, offsets[low : high + 1])
                made, sizes = shingles(hashes, counts, width)
                ends = np.cumsum(sizes)
                parts = [np.unique(made[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                found = []
                for doc_id, part in zip(batch.column("doc_id").slice(low, high - low).to_pylist(), parts):
                    name = (doc_id, set_key(part)) if len(part) else None
                    if name and name not in seen:
                        seen.add(name)
                        found.append((*name, part.tobytes()))
                columns = zip(*found) if found else ([], [], [])
                kinds = (pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "key", "elements"])

    made = placed.mapInArrow(sets, "doc_id long, key long, elements binary")
    same = (made["key"] == wanted["key"]) & made["doc_id"].eqNullSafe(wanted["doc_id"])
    return stored(made.join(wanted, same, "left_semi").dropDuplicates(["key"]).select("key", "elements"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * |A & B| >= percent * |A | B|."""
    joined = pairs.join(sets.select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b")
    joined = joined.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a").select("a", "b", "ea", "eb")

    def check(batches):
        trim()
        for batch in batches:
            keep = []
            for ea, eb in zip(batch.column("ea"), batch.column("eb")):
                x, y = np.frombuffer(ea.as_buffer(), U64), np.frombuffer(eb.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(check, "a long, b long")


def _open(member: DataFrame, labels: DataFrame) -> DataFrame:
    """member(gid, size, times, key) with the component of each key, of the groups with more than one component."""
    rows = member.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = rows.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gid")
    return rows.join(several, "gid")


def _family_links(
    member: DataFrame, bounds: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, homes) of the unsafe sets in hot groups, the links (a, b) inside the homes and (key, elements) of these sets.

    A set's homes are blocks of the largest group it is in and of those that come first in a few random
    orders, so sets with many groups in common share a home almost surely. Groups are cut at random
    into blocks of about ``BLOCK_ELEMENTS`` elements. In a home an inverted index gives the exact overlap of every pair;
    links that join what is apart so far are returned.
    """
    rows = member.where(F.col("size") > HOT).join(bounds.where("unsafe").select("key", "n"), "key")
    picks = [F.max_by("gid", F.struct("size", "gid"))] + [F.min_by("gid", F.xxhash64("gid", F.lit(i))) for i in range(HOMES - 1)]
    chosen = rows.groupBy("key").agg(F.first("n").alias("n"), F.array_distinct(F.array(*picks)).alias("gids"))
    chosen = stored(chosen.select("key", "n", F.explode("gids").alias("gid")), "picks")
    sizes = chosen.groupBy("gid").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = sizes.select("gid", F.ceil(F.col("elements") / BLOCK_ELEMENTS).alias("blocks"))
    chosen = chosen.join(sizes, "gid").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    chosen = stored(chosen.select("key", F.xxhash64("gid", "block").alias("home")), "families")
    sets = _sets_of(docs, classes, rows.select(F.col("key").alias("a"), F.col("key").alias("b")), width)

    def join(table: pa.Table) -> pa.Table:
        keys, label = table.column("key").to_numpy(), np.arange(len(table))
        parts = [np.frombuffer(x.as_buffer(), U64) for x in table.column("elements")]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        elements = np.concatenate(parts)
        order = np.argsort(elements, kind="stable")
        owner = np.repeat(np.arange(len(parts)), sizes)[order]
        elements = elements[order]
        a, b = [], []
        for i, part in enumerate(parts):
            low, high = np.searchsorted(elements, part, "left"), np.searchsorted(elements, part, "right")
            n = high - low
            place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.bincount(owner[place], minlength=len(parts))
            for j in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common)).tolist():
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    a.append(keys[i])
                    b.append(keys[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = stored(chosen.join(sets, "key").groupBy("home").applyInArrow(join, "a long, b long"), "links")
    return chosen.groupBy("key").agg(F.collect_set("home").alias("homes")), links, sets


def _slots(elements: np.ndarray) -> np.ndarray:
    return (mix(elements ^ _TAGS[66]) >> U64(64 - _SLOT_BITS)).astype(np.int64)


def _levels(sets: DataFrame) -> np.ndarray:
    """How many of sets(elements) have an element of each of 2**20 slots, as the number's length in bits.

    Tasks send packed counts of blocks of slots; only the lengths, a byte each, reach the driver.
    """
    width = (1 << _SLOT_BITS) // _SLOT_BLOCKS

    def count(batches):
        trim()
        total = np.zeros(1 << _SLOT_BITS, np.int64)
        for batch in batches:
            for x in batch.column("elements"):
                np.add.at(total, _slots(np.frombuffer(x.as_buffer(), U64)), 1)
        grid = total.reshape(_SLOT_BLOCKS, width)
        used = np.flatnonzero(grid.any(axis=1)).tolist()
        slots = [np.flatnonzero(grid[b]) for b in used]
        packed = [np.stack([at, grid[b, at]]).tobytes() for b, at in zip(used, slots)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                at, n = np.frombuffer(packed, np.int64).reshape(2, -1)
                totals.setdefault(block, np.zeros(width, np.int64))[at] += n
        lengths = [np.frexp(x.astype(float))[1].astype(np.uint8).tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(lengths, pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    table = sets.select("elements").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow()
    out = np.zeros((_SLOT_BLOCKS, width), np.uint8)
    for block, lengths in zip(table.column("block").to_pylist(), table.column("counts").to_pylist()):
        out[block] = np.frombuffer(lengths, np.uint8)
    return out.ravel()


def beginnings(elements: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, places) of a set: its first elements with the pair of bands, for each band of sizes similar sets can have.

    A place is twice the rank of the element, and one more where the set is the larger of a pair. In its own band a set is both.
    """
    n = len(elements)
    order = elements[np.lexsort((elements, levels[_slots(elements)]))]
    least, most = -(-3 * n // 4), 4 * n // 3
    own, low, high = (int(x) for x in np.searchsorted(_EDGES, [n, least, most], "right"))
    sigs, places = [], []
    for band, larger in [(b, True) for b in range(low, own + 1)] + [(b, False) for b in range(own, high + 1)]:
        partner = max(_EDGES[band - 1], least if larger else n)  # the smallest
        first = n - -(-3 * (n + partner) // 7) + 1
        tag = mix(np.array([min(own, band) << 16 | max(own, band)], U64) ^ _TAGS[67])
        sigs.append(mix(mix(order[:first]) ^ tag))
        places.append(2 * np.arange(first) + larger)
    return np.concatenate(sigs), np.concatenate(places)


def _second_level(sets: DataFrame, buckets: int) -> DataFrame:
    """(sig, key, place) of the second-level signatures that several components of sets(key, component, elements) share."""
    levels = sets.sparkSession.sparkContext.broadcast(_levels(sets))

    def sign(batches):
        trim()
        held, count = [], 0

        def flush():
            sigs, keys, components, places = (np.concatenate(x) for x in zip(*held))
            bucket = ((sigs >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            used, low = np.unique(bucket[order], return_index=True)
            rows = np.stack([sigs.view(np.int64), keys, components, places])[:, order]
            packed = [rows[:, a:b].tobytes() for a, b in zip(low.tolist(), [*low[1:].tolist(), len(order)])]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            for key, component, x in zip(batch.column("key").to_pylist(), batch.column("component").to_pylist(), batch.column("elements")):
                sigs, places = beginnings(np.frombuffer(x.as_buffer(), U64), levels.value)
                held.append((sigs, np.full(len(sigs), key), np.full(len(sigs), component), places))
                count += len(sigs)
                if count > _FLUSH_SECOND:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def shared(batches):
        trim()
        parts = [np.frombuffer(x, np.int64).reshape(4, -1) for batch in batches for x in batch.column("rows").to_pylist()]
        if not parts:
            return
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        sigs, _, components, places = rows
        starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        several, mixed = (np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts) for x in (components, places & 1))
        rows = rows[:, np.repeat(several & mixed, np.diff(np.append(starts, len(sigs))))]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[3])], names=["sig", "key", "place"])

    signed = sets.mapInArrow(sign, "bucket int, rows binary").repartitionById(buckets, F.col("bucket"))
    return signed.mapInArrow(shared, "sig long, key long, place long")


def jaccard_components(docs: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, set_key) of each row of ``docs`` with an integer ``key``.

    Rows are linked when their shingle sets have the given Jaccard similarity (75
    percent, for which the instances are made); the component is the smallest
    key reachable. A null or empty text, or one without words, has an empty set,
    a null ``set_key``, and is its own component. Rows with a null key take part; a
    component of them alone has a null id. Repeated rows give a row each.
    ``text_hash`` is Spark's xxhash64 of the text. Further columns are ignored.
    """
    return _linked(docs, key, text, width, percent).drop("set_component")


def _linked(docs: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """Rows of :func:`jaccard_components` with ``set_component``, a set key that names the component whatever the ids."""
    if percent != 75:
        raise ValueError("the size bands and differences hold for 75 percent")
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("carry"))
    buckets = 2 * partitions(spark)
    signed = docs.mapInArrow(_signed_documents(buckets, width), _SCHEMA).repartitionById(buckets, F.col("bucket"))
    shared = stored(
        signed.mapInArrow(_shared_signatures, _SCHEMA).select("doc_id", "carry", "n", "key", "own", "across", "gid", "size", "times", "members"), "shared"
    )
    rows = shared.where(F.col("gid").isNull()).select("doc_id", "carry", "n", "key", "own", "across")
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(*[F.min(c).alias(c) for c in ("doc_id", "n", "own", "across")])
    groups = shared.where(F.col("gid").isNotNull()).groupBy("gid", "size", "members").agg(F.sum("times").alias("times"))
    groups = stored(groups, "groups")

    # Agreements of a set in hot groups, which may leave it too few elsewhere. A group's lowest bit tells its
    # kind: of one band, or of two and then only for pairs of different bands.
    member = groups.select("gid", "size", "times", F.explode("members").alias("key")).distinct()
    two_bands = (F.col("gid") % 2 != 0)
    hot = member.where(F.col("size") > HOT).groupBy("key").agg(
        F.sum(F.when(~two_bands, F.col("times")).otherwise(0)).alias("hot_own"),
        F.sum(F.when(two_bands, F.col("times")).otherwise(0)).alias("hot_across"),
    )
    bounds = classes.select("key", "n", "own", "across").join(hot, "key", "left").fillna(0, ["hot_own", "hot_across"])
    bounds = bounds.withColumn("unsafe", (F.col("hot_own") >= F.col("own")) | (F.col("hot_across") >= F.col("across")) & (F.col("hot_across") > 0))
    bounds = stored(bounds, "bounds")

    # Families: sets of hot groups meet in blocks of the largest group they are in.
    homes, links, sets = _family_links(member, bounds, docs, classes, width, percent)
    labels = components(links)

    # One partner of another component for each set: the first member of the groups it shares most often.
    near = _open(member, labels)
    leader = near.groupBy("gid").agg(F.min(F.struct("key", "component")).alias("m")).select("gid", "m.*").toDF("gid", "a", "ca")
    stars = near.join(leader, "gid").where(F.col("component") != F.col("ca"))
    stars = stars.groupBy("a", F.col("key").alias("b")).agg(F.sum("times").alias("times"))
    partner = stars.groupBy("b").agg(F.max(F.struct("times", "a")).alias("m")).select("m.a", "b", "m.times")
    own = bounds.select(F.col("key").alias("b"), "own")
    # A weak partner is left to the pairs below.
    partner = stored(partner.join(own, "b").where(F.col("times") * 2 >= F.col("own")).select("a", "b"), "partner")
    links = links.union(stored(_verified(partner, _sets_of(docs, classes, partner, width), percent), "links"))
    labels = components(links)

    # All pairs of different components that still share a signature outside hot groups. Similar sets
    # agree in as many ranges as their bounds say, at most as many of them dropped as either has hot ones.
    left = _open(member, labels).join(bounds.drop("unsafe"), "key").join(homes, "key", "left")
    left = left.select(
        "gid", "size", "times", "key", "component", "n", "homes", F.when(two_bands, F.col("across")).otherwise(F.col("own")).alias("bound"),
        F.when(two_bands, F.col("hot_across")).otherwise(F.col("hot_own")).alias("hot"),
    )
    left = stored(left.where((F.col("size") <= HOT) | (F.col("hot") >= F.col("bound"))), "members")
    one, two = (left.where(F.col("size") <= HOT).alias(side) for side in ("one", "two"))
    same_band = F.col("one.key").bitwiseAND(1) == F.col("two.key").bitwiseAND(1)
    apart = (
        (F.col("one.component") != F.col("two.component")) & F.coalesce(~F.arrays_overlap("one.homes", "two.homes"), F.lit(True))
        & (4 * F.col("one.n") >= 3 * F.col("two.n")) & (4 * F.col("two.n") >= 3 * F.col("one.n"))
    )
    pair = (F.col("one.gid") == F.col("two.gid")) & (F.col("one.key") < F.col("two.key")) & apart & ((F.col("one.gid") % 2 == 0) == same_band)
    least = F.greatest("one.bound", "two.bound") - F.least("one.hot", "two.hot")
    cross = one.join(two, pair).groupBy(F.col("one.key").alias("a"), F.col("two.key").alias("b"))
    cross = cross.agg(F.sum("one.times").alias("times"), F.max(least).alias("least")).where("times >= least").select("a", "b")

    # Pairs that may share hot groups alone, of two sets without enough other ranges, share a second-level signature.
    hot_sets = left.where(F.col("size") > HOT).groupBy("key").agg(*[F.first(c).alias(c) for c in ("component", "n", "homes")])
    second = _second_level(stored(hot_sets.join(sets, "key").select("key", "component", "elements"), "hot_sets"), buckets)
    second = stored(second.join(hot_sets, "key").withColumn("rank", F.shiftright("place", 1)), "second")
    one, two = (second.where(F.col("place") % 2 == larger).alias(side) for side, larger in (("one", 0), ("two", 1)))
    in_common = 3 * (F.col("one.n") + F.col("two.n"))  # a seventh of it, at least
    met = (
        (F.col("one.sig") == F.col("two.sig")) & (F.struct("one.n", "one.key") < F.struct("two.n", "two.key")) & apart
        & (7 * (F.col("one.n") - F.col("one.rank")) >= in_common) & (7 * (F.col("two.n") - F.col("two.rank")) >= in_common)
    )
    ends = [f("one.key", "two.key").alias(name) for f, name in ((F.least, "a"), (F.greatest, "b"))]
    cross = stored(cross.union(one.join(two, met).select(*ends)).distinct(), "cross")
    links = stored(links.union(_verified(cross, _sets_of(docs, classes, cross, width), percent)), "links")
    labels = components(links)

    first = labels.join(classes, "key").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = labels.join(first, "component").select("key", "component_id", "component")
    of_class = classes.select("key", "doc_id").join(of_class, "key", "left").select(
        "key", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "key").alias("component")
    )
    return rows.join(of_class, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("carry").alias("text_hash"), F.col("key").alias("set_key"), F.col("component").alias("set_component"),
    )


def one_of_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row of each component left, that of the smallest key; rows with empty sets all stay.

    Where a key repeats, the row with the smaller text hash stays, and one of
    equal rows; a row with a null key stays only in a group without other keys. Columns are those of ``docs``.
    """
    found = _linked(docs, key, text)
    linked = found.where(F.col("set_key").isNotNull())
    # A null component id stands for all components of rows with null keys only.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("set_component")))
    first = linked.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("r"))
    stay = first.select("r.doc_id", "r.text_hash", F.lit(True).alias("once"))
    empty = found.where(F.col("set_key").isNull()).select("doc_id", "text_hash", F.lit(False).alias("once")).distinct()
    stay = stay.union(empty).toDF("_id", "_hash", "_once")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = own.withColumns({"_id": F.col(f"_row.`{key}`").cast("long"), "_hash": F.xxhash64(F.col(f"_row.`{text}`"))})
    same = own["_id"].eqNullSafe(stay["_id"]) & (own["_hash"] == stay["_hash"])
    kept = own.join(stay, same).select("_row", own["_id"], own["_hash"], "_once")
    place = F.row_number().over(W.partitionBy("_hash", "_id").orderBy(F.xxhash64("_row")))
    return kept.withColumn("_place", place).where((F.col("_place") == 1) | ~F.col("_once")).select("_row.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by Jaccard similarity of 75 percent of their 5-word shingles."""
    return jaccard_components(read_table(spark, sf_dir, "documents"), "doc_id", "text")
