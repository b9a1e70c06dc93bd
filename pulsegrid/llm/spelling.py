"""Spelling variant grouping (operator 13) over permuterm rotations.

A word marked with a terminator has as many rotations as characters. Two words
that differ in one replaced character have rotations that agree in all but the
last character; a word that lacks that character has the common prefix itself
as a rotation. So every rotation is filed under its prefix without the last
character ("skip" rows) and every whole rotation under itself ("full" rows).
Rows are sorted by that key, groups are scanned in numpy, and each member gets
how many neighbours the group gives it and the best of them. A skip row is one
word for each character of the alphabet, so a group never grows with the data.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.store import read_table, stored

#: Mark of a word's end; no word may hold it.
END = "\x00"
#: Keys beyond so many characters are filed under a digest, so that rows of a long word stay short.
LONG_KEY = 64
#: Words a task counts before it passes them on.
KEPT_WORDS = 200_000
ROWS = 1 << 16
#: What a row of the query deletes a character for: the checksum of document and word is a multiple of this.
EDIT_EVERY = 31


def count_words(docs: DataFrame, doc_id: str, text: str, least_length: int = 7, edit_every: int | None = None) -> DataFrame:
    """(word, n) of the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z in lower case.

    Words shorter than ``least_length`` code points are left out. With
    ``edit_every``, h is the unsigned CRC-32 of ``<doc_id>:<run>``, and where it
    is a multiple of ``edit_every`` the run loses its code point h % length.
    A null text has no words; a null id counts as empty text. Repeated rows
    count as often as they occur.
    """
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"))
    run = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least_length))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                if not value:
                    continue
                lowered = value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                found = Counter(m[0] for m in run.finditer(lowered))
                if edit_every is None:
                    seen.update(found)
                else:
                    start = zlib.crc32(f"{key}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % edit_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        seen[word] += n
                if len(seen) > KEPT_WORDS:
                    yield from _counted(seen)
                    seen = Counter()
        yield from _counted(seen)

    return rows.mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    words, counts = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
    for low in range(0, len(words), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(words[low : low + ROWS]), pa.array(counts[low : low + ROWS])], names=["word", "n"])


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``no``, the word's place in code-point order, from 0.

    Words are sorted by range; one row per partition carries the places before it.
    """

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(before, before + n))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=["word", "n", "part", "pos"])
            before += n

    by_range = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    placed = stored(by_range.mapInArrow(places, "word string, n long, part int, pos long"), "spelling-words")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return placed.join(starts, "part").select((F.col("first") + F.col("pos")).alias("no"), "word", "n")


def _key(rotation: str) -> str:
    if len(rotation) <= LONG_KEY:
        return rotation
    return END * 2 + hashlib.blake2b(rotation.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def rotations(words: DataFrame) -> DataFrame:
    """(key, full, first, no, n): every rotation of every word under itself and under all but its last character.

    ``first`` marks the first of equal characters in a row: deleting any of
    them gives the same word, which must count once.
    """

    def rotate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        full: list[bool] = []
        first: list[bool] = []
        nos: list[int] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(full, pa.bool_()), pa.array(first, pa.bool_()), pa.array(nos, pa.int64()), pa.array(counts, pa.int64())],
                names=["key", "full", "first", "no", "n"],
            )
            for column in (keys, full, first, nos, counts):
                column.clear()
            return out

        for batch in batches:
            for no, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                before = ""
                for at, char in enumerate(word):
                    head = word[:at]
                    keys += (_key(word[at + 1 :] + END + head), _key(word[at:] + END + head))
                    full += (False, True)
                    first += (char != before, True)
                    nos += (no, no)
                    counts += (n, n)
                    before = char
                    if len(keys) >= ROWS:
                        yield flush()
                keys.append(_key(END + word))
                full.append(True)
                first.append(True)
                nos.append(no)
                counts.append(n)
        if keys:
            yield flush()

    return words.select("no", "word", "n").mapInArrow(rotate, "key string, full boolean, first boolean, no long, n long")


def _scan(full: np.ndarray, first: np.ndarray, no: np.ndarray, n: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(no, neighbours in the group, n and no of the best of them) of the rows that have any; groups have two rows or more."""
    order = np.lexsort((no, -n, full, group))  # skip rows first, the best ahead
    full, first, no, n, group = full[order], first[order], no[order], n[order], group[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
    skips = np.add.reduceat((~full).astype(np.int64), starts)
    row = np.arange(len(group))
    whole = np.full(len(starts), -1)
    whole[of[full]] = row[full]
    firsts = np.add.reduceat((~full & first).astype(np.int64), starts)
    lead = np.minimum.reduceat(np.where(~full & first, row, len(group)), starts)  # the best of those that lose their character into the whole word

    neighbours = np.where(full, firsts[of], skips[of] - 1 + (first & (whole[of] >= 0)))
    top = starts[of] + (row == starts[of])  # the best other skip row
    best = np.where(skips[of] > 1, top, -1)
    other = np.where(first, whole[of], -1)
    better = (other >= 0) & ((best < 0) | (n[other] > n[best]) | ((n[other] == n[best]) & (no[other] < no[best])))
    best = np.where(better, other, best)
    best = np.where(full, lead[of], best)
    keep = neighbours > 0
    return no[keep], neighbours[keep], n[best[keep]], no[best[keep]]


def neighbours(words: DataFrame) -> DataFrame:
    """(no, n_near, best_n, best_no) of the words of (no, word, n) that differ from another by exactly one
    inserted, deleted or replaced code point; the best is that of largest n, on ties of least no."""
    sorted_rows = rotations(words).repartition("key").sortWithinPartitions("key")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if open_ is None else pa.concat_tables([open_, table]).combine_chunks()
            if not table.num_rows:
                continue
            keys = table.column("key").combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1])
            open_ = table.slice(int(starts[-1]))  # the last group may go on in the next batch
            yield from found(table.slice(0, int(starts[-1])), starts[:-1])
        if open_ is not None:
            yield from found(open_, np.zeros(1, np.int64))

    def found(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, table.num_rows))
        group = np.repeat(np.arange(len(starts)), sizes)
        many = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        if not len(many):
            return
        columns = [table.column(c).to_numpy()[many] for c in ("full", "first", "no", "n")]
        out = _scan(*columns, group[many])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["no", "near", "best_n", "best_no"])

    parts = sorted_rows.mapInArrow(scan, "no long, near long, best_n long, best_no long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best_no"))
    return parts.groupBy("no").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "no", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.best_no").alias("best_no")
    )


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """Forms and roots of the words of (word, n), one row per distinct word.

    A word's form is its near word of largest n (ties: smallest in code-point
    order) if that n is at least ``factor`` times the word's; forms are
    followed to the last, the root. Returns (word, form, root, n, n_near,
    form_n). ``words`` must hold each word once, without nulls and without
    U+0000; the empty word has near words of one code point. An empty table
    gives an empty one. As n grows by ``factor`` at each step, chains are
    short and pointer doubling ends within a few rounds.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, else forms could lead in circles")
    words = stored(numbered(words), "spelling-numbered")
    near = stored(neighbours(words).join(words.select("no", "n"), "no"), "spelling-near")
    forms = near.where(F.col("best_n") >= F.lit(factor) * F.col("n")).select("no", F.col("best_no").alias("form_no"), F.col("best_n").alias("form_n"))
    roots = stored(forms.select("no", F.col("form_no").alias("root_no")), "spelling-roots")
    while True:
        further = roots.select(F.col("no").alias("root_no"), F.col("root_no").alias("next"))
        stepped = stored(roots.join(further, "root_no", "left").select("no", F.coalesce("next", "root_no").alias("root_no"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = stepped.select("no", "root_no")
        if stepped.where("moved").isEmpty():
            break
    text = words.select("no", "word")
    linked = forms.join(roots, "no")
    linked = linked.join(text.select(F.col("no").alias("form_no"), F.col("word").alias("form")), "form_no")
    linked = linked.join(text.select(F.col("no").alias("root_no"), F.col("word").alias("root")), "root_no")
    out = words.join(near.select("no", "n_near"), "no", "left").join(linked.select("no", "form", "root", "form_n"), "no", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant groups of the words of documents, of at least 7 code points and 2 occurrences."""
    counts = count_words(read_table(spark, sf_dir, "documents"), "doc_id", "text", 7, EDIT_EVERY)
    return variants(stored(counts.where("n >= 2"), "spelling-counts"))
