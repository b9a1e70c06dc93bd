"""Arrow batches as flat numpy arrays, and hashes of words in them.

Texts stay in Arrow's own layout: one byte array and the offsets of the rows.
Chunks hold whole texts, so nothing below ever sees a prefix; a chunk has
about ``CHUNK_BYTES`` unless a single text is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], added: list[tuple[str, T.DataType]]) -> DataFrame:
    """``df`` with the columns ``added``, which ``fn`` gives for each Arrow batch as {name: values}.

    Columns of ``df`` with these names are replaced.
    """
    names = {name for name, _ in added}
    kept = [c for c in df.columns if c not in names]
    fields = [df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind in added]
    kinds = {name: _arrow_type(kind) for name, kind in added}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(new[name], type=kinds[name]) for name in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *kinds])

    return df.mapInArrow(run, T.StructType(fields))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
        T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[type(kind)]


def trim() -> None:
    """Gives memory back to the system that this worker's earlier tasks freed but still hold."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes; each text is whole."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 2**64)


class RangeHash:
    """Hash of any range of a flat array, equal for equal content wherever it stands.

    Prefix sums of value * base**i; a range's difference is divided by
    base**start, which is possible modulo 2**64 because the base is odd.
    """

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, U64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            self.powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, _BASE, U64))])
            self.inverses = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, _BASE_INVERSE, U64))])
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverses[starts] + (ends - starts).astype(U64))


class PrimeRangeHash:
    """Hash of ranges like :class:`RangeHash`, but modulo two primes.

    Modulo 2**64 words such as the Thue-Morse word and its complement have
    equal hashes for every base; modulo a prime they do not. Each prime is
    below 2**31, so products of two residues and sums of 2**32 of them fit 64 bits.
    """

    PRIMES = (2147483647, 2147483629)
    BASES = (911382323, 972663749)

    def __init__(self) -> None:
        self.powers = [np.ones(1, U64) for _ in self.PRIMES]
        self.inverses = [np.ones(1, U64) for _ in self.PRIMES]

    def prefix(self, values: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, prime in enumerate(self.PRIMES):
            if len(self.powers[k]) < len(values) + 1:
                n = max(len(values) + 1, 1 << 16)
                self.powers[k], self.inverses[k] = (_powers(base, n, prime) for base in (self.BASES[k], pow(self.BASES[k], -1, prime)))
            total = np.zeros(len(values) + 1, U64)
            np.cumsum(values % U64(prime) * self.powers[k][: len(values)] % U64(prime), out=total[1:])
            out.append(total)
        return out

    def ranges(self, prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        parts = [(p[ends] - p[starts]) % U64(prime) * self.inverses[k][starts] % U64(prime) for k, (p, prime) in enumerate(zip(prefix, self.PRIMES))]
        return mix(((parts[0] << U64(32)) | parts[1]) ^ mix((ends - starts).astype(U64)))


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo ``prime``, by doubling."""
    out = np.ones(n, U64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * U64(pow(base, filled, prime)) % U64(prime)
        filled += step
    return out


# White space of the word rule, bytes 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A random number for each byte, the same for A-Z and a-z.
BYTE = numbers(256, 1)[_LOWER]


def word_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs without ASCII white space in rows that begin at the offsets ``at``."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Word hashes of whole texts: A-Z lower-cased, words are runs without ASCII white space."""

    def __init__(self) -> None:
        self.hasher = RangeHash()

    def __call__(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words of each row) of the rows that ``offsets`` cut from ``flat``."""
        data = flat[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, U64), np.zeros(len(at) - 1, np.int64)
        starts, ends = word_ranges(data, at)
        hashes = self.hasher.ranges(self.hasher.prefix(BYTE[data]), starts, ends)
        counts = np.diff(np.searchsorted(starts, at))
        return hashes, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, number of runs of each row); a shorter row gives its whole sequence as one."""
    if not len(hashes):
        return np.zeros(0, U64), np.zeros(len(counts), np.int64)
    weights = numbers(size, 2) | U64(1)
    starts = np.cumsum(counts) - counts
    n = len(hashes)
    total = np.zeros(n, U64)
    padded = np.concatenate([hashes, np.zeros(size - 1, U64)])
    room = np.repeat(starts + counts, counts) - np.arange(n)
    for j in range(size):
        step = padded[j : j + n] * weights[j]
        if j:
            step[room <= j] = 0
        total += step
    short = counts < size
    made = np.where(short, np.minimum(counts, 1), counts - size + 1)
    keep = np.repeat(made, counts) > np.arange(n) - np.repeat(starts, counts)
    lengths = np.repeat(np.minimum(counts, size), counts)
    return mix(total[keep] + lengths[keep].astype(U64) * U64(0x9E3779B97F4A7C15)), made
