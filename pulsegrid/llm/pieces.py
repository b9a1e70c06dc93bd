"""SentencePiece BPE encoding and decoding (operator 6) by vectorised merge rounds.

A text is cut before every space mark that follows another character; no piece
of the vocabulary reaches over such a cut, so the words merge on their own.
The distinct words of a chunk lie in flat symbol arrays. Each round finds the
least pair rank of every word (segmented minimum), merges its occurrences from
the left, and compacts; words without a pair leave. Finished words are kept in
a bounded table per task, because most words of a text were seen before.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pulsegrid.llm.batches import PrimeRangeHash, U64, chunks, flat_text, map_batches, mix, trim
from pulsegrid.llm.store import read_table

MARK = "▁"
NO_RANK = np.int32(2**31 - 1)
#: Words a task keeps; the table starts anew beyond it.
KEPT_WORDS = 1 << 20
CHARS = 1 << 20

# Field numbers of the model file and kinds of pieces in it.
F_PIECE, F_TRAINER, F_NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        width = {0: 0, 1: 8, 5: 4}.get(tag & 7)
        if width == 0:
            yield tag >> 3, varint()
            continue
        if width is None:
            width = varint()
        yield tag >> 3, data[at : at + width]
        at += width


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file; small enough to broadcast (its pieces, no data)."""

    surface: list[bytes]  # UTF-8 of each id when decoded, the mark as a space
    char_ids: dict[int, int]  # code point -> id of the piece of one character
    byte_ids: list[int]
    keys: np.ndarray  # slots of an open-addressing table: left id * size + right id, or -1
    ranks: np.ndarray
    merged: np.ndarray
    unknown_id: int

    @property
    def size(self) -> int:
        return len(self.surface)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - bits)).astype(np.int64)


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a BPE model file with byte fallback and no text normalization."""
    with open(path, "rb") as file:
        top = list(_fields(file.read()))
    trainer, normalizer = (dict(_fields(next(v for f, v in top if f == n))) for n in (F_TRAINER, F_NORMALIZER))
    if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1):
        raise ValueError("only BPE models with byte fallback and an identity normalizer that keeps white space")
    if not normalizer.get(3, 1) or not normalizer.get(5, 1):
        raise ValueError("only models with a dummy prefix and escaped white space")
    pieces = []
    for field, value in top:
        if field == F_PIECE:
            entry = dict(_fields(value))
            pieces.append((entry[1].decode(), struct.unpack("<f", entry.get(2, b"\0" * 4))[0], entry.get(3, NORMAL)))
    if any(kind in (USER, UNUSED) for _, _, kind in pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("pieces that reach over a space are not supported")
    surface, byte_ids = [], [0] * 256
    for i, (piece, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        else:
            surface.append({CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece.replace(MARK, " ")).encode())
    scores = sorted({score for p, score, _ in pieces if p in ids}, reverse=True)
    rank_of = {score: rank for rank, score in enumerate(scores)}
    pairs = {}
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left * len(pieces) + right] = (rank_of[pieces[i][1]], i)
    bits = max(10, (4 * len(pairs)).bit_length())
    keys, ranks, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK), np.zeros(1 << bits, np.int32)
    wanted = np.fromiter(pairs, np.int64, len(pairs))
    for key, at in zip(wanted.tolist(), _slot(wanted, bits).tolist()):
        while keys[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        keys[at] = key
        ranks[at], merged[at] = pairs[key]
    chars = {ord(p): i for p, i in ids.items() if len(p) == 1}
    unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
    return Vocabulary(surface, chars, byte_ids, keys, ranks, merged, unknown)


class Merger:
    """Encodes many words at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.bits = len(vocabulary.keys).bit_length() - 1
        self.plane = np.arange(0x110000, dtype=np.int32) + vocabulary.size  # unknown characters stand for themselves
        for char, i in vocabulary.char_ids.items():
            self.plane[char] = i

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NO_RANK where they don't merge."""
        size = self.v.size
        keys = left.astype(np.int64) * size + right
        keys[(left >= size) | (right >= size)] = -2
        at = _slot(keys, self.bits)
        open_ = np.arange(len(keys))
        ranks, merged = np.full(len(keys), NO_RANK), np.zeros(len(keys), np.int32)
        while len(open_):
            slots = at[open_]
            there = self.v.keys[slots]
            hit = there == keys[open_]
            ranks[open_[hit]], merged[open_[hit]] = self.v.ranks[slots[hit]], self.v.merged[slots[hit]]
            open_ = open_[~hit & (there >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return ranks, merged

    def _ranked(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranks, merged = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int32)
        at = np.flatnonzero(word[:-1] == word[1:])
        ranks[at], merged[at] = self.pair(symbols[at], symbols[at + 1])
        return ranks, merged

    def merge(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(final symbols of all words, symbols of each word) of words given as code points; lengths are positive."""
        symbols, word = self.plane[codes], np.repeat(np.arange(len(lengths)), lengths)
        ranks, merged = self._ranked(symbols, word)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            live = least < NO_RANK
            if not live.all():
                done.append((word[~live], symbols[~live]))
                symbols, word, ranks, merged, least = (x[live] for x in (symbols, word, ranks, merged, least))
                if not len(symbols):
                    break
            chosen = self._leftmost(symbols, word, ranks, merged, least)
            symbols[chosen] = merged[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            place = np.cumsum(keep) - 1
            fresh = place[chosen]
            symbols, word, ranks, merged = (x[keep] for x in (symbols, word, ranks, merged))
            fresh = np.unique(np.concatenate([fresh, np.maximum(fresh - 1, 0)]))
            ranks[fresh], merged[fresh] = NO_RANK, 0
            fresh = fresh[fresh < len(symbols) - 1]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            ranks[fresh], merged[fresh] = self.pair(symbols[fresh], symbols[fresh + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(lengths))

    def _leftmost(self, symbols, word, ranks, merged, least) -> np.ndarray:
        """Places of the pairs of least rank that merge in this round.

        All occurrences in a word, taken from the left without overlap, merge
        at once, unless one of them would make a pair of the same or a better
        rank, which one merge at a time would take first: then only the first.
        """
        at = np.flatnonzero(ranks == least)
        runs = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        inside = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
        at = at[inside % 2 == 0]
        same = word[at[1:]] == word[at[:-1]]
        many = np.zeros(len(at), bool)
        many[1:] |= same
        many[:-1] |= same
        some = np.flatnonzero(many)
        if not len(some):
            return at
        spot, n = at[some], len(symbols)
        new, limit = merged[spot], least[spot]
        right = np.minimum(spot + 2, n - 1)
        risk = (spot + 2 < n) & (word[right] == word[spot]) & (self.pair(new, symbols[right])[0] <= limit)
        before = np.maximum(spot - 1, 0)
        left = symbols[before]
        previous = np.zeros(len(spot), bool)
        previous[1:] = spot[1:] - spot[:-1] == 2
        left = np.where(previous, merged[np.maximum(spot - 2, 0)], left)
        risk |= (spot >= 1) & (word[before] == word[spot]) & (self.pair(left, new)[0] <= limit)
        if not risk.any():
            return at
        risky = np.unique(word[spot[risk]])
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        return at[first | ~np.isin(word[at], risky)]

    def ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids: an unknown character becomes the ids of its UTF-8 bytes."""
        unknown = np.flatnonzero(symbols >= self.v.size)
        if not len(unknown):
            return symbols, sizes
        width = np.ones(len(symbols), np.int64)
        encoded = [[self.v.byte_ids[b] for b in chr(s - self.v.size).encode("utf-8", "surrogatepass")] for s in symbols[unknown].tolist()]
        width[unknown] = [len(x) for x in encoded]
        ends = np.cumsum(width)
        out = np.repeat(symbols, width)
        for u, values in zip(unknown.tolist(), encoded):
            out[ends[u] - len(values) : ends[u]] = values
        edges = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], ends])
        return out, np.diff(total[edges])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Texts to ids and ids to texts, word by word; one per task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.merger = Merger(vocabulary)
        self.hasher = PrimeRangeHash()
        size = vocabulary.size
        self.digits = np.zeros((size, len(str(size)) + 1), np.uint8)  # each id in decimal and a comma
        for i in range(size):
            text = f"{i},".encode()
            self.digits[i, : len(text)] = np.frombuffer(text, np.uint8)
        self.surface = np.frombuffer(b"".join(vocabulary.surface), np.uint8)
        self.surface_size = np.fromiter(map(len, vocabulary.surface), np.int64, size)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, U64)  # sorted hashes of words, and for each the word's ids as a range of flat_ids
        self.start = self.count = np.zeros(0, np.int64)
        self.flat_ids = np.zeros(0, np.int32)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        mark = flat == ord(MARK)
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(flat))
        hashes = self.hasher.ranges(self.hasher.prefix(mix(flat.astype(U64) + U64(1))), starts, stops)
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != distinct[inside]
        if missing.any():
            low, length = starts[example[missing]], (stops - starts)[example[missing]]
            ids, counts = self.merger.ids(*self.merger.merge(flat[_spread(low, length)], length))
            begins = np.cumsum(counts) - counts + len(self.flat_ids)
            self.flat_ids = np.concatenate([self.flat_ids, ids])
            spot = at[missing]
            self.start, self.count = np.insert(self.start, spot, begins), np.insert(self.count, spot, counts)
            self.known = np.insert(self.known, spot, distinct[missing])
            at = np.searchsorted(self.known, distinct)
        entry = at[inverse]
        counts = self.count[entry]
        out = self.flat_ids[_spread(self.start[entry], counts)]
        per_word = np.concatenate([[0], np.cumsum(counts)])
        per_text = per_word[np.searchsorted(starts, ends)]
        return out, np.diff(per_text, prepend=0)

    def encode(self, text: str) -> list[int]:
        return self.tokens([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are not UTF-8 become U+FFFD one by one.

        The space of a leading piece is the dummy prefix and goes; a byte or the unknown piece has none.
        """
        first = next((i for i in ids if self.v.surface[i]), None)
        prefixed = first is not None and first != self.v.unknown_id and first not in self.v.byte_ids
        return _as_text(b"".join([self.v.surface[i] for i in ids]), prefixed)

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Token counts, hashes of the ids and of the texts decoded from them."""
        ids, counts = self.tokens(texts)
        rows = self.digits[ids]
        used = rows > 0
        decimal = rows[used].tobytes()
        decimal_ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
        width = self.surface_size[ids]
        surface = self.surface[_spread(self.surface_start[ids], width)].tobytes()
        surface_ends = np.concatenate([[0], np.cumsum(width)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        d, s = decimal_ends[edges].tolist(), surface_ends[edges].tolist()
        ids_hash = [hashlib.sha256(decimal[a : max(a, b - 1)]).hexdigest() for a, b in zip(d, d[1:])]
        text_hash = [hashlib.sha256(_as_text(surface[a:b]).encode()).hexdigest() for a, b in zip(s, s[1:])]
        return counts.tolist(), ids_hash, text_hash


def _as_text(surface: bytes, prefixed: bool = True) -> str:
    """Decoded surface without the dummy prefix."""
    if prefixed and surface.startswith(b" "):
        surface = surface[1:]
    try:
        return surface.decode()
    except UnicodeDecodeError:
        return _lenient(surface)


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


def encode_digests(docs: DataFrame, text: str, model_path: str) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the whole ``text``.

    A null text counts as empty: no tokens, hashes of the empty string. Columns
    of these names are replaced. The model file is read on the driver only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(read_vocabulary(model_path)))
    state: dict = {}

    def digests(batch: pa.RecordBatch) -> dict:
        if "encoder" not in state:
            trim()
            state["encoder"] = Encoder(Vocabulary(*shared.value))
        encoder = state["encoder"]
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = flat_text(column)
        column = pc.fill_null(column, "")
        parts = [encoder.digests(column.slice(a, b - a).to_pylist()) for a, b in chunks(offsets, CHARS)]
        columns = [sum(x, []) for x in zip(*parts)] if parts else [[], [], []]
        return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), columns))

    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_batches(docs, digests, added)


def encode_ids(docs: DataFrame, text: str, model_path: str) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole ``text``; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(read_vocabulary(model_path)))
    state: dict = {}

    def ids(batch: pa.RecordBatch) -> dict:
        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(Vocabulary(*shared.value)))
        column = batch.column(batch.schema.get_field_index(text))
        return {"ids": [encoder.encode(t or "") for t in column.to_pylist()]}

    return map_batches(docs, ids, [("ids", T.ArrayType(T.IntegerType()))])


def decode_ids(rows: DataFrame, ids: str, model_path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of the token ids; null counts as no ids."""
    shared = rows.sparkSession.sparkContext.broadcast(astuple(read_vocabulary(model_path)))
    state: dict = {}

    def texts(batch: pa.RecordBatch) -> dict:
        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(Vocabulary(*shared.value)))
        column = batch.column(batch.schema.get_field_index(ids))
        return {"decoded": [encoder.decode(x or []) for x in column.to_pylist()]}

    return map_batches(rows, texts, [("decoded", T.StringType())])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through the 32k BPE model and back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, "text", default_model()).drop("text")
