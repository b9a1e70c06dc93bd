"""Packing: ids against the library, pieces put together again, the program against exhaustive search."""

import itertools
import random
import zlib
from collections import defaultdict

import edge_tables
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(open(packing.default_tokenizer(), encoding="utf-8").read())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def held(library, documents, rows, limit=2048):
    """Every id in one piece, sequences gapless and none padded; returns how many documents were cut without need."""
    pieces, sequences, cut = defaultdict(list), defaultdict(list), 0
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(list)
    for doc_id, text in documents:
        wanted[doc_id].append(ids_of(library, text))
    assert set(pieces) == set(wanted)
    for doc_id, texts in wanted.items():
        found = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in pieces[doc_id])
        if len(texts) == 1:
            at = 0
            for total, start, length, crc in found:
                assert total == len(texts[0]) and start == at and crc == zlib.crc32(texts[0][at : at + length].tobytes())
                at += length
            assert at == len(texts[0])
            cut += len(found) > -(-at // limit)
        else:
            assert sum(f[2] for f in found) == sum(map(len, texts))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == limit or (at < limit and at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    return cut


def test_ids_equal_the_library(library, encoder):
    rng = random.Random(2)
    kinds = ["abcXYZ", "éÀßµªº²½×÷ÿ", " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0", "'sStTdDlLmMvVrReE'", "0123456789", ".,;!?-_<|>/", "ΣσςİıǅŒœ", "日本語🙂", "é̈‍", "\x00\x01\xad"]
    texts = ["".join(rng.choices(rng.choice(kinds) + rng.choice(kinds) + "  ", k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "<|endoftext|> x<|startoftext|>y", "I'll we'VE 'S don't", "</w> a</w>", " ".join("ab<|cd" for _ in range(5))]
    flat, counts = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, count in zip(texts, ends, counts):
        assert flat[end - count : end].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_read_in_parts(library, encoder, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 64)
    monkeypatch.setattr(packing, "KEPT_WORDS", 10)
    texts = [edge_tables.words(4, 200), None, "x" * 300, "", "a  b " * 50]
    got = defaultdict(list)
    for first, found, parts in packing._portions(pa.array([t or "" for t in texts])):
        flat, counts = encoder.encode(found)
        for at, part in enumerate(np.split(flat, np.cumsum(counts)[:-1])):
            got[first if parts else first + at] += part.tolist()
    assert [got[i] for i in range(5)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = packing.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = ["two  words", "", " é'll"]
    flat, counts = encoder.encode(pa.array(texts))
    assert not encoder.by_word and [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_knapsack_against_all_patterns():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes, most, values = rng.integers(1, 12, 4), rng.integers(1, 5, 4), rng.random(4)
        best = max(values @ p for p in map(np.array, itertools.product(*(range(m + 1) for m in most))) if sizes @ p <= 20)
        pattern = packing.best_patterns(sizes, values, most, 20)[0]
        assert sizes @ pattern <= 20 and (pattern <= most).all() and abs(values @ pattern - best) < 1e-9


def test_program_is_near_its_bound():
    rng = np.random.default_rng(7)
    for low, high, n in ((1, 100, 5000), (30, 60, 800), (40, 99, 300)):
        counts = np.bincount(rng.integers(low, high, n), minlength=100)
        sizes = np.flatnonzero(counts)
        patterns, used = packing.column_generation(sizes, counts[sizes], 100)
        assert np.allclose(patterns.T @ used, counts[sizes], atol=1e-5) and (patterns @ sizes <= 100).all()
        # No prices may value any pattern above 1; those of the last basis, scaled, prove a lower bound.
        prices = packing._inverted(patterns.astype(float)).sum(axis=1)
        bound = prices @ counts[sizes] / max(1.0, prices @ packing.best_patterns(sizes, prices, counts[sizes], 100)[0])
        assert used.sum() <= max(bound, sizes @ counts[sizes] / 100) * (1 + 2 * packing.GAP) + 1e-6


@pytest.mark.parametrize("limit", [64, 100, 2048])
def test_plans_place_every_rest_once(limit, monkeypatch):
    monkeypatch.setattr(packing, "CLASSES", 20)
    rng = np.random.default_rng(limit)
    shapes = [rng.integers(0, 30, limit), np.zeros(limit, int), np.where(np.arange(limit) == limit * 3 // 4, 50, 0), np.where(np.arange(limit) == 1, 999, 0), rng.integers(0, 2, limit)]
    for counts in shapes:
        plan = packing.make_plan(counts, 3, limit)
        places, cut = defaultdict(list), 0
        for length in range(1, limit):
            for rank in range(int(counts[length])):
                s = np.searchsorted(plan.key, (length << packing.RANK_BITS) | rank, "right") - 1
                ahead = rank - plan.first[s]
                if plan.sequence[s] >= 0:
                    places[plan.sequence[s] + ahead].append((plan.offset[s], length))
                else:
                    pieces = list(packing._line_pieces(plan, int(plan.offset[s] + ahead * length), length))
                    assert sum(p[1] for p in pieces) == length
                    cut += len(pieces) > 1
                    for _, size, sequence, offset in pieces:
                        places[sequence].append((offset, size))
        assert sorted(places) == list(range(3, plan.sequences))
        for parts in places.values():
            ends = np.cumsum([size for _, size in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == limit or ends[-1] & (ends[-1] - 1) == 0)
        total = int(np.arange(limit) @ np.where(np.arange(limit), counts, 0))
        assert len(places) <= -(-total // limit) + limit.bit_length()
        if counts is shapes[0]:
            assert cut < 0.15 * counts.sum()


def test_query_on_awkward_documents(spark, edge_folder, library):
    rows = packing.op12_packing(spark, edge_folder).collect()
    held(library, [(d[0], d[1]) for d in edge_tables.documents()], rows)


def test_query_on_test_data(spark, library):
    folder = "/root/testdata/sf0.01"
    documents = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    cut = held(library, documents, packing.op12_packing(spark, folder).collect())
    assert cut < 0.25 * len(documents)


def test_string_ids_and_own_limit(spark, library):
    documents = [(f"d{i}", edge_tables.words(i, i)) for i in range(60)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in documents], "key string, body string, n int, part int")
    held(library, documents, packing.pack(df, "key", "body", packing.default_tokenizer(), limit=50).collect(), 50)
