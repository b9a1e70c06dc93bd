"""Language, toxicity, secrets, pieces, fingerprints and chat."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat, imatch, language, pieces, secret_scan, toxicity
from pulsegrid.llm.queries import QUERIES

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_languages_held_out(spark):
    rows = QUERIES["op1_language_id"](spark, LARGER).collect()
    langs = {r.doc_id: r.lang for r in table(spark, LARGER, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def test_long_text_scores_as_in_one_block(monkeypatch):
    grams = language.Grams()
    matrix = np.random.default_rng(1).normal(size=(language.BUCKETS, 3)).astype(np.float32)
    texts = ["Größe und Maß " * 50, "", "12 34", "x" * 300, "日本 ß🙂a"]
    whole, letters = grams.text_sums(texts, matrix)
    monkeypatch.setattr(language, "_BLOCK", 7)
    parts, _ = grams.text_sums(texts, matrix)
    assert np.allclose(whole, parts, atol=1e-3) and letters.tolist() == [550, 0, 0, 300, 4]


def test_toxicity_held_out(spark):
    rows = QUERIES["op5_toxicity"](spark, LARGER).collect()
    toxic = {r.doc_id: r.toxic for r in table(spark, LARGER, "labels").collect()}
    known = [(r.predicted, toxic[r.doc_id]) for r in rows if r.doc_id in toxic]
    assert sum(p == t for p, t in known) / len(known) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(150):
        terms = np.sort(rng.choice(40, rng.integers(1, 12), replace=False))
        weights = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, weights / np.sqrt((weights**2).sum())))
    vectors += vectors[:20]  # ties
    index = toxicity.Nearest(vectors, 40, block=16)
    dense = np.zeros((len(vectors), 40))
    for row, (t, w) in zip(dense, vectors):
        row[t] = w
    for t, w in vectors[:60]:
        cosines = np.round(dense[:, t] @ w, 12)
        order = np.lexsort((np.arange(len(vectors)), -cosines))[:9]
        found, values = index.search(t, w, 9)
        assert np.allclose(values, cosines[order], atol=1e-9) and set(found) == set(order.tolist())


def base_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def spell(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secrets_against_regular_expressions(spark):
    rng = random.Random(4)
    bits = ["password", "Secret", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEF123456", "deadbeef01234567", "tok", "token", "é", "\x01", "\n", "x.y-z/+_", "zq9Xk2Lp0Vw7Rt4Y"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(300)] + ["", None, "ab " * 3000 + "deadbeefdeadbeef " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    samples = spark.createDataFrame([("zq9Xk2Lp0Vw7Rt4YhG3sDf8J", 1)] * 3 + [("ordinary_identifier_name", 0)] * 3, "token string, label int")
    ratios = secret_scan.fit_markov(samples)
    found = secret_scan.scan(frame, "text", ratios)
    rows = found.select("doc_id", secret_scan.as_text(F.col("found"), 3).alias("base"), secret_scan.as_text(F.col("found")).alias("spans")).collect()
    for r in rows:
        assert r.base == spell(base_spans(texts[r.doc_id] or ""))
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    masked = {r.doc_id: r.text for r in secret_scan.redact(found, "text", "found").collect()}
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in rows}
    for i, text in enumerate(texts):
        if not spans[i]:
            assert masked[i] == text
            continue
        gone = bytearray(len(text))
        for a, b in spans[i]:
            gone[a:b] = b"\1" * (b - a)
        assert masked[i].replace("<secret>", "") == "".join(c for c, g in zip(text, gone) if not g)


def test_random_tokens_are_found(spark):
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rng.choices(alphabet, k=32)) for _ in range(330)]
    names = ["_".join(rng.choices(["user", "count", "session", "handler", "index", "value", "record", "table"], k=4)) for _ in range(330)]
    samples = spark.createDataFrame([(s, 1) for s in secrets[:300]] + [(s, 0) for s in names[:300]], "token string, label int")
    frame = spark.createDataFrame([(i, f"see {t} here", i < 30) for i, t in enumerate(secrets[300:] + names[300:])], "i int, text string, is_secret boolean")
    found = secret_scan.scan(frame, "text", secret_scan.fit_markov(samples))
    counts = {(s, n): 0 for s in (True, False) for n in (0, 1)}
    for r in found.collect():
        counts[r.is_secret, len(r.found)] += 1
    assert counts[True, 1] >= 28 and counts[False, 1] == 0


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_equal_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    for r in QUERIES["op6_sentencepiece"](spark, FOLDER).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_texts(library):
    rng = random.Random(1)
    kinds = ["ab", "aab c", "the and  ", "aaaa bbb", "éèß▁ x", "日本語执 🙂\n\t", "\x00\x01\x02a ", "   x▁▁", "abcdefghijklmnopqrstuvwxyz "]
    texts = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "   " * 40, "a" * 3000, "ab" * 2000, "▁", "<s>", "</s> <unk> <0x41>", "x" * 20 + " " * 40 + "y"]
    encoder = pieces.Encoder(pieces.read_vocabulary(pieces.default_model()))
    for text in texts:
        ids = library.encode(text)
        assert encoder.encode(text) == ids and encoder.decode(ids) == library.decode(ids)
    for _ in range(200):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randrange(30))]
        assert encoder.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_whose_polynomial_hashes_collide(library, n):
    """The Thue-Morse word and its complement have equal hashes modulo 2**64 for every base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = one.translate({97: 98, 98: 97})
    encoder = pieces.Encoder(pieces.read_vocabulary(pieces.default_model()))
    for text in (one, other, f"{one} {other}", f"{other} {one} {other}"):
        assert encoder.encode(text) == library.encode(text)


def test_pieces_round_trip_as_columns(spark, library):
    frame = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "i int, text string")
    rows = pieces.decode_ids(pieces.encode_ids(frame, "text", pieces.default_model()), "ids", pieces.default_model()).collect()
    assert [(r.ids, r.decoded) for r in rows] == [(library.encode("Hello wörld"), "Hello wörld"), ([], "")]


def test_fingerprints_against_a_driver_loop(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    rows = {r.doc_id: r for r in QUERIES["op7_imatch"](spark, FOLDER).collect()}
    ids = sorted(texts, reverse=True)
    for at, i in enumerate(ids):
        after, t = ids[(at + 1) % len(ids)], texts[i]
        third = len(t) // 3
        edited = t[: len(t) - third] + texts[after][:third]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].near_next == pytest.approx(imatch.likeness(rows[i].fingerprint, rows[after].fingerprint))
        assert rows[i].near_edited == pytest.approx(imatch.likeness(rows[i].fingerprint, rows[i].edited_fingerprint))
    by_text = {}
    assert all(by_text.setdefault(texts[i], rows[i].fingerprint) == rows[i].fingerprint for i in ids)
    assert sum(r.near_edited > r.near_next for r in rows.values()) / len(rows) > 0.85


def test_lexicon_counts_documents(spark):
    flags = imatch.lexicon(spark.createDataFrame([("a b",), ("a c c",), ("a",), (None,)], "text string"), "text", (0.0, 0.5))
    assert flags.sum() == 0
    flags = imatch.lexicon(spark.createDataFrame([("a b",), ("a b c c",), ("a",), (None,)], "text string"), "text", (0.0, 0.5))
    assert flags.sum() == 1  # b, in two of four documents; a is in three, c in one


def test_fingerprints_of_a_family_of_a_third_of_the_rows(spark, tmp_path):
    """A text, its copies and its edits hold a third of the rows; edits stay near it, other texts do not."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [f"f{i}" for i in range(120)]
    texts = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(200)]
    texts += [" ".join(base)] * 40
    for _ in range(60):
        texts.append(" ".join(rng.choice(vocabulary) if rng.random() < 0.08 else x for x in base))
    rng.shuffle(texts)
    family = {i for i, t in enumerate(texts) if sum(x in base for x in t.split()) > 60}
    assert len(family) == 100
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op7_imatch"](spark, str(tmp_path)).collect()}
    assert all(rows[i].near_edited > 0 for i in family) and np.mean([rows[i].near_edited for i in family]) > 0.2
    one = next(i for i in family if texts[i] == " ".join(base))
    near = {i: imatch.likeness(rows[one].fingerprint, rows[i].fingerprint) for i in rows}
    assert min(near[i] for i in family) > 0.2 and max(near[i] for i in rows.keys() - family) < 0.1


def test_document_frequencies_count_copies_once(spark):
    frame = spark.createDataFrame([("a b",)] * 30 + [("b c",), ("c d",), (None,), ("",)], "text string").repartition(4)
    df, total = imatch.frequencies(frame, "text")
    assert total == 4 and sorted(df[df > 0].tolist()) == [1, 1, 2, 2]


def viterbi_by_enumeration(model, obs):
    import itertools

    n = len(model["start"])
    best = max(
        itertools.product(range(n), repeat=len(obs)),
        key=lambda path: sum((model["start"][s] if t == 0 else model["step"][path[t - 1]][s]) + model["emission"][obs[t]][s] for t, s in enumerate(path)),
    )
    return list(best)


def test_viterbi_whole_and_in_chunks():
    rng = np.random.default_rng(3)
    model = {"start": rng.normal(size=4), "step": rng.normal(size=(4, 4)), "emission": rng.normal(size=(6, 4))}
    viterbi = chat.Viterbi(model)
    for _ in range(10):
        obs = rng.integers(0, 6, 6)
        whole = viterbi.path(obs)
        assert whole.tolist() == viterbi_by_enumeration(model, obs)
        first = viterbi.start + viterbi.emission[obs[0]]
        first = (first[:, None] + viterbi.step).max(axis=0) + viterbi.emission[obs[1]]
        ends = viterbi.cuts(first, [viterbi.transfer(obs[2:4]), viterbi.transfer(obs[4:6])])
        parts = [viterbi.path(obs[0:2], None, ends[0]), viterbi.path(obs[2:4], ends[0], ends[1]), viterbi.path(obs[4:6], ends[1], ends[2])]
        assert np.concatenate(parts).tolist() == whole.tolist()


def test_chat_roles_and_chunks(spark, monkeypatch):
    rows = QUERIES["op10_chat_format"](spark, LARGER).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.n_right for r in held) / sum(r.n_lines for r in held) > 0.9
    whole = sorted((r.conv_id, r.turn, r.role, r.rendered) for r in rows)
    monkeypatch.setattr(chat, "CHUNK_LINES", 3)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    assert sorted((r.conv_id, r.turn, r.role, r.rendered) for r in QUERIES["op10_chat_format"](spark, LARGER).collect()) == whole


def test_text_at_the_head_of_an_unmarked_turn_stays(spark):
    heads = ["https://x.org/a is down", "Note: keep it short", "Error: no such file", "> Hint: look again"]
    turns = [(c, t, ("user", "tool")[t % 2], f"{('User', 'Tool')[t % 2]}: line {t} of {c}") for c in range(len(heads)) for t in range(4)]
    turns = [(c, t, role, heads[c] if t == 0 else text) for c, t, role, text in turns]
    lines = chat.to_lines(spark.createDataFrame(turns, "conv long, turn long, role string, text string"))
    found = chat.recover(lines, chat.fit(lines)).orderBy("conv", "turn").collect()
    for c, head in enumerate(heads):
        assert "\n".join(r.text for r in found if r.conv == c).split("\n") == [head] + [f"line {t} of {c}" for t in (1, 2, 3)]
