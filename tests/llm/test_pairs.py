"""Jaccard join, decontamination, shards and suffixes against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import batches, jaccard, shards, suffixes
from pulsegrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def components(sets):
    parent, index = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in index[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            index[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components_of_the_table(spark, texts):
    rows = QUERIES["op2_jaccard_join"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components({i: shingle_set(t) for i, t in texts.items()})


def test_jaccard_components_of_a_family_with_a_common_passage(spark, monkeypatch):
    """Near copies around the threshold and documents that share a passage, with every group over a few sets hot."""
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 3000)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(120):
        if i % 2:
            w = [f"x{rng.randrange(10**6)}" if rng.random() < rng.choice((0.01, 0.03, 0.05)) else x for x in base]
        else:
            w = [f"y{rng.randrange(10**6)}" for _ in range(rng.choice((10, 15, 25, 60)))] + passage
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.jaccard_components(frame, "doc_id", "text").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components({i: shingle_set(t) for i, t in docs})


def test_jaccard_pairs_around_a_passage_grow_with_the_texts(spark, monkeypatch):
    """Texts around one passage, a little too short to link them, meet by what else they share, not all with all."""
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 1500)
    candidates = []
    verify = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets, percent: candidates.append(pairs.count()) or verify(pairs, sets, percent))
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(85)]
    made = {}
    for size in (120, 360):
        docs = []
        for i in range(size):
            own = [f"y{rng.randrange(10**6)}" for _ in range(30)]
            if i % 6 == 1:  # its neighbour but for some words
                own = docs[-1][1].split()[:30]
                own[:3] = ["z", f"z{i}", f"u{i}"]
            docs.append((i, " ".join(own + passage)))
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        candidates.clear()
        rows = jaccard.jaccard_components(frame, "doc_id", "text").collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components({i: shingle_set(t) for i, t in docs})
        made[size] = candidates[-1]
    assert made[360] <= max(360, 4 * made[120]), made


def test_second_level_signatures_meet(spark):
    """Random sets of 75 percent similarity share an element of their beginnings that both count."""
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 6, 1 << jaccard._SLOT_BITS).astype(np.uint8)
    for n in [1, 2, 3, 4, 7, 8, 20, 61, 146, 400] * 6:
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        keep = len(a) - rng.integers(0, len(a) // 4 + 1)
        room = (4 * keep - 3 * len(a)) // 3  # elements of its own
        b = np.unique(np.concatenate([rng.permutation(a)[:keep], rng.integers(0, 2**63, rng.integers(0, room + 1), np.uint64)]))
        assert 100 * keep >= 75 * (len(a) + len(b) - keep)
        small, large = sorted((a, b), key=len)
        found = [dict(zip(*(x[p & 1 == larger] for x in (s, p)))) for larger, (s, p) in ((0, jaccard.beginnings(small, levels)), (1, jaccard.beginnings(large, levels)))]
        shared = [(len(small) - found[0][s] // 2, len(large) - found[1][s] // 2) for s in found[0].keys() & found[1].keys()]
        assert any(7 * min(pair) >= 3 * (len(a) + len(b)) for pair in shared), (n, len(a), len(b))


def test_near_copies_without_an_id_are_linked(spark):
    """Two different near copies with null ids are one group; one with a null id links two rows that are not similar themselves."""
    w = {c: [f"{c}{i}" for i in range(105)] for c in "abc"}
    rows = [(None, w["a"][:100]), (None, w["a"][1:101]), (None, w["c"][:50]), (7, w["c"][60:])]
    rows += [(1, w["b"][:96]), (None, w["b"][:100][8:]), (2, w["b"][18:105])]
    one, two, three = (shingle_set(" ".join(x)) for _, x in rows[4:])
    assert all(100 * len(x & y) >= 75 * len(x | y) for x, y in ((one, two), (two, three))) and 100 * len(one & three) < 75 * len(one | three)
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(frame, "doc_id", "text").collect()}
    assert found == {(None, 96): None, (None, 46): None, (7, 41): 7, (1, 92): 1, (None, 88): 1, (2, 83): 1}
    kept = [tuple(r) for r in jaccard.one_of_each(frame, "doc_id", "text").collect()]
    texts = [" ".join(x) for _, x in rows]
    assert len(kept) == 4 and sum(t in texts[:2] for _, t in kept) == 1
    assert {(None, texts[2]), (7, texts[3]), (1, texts[4])} <= set(kept)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8, 13, 40, 127, 128, 170, 300, 1000])
def test_similar_sets_share_signatures(size):
    """The bound holds for pairs right at the threshold, in one band and across bands."""
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        inter = int(rng.integers(-(-3 * size // 4), size + 1))
        extra = int(rng.integers(0, (4 * inter - 3 * size) // 3 + 1)) if 4 * inter >= 3 * size else 0
        b = np.unique(np.concatenate([rng.permutation(a)[:inter], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common):
            continue
        sa, bound_a = jaccard.signatures(a, jaccard.instances(len(a)))
        sb, bound_b = jaccard.signatures(b, jaccard.instances(len(b)))
        shared = set(np.concatenate(sa).tolist()) & set(np.concatenate(sb).tolist())
        kind = (len(a).bit_length() != len(b).bit_length()) * 1
        assert sum(x & 1 == kind for x in shared) >= max(1, bound_a[kind], bound_b[kind])


def test_word_hashes_and_shingles():
    text = "The cat\tthe CAT  sat \x0bon é É".encode()
    h, n = batches.Words()(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), len(text), 2 * len(text)]))
    assert n.tolist() == [8, 0, 8] and (h[:8] == h[8:]).all()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h[:8].tolist())) == 6
    s, k = batches.shingles(h, n)
    assert k.tolist() == [4, 0, 4] and (s[:4] == s[4:]).all()
    short, k = batches.shingles(h[:3], np.array([1, 2]))
    assert k.tolist() == [1, 1] and short[0] != short[1]


def test_decontamination_of_the_table(spark, texts):
    items = [(r.item_id, shingle_set(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = {(d, i, len(q), len(q & s)) for d, s in sets.items() for i, q in items if q and 100 * len(q & s) >= 75 * len(q)}
    rows = QUERIES["op4_decontamination"](spark, FOLDER).collect()
    assert want and {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows} == want


def test_decontamination_in_blocks(spark, monkeypatch):
    from pulsegrid.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 50)
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.contained_items(docs, "doc_id", "text", items, "item_id", "text")
    assert found.count() == QUERIES["op4_decontamination"](spark, FOLDER).count()
    counted = decontaminate.count_contained(docs, "text", items, "item_id", "text")
    assert counted.agg({"n_items": "sum"}).first()[0] == found.count()


def test_shards_of_the_table(spark, texts):
    rows = QUERIES["op3_rendezvous_shards"](spark, FOLDER).collect()
    slots = defaultdict(list)
    for r in rows:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key") and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_weighted_shards_move_little(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 5.0]
    placed = shards.assign_shards(df, "k", weights, grown_weight=2.0)
    counts = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    for i, w in enumerate(weights):
        assert counts[i] / 20_000 == pytest.approx(w / 8, abs=0.02)
    moved = placed.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 3").count() == 0 and moved.count() / 20_000 == pytest.approx(0.2, abs=0.02)


def brute_cut(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choices("ab", k=n)) for n in (150, 199, 200, 201, 260, 400)] + ["x" * 450, "ab" * 150, "é" * 120]
    docs = ["".join(rng.choice(parts) + "".join(rng.choices("cdefgh", k=rng.randrange(40))) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    docs += ["", "short", docs[0], parts[2], parts[3]]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(frame, "doc_id", "text").collect()}
    assert [rows[i] for i in range(len(docs))] == brute_cut([d.encode() for d in docs])


def test_suffix_dedup_of_hot_leads(spark, monkeypatch):
    """Texts that repeat a word pair and a passage that most of them hold: no bucket gets all contexts of a lead."""
    monkeypatch.setattr(suffixes, "HOT", 50, raising=False)
    judge = suffixes._repeats

    def bounded(batches):
        held = list(batches)
        assert sum(n for b in held for n, blob in zip(b.column("n").to_pylist(), b.column("blob").to_pylist()) if blob) <= 1500
        yield from judge(held)

    monkeypatch.setattr(suffixes, "_repeats", bounded)
    rng = random.Random(8)
    noise = lambda: "".join(rng.choices("cdefgh", k=rng.randrange(90, 260)))
    passage = "".join(rng.choices("ijkl", k=420))
    docs = [noise() + "Is onhe. " * rng.randrange(10, 90) + noise() for _ in range(90)]
    docs += [noise() + passage[: rng.randrange(190, 421)] + noise() for _ in range(120)]
    docs += [docs[0], docs[100], "Is onhe. " * 30, passage[100:299]]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(frame, "doc_id", "text").collect()}
    assert [rows[i] for i in range(len(docs))] == brute_cut([d.encode() for d in docs])


def test_suffix_dedup_of_the_table(spark, texts):
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_suffix_dedup"](spark, FOLDER).collect()}
    ids = sorted(texts)
    assert [rows[i] for i in ids] == brute_cut([texts[i].encode() for i in ids])
