"""Spelling variants against a loop over all pairs."""

import random
import re
import zlib
from collections import Counter

import edge_tables
import pytest

from pulsegrid.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_hand(counts, factor=10):
    form, near = {}, {}
    for a in counts:
        others = [b for b in counts if one_edit(a, b)]
        near[a] = len(others)
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= factor * counts[a] else None
    out = []
    for a in counts:
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, form[a], root, counts[a], near[a], counts[form[a]] if form[a] is not None else None))
    return sorted(out)


def words_of(documents):
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def table(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("alphabet", ["ab", "abcé÷", "abcdefghij"])
def test_neighbours_forms_and_roots(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choices(alphabet, k=rng.randint(0, 7))) for _ in range(250)}
    counts = {w: rng.choice([2, 2, 3, 25, 30, 300, 3000, 40000]) for w in sorted(words)}
    got = table(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == by_hand(counts)
    assert any(r[1] not in (None, r[2]) for r in got)  # some chains have more than one step


def test_long_words_and_ties(spark):
    base = "a" * 3000 + "b" * 2000
    counts = {base: 2, base[1:]: 20, base[:-1]: 20, base[:10] + "c" + base[11:]: 20, base + "d": 19, "x" * 80: 2, "x" * 81: 2, "x" * 40 + "y" + "x" * 40: 50}
    assert table(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == by_hand(counts)


def test_query_on_awkward_documents(spark, edge_folder):
    documents = [(d[0], d[1]) for d in edge_tables.documents()]
    expected = by_hand(words_of(documents))
    assert table(spelling.op13_spelling_variants(spark, edge_folder)) == expected and expected


def test_query_on_generated_documents(spark, tmp_path):
    rng = random.Random(5)
    lexicon = ["".join(rng.choices("abcdeéÉXY", k=rng.randint(6, 9))) for _ in range(40)]
    documents = [(rng.choice([None, i, -i]), " ".join(w if rng.random() < 0.9 else w[:-1] + rng.choice("ab-") for w in rng.choices(lexicon, weights=[300 / (i + 1) ** 2 for i in range(40)], k=150))) for i in range(60)]
    documents += [(None, None), (3, ""), (4, "1234567 ×÷ÿÿabc abcdefgĀhijklmn")] * 2
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = by_hand(words_of(documents))
    assert table(spelling.op13_spelling_variants(spark, str(tmp_path))) == expected
    assert sum(r[1] is not None for r in expected) > 5


def test_factor_below_two_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)
