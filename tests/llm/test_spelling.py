"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(count):
    out = {}
    near = {w: [v for v in count if one_apart(w, v)] for w in count}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count.get(form[w]))
    return out


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_texts(spark):
    random_ = random.Random(1)
    letters = "abcdé×ÀÿZ"
    stems = ["".join(random_.choices(letters, k=random_.randint(6, 10))) for _ in range(40)]

    def spoilt(w):
        i, k = random_.randrange(len(w)), random_.random()
        return w if k < 0.6 else w[:i] + w[i + 1 :] if k < 0.75 else w[:i] + random_.choice(letters) + w[i + (k < 0.9) :]

    rows = [(random_.choice([None, *range(50)]), " ".join(spoilt(random_.choice(stems)) + random_.choice(["", ",", "1", "ā"]) for _ in range(random_.randint(0, 60)))) for _ in range(250)]
    rows += [(1, None), (2, ""), (3, "x" * 50_000 + " " + "x" * 50_000), (4, "y" * 50_000 + " " + "x" * 49_999 + " " + "x" * 49_999), (6, " ".join(w for k in (62, 63, 64, 65, 66) for w in ["z" * k, "z" * 30 + "é" + "z" * (k - 31)] * 2)), (5, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa abababab abababab babababa babababa")]
    rows += rows[:20]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, word string").repartition(5)
    assert result(spelling.variants(docs)) == brute_variants(brute_words(rows))


def test_chains_are_followed_to_their_root(spark):
    count = {"abcdefgh": 2, "abcdefg": 20, "abcdef" + "h": 200, "abcdexh": 2000, "abzdexh": 19_999}
    docs = spark.createDataFrame([(1, " ".join([w] * n)) for w, n in count.items()], "doc_id long, text string")
    got = result(spelling.variants(docs, every=None))
    assert got == brute_variants(count)
    assert got["abcdefgh"][1] in ("abcdexh", "abzdexh")
    forms = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(12)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms, 2 * 10**12).collect()} == {f"{i}": "12" for i in range(12)}


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghij"])
def test_no_near_pair_is_missed(spark, letters):
    random_ = random.Random(len(letters))
    words = {"".join(random_.choices(letters, k=random_.randint(7, 12))) for _ in range(500)}
    found = spark.createDataFrame([(w, 2) for w in words], "word string, n long").repartition(4)
    pairs = [(r.word, r.other) for r in spelling.near(found).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_pivots_are_the_cheapest_disjoint_places():
    random_ = np.random.default_rng(0)
    ranks = random_.integers(0, 12, (300, 9)).astype(np.int32)
    cost = ranks.astype(np.int64) * 3 + 1
    last, prefix, pivots = spelling.choose(ranks, cost)
    for i in range(len(ranks)):
        assert last[i] == sorted(ranks[i])[2] and (prefix[i] == (ranks[i] <= last[i])).all()
        a, b = pivots[i]
        places = np.nonzero(prefix[i])[0]
        best = min(cost[i, p] + cost[i, q] for p in places for q in places if q >= p + 2)
        assert b >= a + 2 and prefix[i, a] and prefix[i, b] and cost[i, a] + cost[i, b] == best


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "kurz")], "doc_id long, text string")).count() == 0
