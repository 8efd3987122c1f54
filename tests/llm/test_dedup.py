"""Exact and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from millrace.llm import exact_dedup, simhash
from millrace.llm.components import components

DOCS = "doc_id long, text string, keep_id string, mark int"
TEXTS = ["", None, "Ab c", "aB C", "ab c ", "É", "é", "x" * 100_000, "X" * 100_000, "x" * 99_999 + "y", "the same", "The Same", "a b c d"]


def brute_exact(rows, largest):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").encode().lower(), []).append(doc_id)
    pick = max if largest else min
    out = []
    for plain, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        digest = hashlib.sha256(plain).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [1, exact_dedup.TRIE_BUDGET])
def test_exact_dedup(spark, keep, budget):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS * 3)] + [(3, "ab c", "x", 2), (3, "ab c", "x", 2), (None, "alone", None, None), (None, "Ab c", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = exact_dedup.exact_dedup(docs, keep=keep, budget=budget).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows, keep == "largest")
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.distinct_texts(docs, keep=keep, budget=budget)
    assert left.columns == docs.columns
    assert sorted((r.text or "").lower() for r in left.collect() if r.text is None or r.text.isascii()) == sorted({(t or "").lower() for _, t, *_ in rows if t is None or t.isascii()})


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_trie_keeps_colliding_texts_apart():
    trie, random_ = exact_dedup.Trie(), random.Random(1)
    texts = {bytes(random_.choices(b"ab", k=random_.randint(0, 12))) for _ in range(600)}
    for text in texts:
        trie.terminal(text).held = text
    assert sorted(trie.terminals()) == sorted(texts)
    assert all(trie.terminal(text).held == text for text in texts)


def nodes(trie):
    stack = [trie.root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend((node.children or {}).values())


def test_tries_share_edges_and_fork(spark):
    """Texts of one partition of a real table stand in one trie, with fewer bytes on its edges than they have, and inner forks."""
    texts = [(r.text or "").encode().lower() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tries = {}
    for text in texts:
        part = exact_dedup.partition(len(text), xxhash.xxh64_intdigest(text) - (1 << 63))
        trie = tries.setdefault(part, exact_dedup.Trie())
        trie.terminal(text).held = text
    distinct = set(texts)
    assert len(tries) < len(distinct) / 10
    assert sum(len(n.label) for t in tries.values() for n in nodes(t)) < sum(map(len, distinct))
    assert sum(len(n.children or ()) > 1 and n is not t.root for t in tries.values() for n in nodes(t)) > len(tries)
    assert sorted(h for t in tries.values() for h in t.terminals()) == sorted(distinct)


def test_heaviest_subtrees_are_cut():
    random_ = random.Random(5)
    for _ in range(30):
        trie, texts, out = exact_dedup.Trie(), set(), []
        for _ in range(400):
            text = random_.choice([b"", b"shared prefix ", b"sha"]) + bytes(random_.choices(b"abc", k=random_.randint(0, 9)))
            trie.terminal(text).held = text
            texts.add(text)
            if random_.random() < 0.02:
                wanted = random_.randint(1, sum(len(t) + 1 for t in texts))
                gone = list(trie.cut(wanted, lambda t: len(t) + 1))
                assert sum(len(t) + 1 for t in gone) >= min(wanted, sum(len(t) + 1 for t in texts - {b""})) - 16 or set(gone) | {b""} >= texts - set(trie.terminals())
                assert set(gone) <= texts and len(set(gone)) == len(gone) and sorted(trie.terminals()) == sorted(texts - set(gone))
                assert all(n.children or n.held is not None or n is trie.root for n in nodes(trie))
                texts -= set(gone)
                out += gone


@pytest.mark.parametrize("budget", [1, 5_000, 100_000])
def test_spilling_subtrees_loses_nothing(spark, budget):
    random_ = random.Random(6)
    texts = ["common start " * random_.randint(0, 20) + "".join(random_.choices("ab ", k=random_.randint(0, 12))) for _ in range(1500)]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS).repartition(3), keep="largest", budget=budget).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows, True)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_covering_finds_every_pair_in_reach(radius):
    random_ = random.Random(radius)
    for _ in range(300):
        flips = random_.sample(range(64), radius)
        pattern = sum(1 << i for i in flips)
        assert any(not pattern & mask for mask in simhash.masks(radius))


def brute_simhash(rows, shingle, radius):
    marks = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        total = [0] * 64
        parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        for part in parts:
            h = xxhash.xxh64_intdigest(part, 42)
            for i in range(64):
                total[i] += h >> i & 1
        marks.append((doc_id, sum(1 << i for i in range(64) if 2 * total[i] > len(parts))))
    label = {i: i for i, _ in marks}
    changed = True
    while changed:
        changed = False
        for i, a in marks:
            for j, b in marks:
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return sorted((i, f"{m:016x}", label[i]) for i, m in marks)


@pytest.mark.parametrize("bucket", [2, simhash.BUCKET])
def test_simhash(spark, bucket):
    random_ = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    base = [random_.choices(words, k=80) for _ in range(6)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(["", None, " \n\t ", "one", "one two", "ONE TWO", "Straße"])]
    for i in range(60):
        copy = list(base[i % 6])
        copy[random_.randrange(80)] = "changed"
        rows.append((10 + i, " ".join(copy), None, None))
    docs = spark.createDataFrame(rows + rows[:3], DOCS).repartition(4)
    got = simhash.simhash_dedup(docs, bucket=bucket).distinct().collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_simhash(rows, 3, 2)
    left = simhash.one_of_each(docs.dropDuplicates(["doc_id"]))
    assert sorted(r.doc_id for r in left.collect()) == sorted({r.component_id for r in got})
    assert left.columns == docs.columns


def test_simhash_of_nothing_and_without_ids(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b", "", 1), (4, "a b", "", 1), (None, "other words", "", 1)], DOCS)
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_dedup(rows).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


@pytest.mark.parametrize("n", [200, simhash.COMPARE + 400])
def test_pairs_in_a_bucket_agree_with_all_pairs(n):
    rng = np.random.default_rng(n)
    free = (1 << 20) - 1
    marks = np.unique(rng.integers(0, 1 << 20, n, dtype=np.uint64))
    nodes = rng.permutation(len(marks)).astype(np.int64)
    a, b = simhash._stars(marks.copy(), nodes, free, 2)
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2
    label = nodes.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(marks))])
        if (new == label).all():
            break
        label = new
    found = dict(zip(nodes.tolist(), nodes.tolist(), strict=True)) | dict(zip(a.tolist(), b.tolist(), strict=True))
    assert found == dict(zip(nodes.tolist(), label.tolist(), strict=True))


def test_components(spark):
    random_ = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, i) for i in range(300, 500)] + [(7, 7), (900, 901), (901, 900)]
    random_.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(121)} | {i: 300 for i in range(300, 501)} | {900: 900, 901: 900}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
