"""Classifiers, language identification, neighbours, mixing."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, langid, mixing, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, predicted string"


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_quality_on_held_out_rows(spark, sf):
    found = queries.op8_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) >= 0.95


def test_quality_score_is_the_posterior(spark):
    rng = np.random.default_rng(1)
    p = len(quality.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (300, p)), rng.normal(0.7, 2, (100, p))])
    y = [0] * 300 + [1] * 100
    model = quality.fit(spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y, strict=True)], "stats array<double>, label int"))
    covariance = [np.cov(x[:300].T, bias=True), np.cov(x[300:].T, bias=True)]
    pooled = 0.75 * covariance[0] + 0.25 * covariance[1]
    logs = []
    for k, (part, share) in enumerate(((x[:300], 0.75), (x[300:], 0.25))):
        s = (1 - quality.POOL) * covariance[k] + quality.POOL * pooled + quality.RIDGE * np.trace(pooled) / p * np.eye(p)
        gap = x - part.mean(axis=0)
        logs.append(math.log(share) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    score, toxic = np.array([r.score for r in found]), np.array([r.toxic for r in found])
    rank = np.argsort(np.argsort(score))
    n = toxic.sum()
    assert (rank[toxic == 1].sum() - n * (n - 1) / 2) / (n * (len(toxic) - n)) > 0.95
    assert np.mean((score >= 0.5) == (toxic == 1)) > 0.96


def test_toxicity_counts_documents(spark):
    rows = [(1, "idiot idiot x"), (0, "idiot"), (1, "Idiot!"), (0, None), (0, "")]
    got = {r.bucket: (r.toxic, r.other) for r in toxicity.counts(spark.createDataFrame(rows, "label int, text string").repartition(2)).collect()}
    import pyarrow as pa

    bucket, _ = toxicity.buckets(pa.array(["idiot"], pa.string()))
    assert len(set(bucket.tolist())) == 4 + 3 + 2
    assert all(got[b] == (2, 1) for b in bucket.tolist())


def test_toxicity_values_every_clear_bucket(spark):
    random_ = random.Random(6)
    words = ["".join(random_.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(900)]
    # Copies of one long document have the widest gaps, in far over 4,096 buckets; the toxic word's are narrower.
    rows = [(0, " ".join(words))] * 60 + [(0, "plain")] * 40 + [(1, "rotten" if i % 2 else "plain") for i in range(60)]
    labelled = spark.createDataFrame(rows, "label int, text string").repartition(4)
    grouped, toxic, other = toxicity.counts(labelled).collect(), 60, 100
    clear = set()
    for r in grouped:
        pooled = (r.toxic + r.other) / (toxic + other)
        error = math.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / other))
        if r.toxic + r.other >= toxicity.LEAST and abs(r.toxic / toxic - r.other / other) > toxicity.CLEAR * error:
            clear.add(r.bucket)
    model = toxicity.fit(labelled)
    assert len(clear) > 8192 and set(model.buckets.tolist()) == clear
    assert np.count_nonzero(model.values) == len(clear)
    found = toxicity.score(spark.createDataFrame([(1, "rotten"), (2, "plain"), (3, " ".join(words))], "doc_id long, text string"), model)
    score = {r.doc_id: r.score for r in found.collect()}
    assert score[1] > 0.9 and score[3] < 0.1 and score[3] < score[2] < score[1]


def test_toxicity_weights_minimise_the_penalised_loss(spark):
    rows = [(i % 2, ("rotten " if i % 7 in (1, 3) else "") + ("sweet " if i % 5 in (0, 2) and i % 2 == 0 else "") + "word") for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "label int, text string").repartition(3))
    import pyarrow as pa

    bucket, text = toxicity._once(*toxicity.buckets(pa.array([t for _, t in rows], pa.string())))
    z = np.bincount(text, model.table()[bucket], len(rows)) + model.intercept
    gap = 1 / (1 + np.exp(-z)) - np.array([y for y, _ in rows])
    assert len(model.buckets) and abs(gap.mean()) < 1e-3


def test_toxicity_on_a_bound_sample(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = toxicity.classify(docs, labels, fit_rows=1000).join(labels, "doc_id").where("held_out").collect()
    score, toxic = np.array([r.score for r in found]), np.array([r.toxic for r in found])
    rank, n = np.argsort(np.argsort(score)), toxic.sum()
    assert (rank[toxic == 1].sum() - n * (n - 1) / 2) / (n * (len(toxic) - n)) > 0.9


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_on_odd_rows(spark, classify):
    name = "quality" if classify is quality.classify else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1), (2, 7)], f"doc_id long, {name} int")
    rows = [(i, ("good plain words " if i % 2 else "BAD!! $$$ ") * (i + 1), None, None, "clash", "clash") for i in range(60)]
    rows += [(100, None, None, None, None, None), (101, "", None, None, None, None), (None, "x", None, None, None, None), (102, "w " * 30_000, "", "", "", ""), (5, "good", "", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert classify(docs.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in classify(docs, labels.where(f"{name} = 1")).collect()} == {1.0}
    assert {r.held_out for r in classify(docs, labels.limit(0)).collect()} == {True, False}


def test_language_on_held_out_rows(spark, sf):
    found = queries.op2_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) >= 0.97


def test_quoted_foreign_text_is_not_learnt(spark):
    """A language whose texts quote another one now and then does not take the other's n-grams for its own."""
    random_ = random.Random(9)
    word = lambda letters: "".join(random_.choices(letters, k=6))
    sides = {"xx": "abcdefgh", "yy": "efghijkl"}
    rows = [(lang, " ".join(word(sides["yy" if lang == "xx" and random_.random() < 0.01 else lang]) for _ in range(3000))) for lang in ("xx", "yy") for _ in range(20)]
    learnt = spark.createDataFrame(rows, "lang string, text string")
    docs = spark.createDataFrame([(i, " ".join(word(sides["yy"]) for _ in range(8))) for i in range(200)], "doc_id long, text string")
    wrong = lambda contrast: sum(r.lang_pred != "yy" for r in langid.predict(docs, langid.fit(learnt, contrast)).collect())
    assert wrong(langid.CONTRAST) <= 2 < wrong(0.0)


def test_filters_hold_all_their_n_grams(spark):
    import pyarrow as pa

    rows = [("xx", "alpha beta gamma " * 5), ("yy", "uno dos tres " * 5), ("zz", "alpha tres ")]
    filters = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert filters.languages == ["xx", "yy", "zz"]
    grams, text = langid.trigrams(pa.array([r[1] for r in rows], pa.string()))
    total, counts = filters.counts(grams, text, 3)
    assert all(counts[i, i] == pytest.approx(total[i], rel=0.01) for i in range(3))


def brute_grams(text):
    """Trigrams around every letter; a run of other characters is one, and so are both ends."""
    line, out = [0], []
    for c in (text or "").lower():
        if c.isalpha():
            line.append(ord(c))
        elif line[-1]:
            line.append(0)
    line += [0]
    for i in range(1, len(line) - 1):
        if line[i]:
            out.append(line[i - 1] << 42 | line[i] << 21 | line[i + 1])
    return out


def brute_positions(gram, size):
    mask, out = 2**64 - 1, []
    for k in range(langid.HASHES):
        x = (gram + (k + 1) * 0x9E3779B97F4A7C15) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        out.append((x ^ x >> 31) & (size - 1))
    return out


@pytest.mark.parametrize("most", [langid.MOST, 256])
def test_language_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(langid, "MOST", most)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9000, "Zażółć gęślą jaźń 12 " * 3, "pl", None, None), (9001, "x" * 30_000, None, None, None), (9002, "aé 日本 б", None, None, None)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(5)).repartition(4)
    rows = docs.select("doc_id", "text", "lang").collect()
    learnt, sizes = {}, {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            grams = brute_grams(r.text)
            learnt.setdefault(r.lang, Counter()).update(grams)
            sizes[r.lang] = sizes.get(r.lang, 0) + len(grams)
    rates = {k: {g: n / sizes[k] for g, n in v.items()} for k, v in learnt.items() if v}
    peak = {}
    for of in rates.values():
        for g, rate in of.items():
            peak[g] = max(rate, peak.get(g, 0.0))
    learnt = {k: {g for g, rate in of.items() if rate >= peak[g] * langid.CONTRAST} for k, of in rates.items()}
    assert set().union(*learnt.values()) == set(peak)
    languages = sorted(learnt)
    size = min(most, 1 << math.ceil(math.log2(langid.SPACE * max(map(len, learnt.values())))))
    bits = {lang: {p for g in learnt[lang] for p in brute_positions(g, size)} for lang in languages}
    rate = {lang: (len(bits[lang]) / size) ** langid.HASHES for lang in languages}
    want = []
    for r in rows:
        grams = brute_grams(r.text)
        at = [brute_positions(g, size) for g in grams]
        count = {lang: sum(all(p in bits[lang] for p in ps) for ps in at) for lang in languages}
        count = {lang: max(0.0, (n - len(grams) * rate[lang]) / max(1e-9, 1 - rate[lang])) for lang, n in count.items()}
        best = max(languages, key=lambda lang: (count[lang], -languages.index(lang)))
        total = sum(count.values())
        usual = max(languages, key=lambda lang: (sizes[lang], -languages.index(lang)))
        lang = "und" if not grams else best if total > 0 else usual
        want.append((r.doc_id, lang, round(count[best] / total, 9) if grams and total > 0 else 0.0))
    got = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect()]
    assert sorted(got) == sorted(want)


def test_language_on_odd_rows(spark):
    many = [f"l{i:03d}" for i in range(70)]
    random_ = random.Random(4)
    own = {m: " ".join("".join(random_.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(40)) for m in many}
    rows = [(4 * i + j, own[m], m, None, "clash", "x") for i, m in enumerate(many) for j in range(3)]
    rows += [(1000, None, "l001", None, None, None), (1001, "", "l001", None, None, None), (1002, "123 !!", None, None, None, None), (None, "Öé 語", None, None, None, None), (1003, own["l069"].upper(), None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und"
    assert got[1003].lang_pred == "l069" and got[None].lang_pred in many
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_neighbours(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            ranked = sorted((-(v * w).sum(), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def test_neighbours_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(45)]
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0] * 7), (260, [None] + [1.0] * 7), (280, [math.nan] * 8), (300, [math.inf] * 8), (320, [])]
    table_ = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    got = {}
    for r in ann.search(table_, k=20, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_neighbours(rows, 20, 20)
    assert got.keys() == want.keys()
    for q, mine in got.items():
        assert [i for i, _ in mine] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in mine], [s for _, s in want[q]], atol=1e-12)
    assert ann.search(table_.limit(0)).count() == 0
    few = ann.search(table_.where("vec_id < 5")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [i for i, _ in brute_neighbours(rows[:5], 20, 20)[0]]


def test_neighbours_recall(spark, sf):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table(spark, sf, "embeddings").collect()]
    want = brute_neighbours(rows, 20, 20)
    got = {}
    for r in queries.op6_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.9
    assert all(len(got[q]) == len(w) for q, w in want.items())


def test_neighbours_are_dealt_by_bundles(spark, monkeypatch):
    """A query is copied to bundles, not to lists, and returns k + 1 rows from each. With small limits few rows change: chunks of up to 64 vectors are not tested."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=24).round(3).tolist()) for i in range(3000)] + [(3000 + i, [1.0] * 24) for i in range(50)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    seen, stored = {}, ann.stored
    monkeypatch.setattr(ann, "stored", lambda df, name, *more: seen.setdefault(name, stored(df, name, *more)))
    got = sorted(ann.search(table_, k=10, every=20).collect())
    asked = len({r.query_id for r in got})
    assert asked == 153 and seen["probes"].count() <= 17 * asked
    want = brute_neighbours([(r.vec_id, list(r.embedding)) for r in table_.orderBy("vec_id").collect()], 10, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(found[q]) == 10 for q in want)
    assert np.mean([len(set(found[q]) & {i for i, _ in w}) / 10 for q, w in want.items()]) >= 0.9
    for name, value in (("BUNDLES", 40), ("ROWS", 50), ("CHUNK", 30), ("QUERIES", 8), ("TILE", 100), ("RANKED", 500), ("HELD", 900)):
        monkeypatch.setattr(ann, name, value)
    again = sorted(ann.search(table_, k=10, every=20).collect())
    assert [len(again), {r.query_id for r in again}] == [len(got), {r.query_id for r in got}]
    assert sum(a == b for a, b in zip(got, again, strict=True)) >= 0.97 * len(got)


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("size", [20, 700])
def test_scan_by_contrast(known, size):
    """All pairs of a tile at once give what a plain loop over queries and blocks of columns gives, ties and near copies included."""
    rng, k = np.random.default_rng(size), 5
    x, q = rng.normal(size=(size, 40)), rng.normal(size=(30, 40))
    x[::9] = np.round(x[::9])
    x[1::9], q[:5] = x[2] + 1e-9 * rng.normal(size=x[1::9].shape), x[:5]
    largest, nodes = (x * x).sum(axis=1).max(), rng.permutation(size)
    rotation, _ = np.linalg.qr(rng.normal(size=(41, 41)))
    index = ann.Index(rotation, largest, np.zeros((1, 41)), 1)
    x, nodes = x[np.argsort(nodes)], np.sort(nodes)
    turned, q_turned, products = index.turned(x), index.turned(q, True), np.stack([(x * one).sum(axis=1) for one in q])
    bound = np.sort(products, axis=1)[:, -12] if known else np.full(len(q), -np.inf)
    want = {}
    for i in range(len(q)):
        left, part = np.arange(size), np.zeros(size)
        limit = (q[i] ** 2).sum() + largest - 2 * bound[i]
        if limit == np.inf:
            limit = np.sort(((turned[: ann.FIRST] - q_turned[i]) ** 2).sum(axis=1))[k - 1]
        for end in range(ann.BLOCK, 41, ann.BLOCK) if size > ann.FIRST else []:
            part = part + ((turned[left, end - ann.BLOCK : end] - q_turned[i, end - ann.BLOCK : end]) ** 2).sum(axis=1)
            stay = part * (41 / end) <= limit * (1 + ann.DEVIATIONS / math.sqrt(end)) ** 2
            left, part = left[stay], part[stay]
        want[i] = sorted((-products[i, j], nodes[j]) for j in left if products[i, j] >= bound[i])[:k]
    limit = ann.limits(q, q_turned, bound, largest, turned, k)
    best = ann.Best(bound, nodes, k)
    for s in range(0, len(q), 7):
        some = np.arange(s, min(s + 7, len(q)))
        row, at, product = ann.scan(q[some], [b[some] for b in ann.halves(q_turned, True)], limit[some], best.least[some], largest, x, ann.halves(turned), k)
        best.add(some[row], at, product)
    row, at, product = best.cut()
    got = {i: [(-p, nodes[j]) for j, p in zip(at[row == i], product[row == i], strict=True)] for i in range(len(q))}
    assert got == want


def mixed_rows(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["big"] * 300 + ["mid"] * 80 + ["small"] * 20 + [None] * 10)]
    rows += [(500, None, "empty"), (501, "", "empty"), (502, "x", "big"), (502, "x", "big")]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, copies string, weight int")


def tokens(rows):
    out = {}
    for _, text, source in rows:
        out[source] = out.get(source, 0) + len((text or "").split())
    return out


@pytest.mark.parametrize("blocks", [1, 8, mixing.BLOCKS])
def test_mixing_to_a_repetition_limit(spark, blocks):
    rows, docs = mixed_rows(spark)
    got = mixing.mix(docs, repeat=3.0, blocks=blocks).collect()
    assert len(got) == len(rows)
    t = {s: n for s, n in tokens(rows).items() if n}
    x = 1 - math.log(3.0) / math.log(max(t.values()) / min(t.values()))
    norm = sum((n / sum(t.values())) ** x for n in t.values())
    for source, n in t.items():
        mine = [r for r in got if r.source == source]
        assert mine[0].weight == pytest.approx((n / sum(t.values())) ** x / norm, abs=1e-8)
        taken, budget = sum(r.copies * r.n_tokens for r in mine), n * (max(t.values()) / n) ** (1 - x)
        assert budget - 14 <= taken <= budget + 1e-6
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
        # Within a block the partial pass is a prefix of the block's permutation, and blocks are taken one after the other.
        assert min(r.copies for r in mine) >= 1
    assert {r.copies for r in got if r.source == "empty"} == {1}
    assert mixing.mixed(docs, repeat=3.0, blocks=blocks).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("blocks", [1, 8, mixing.BLOCKS])
def test_places_in_the_mixture(spark, blocks):
    """Every source is a permutation from 0; the last, partial pass is its beginning, whole blocks one after the other."""
    rows, docs = mixed_rows(spark)
    got = mixing.mix(docs, repeat=3.0, blocks=blocks, places=True).collect()
    again = mixing.mix(docs.repartition(9), repeat=3.0, blocks=blocks, places=True).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    for source in {r.source for r in got}:
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.position)
        seen = [r.position for r in mine if r.doc_id != 502]
        assert len(set(seen)) == len(seen) and mine[0].position == 0 and mine[-1].position <= len(mine) - 1
        assert [r.copies for r in mine] == sorted((r.copies for r in mine), reverse=True)
        blocks_seen = [r.block for r in mine]
        assert sum(a != b for a, b in zip(blocks_seen, blocks_seen[1:], strict=False)) == len(set(blocks_seen)) - 1


def test_mixing_to_an_entropy_and_a_budget(spark):
    rows, docs = mixed_rows(spark)
    got = mixing.mix(docs, entropy=0.8, budget=400).collect()
    weight = {r.source: r.weight for r in got if r.weight}
    assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(0.8 * math.log(len(weight)), abs=1e-6)
    for source, w in weight.items():
        taken = sum(r.copies * r.n_tokens for r in got if r.source == source)
        assert 400 * w - 8 <= taken <= 400 * w + 1e-6
    again = mixing.mix(docs.repartition(7), entropy=0.8, budget=400).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_of_nothing(spark):
    _, docs = mixed_rows(spark)
    assert mixing.mix(docs.limit(0), places=True).count() == 0
    long = docs.unionByName(docs.limit(1).withColumn("text", F.repeat(F.lit("word "), 200_000)))
    assert max(r.n_tokens for r in mixing.mix(long).collect()) == 200_000
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.copies for r in mixing.mix(docs.where("source = 'empty'")).collect()} == {1}
    assert {r.copies for r in mixing.mix(docs.where("source = 'mid'")).collect()} == {1}
