"""The stages of the pipeline against what their operators say, each on its own input."""

import corpus_pipeline
from millrace.llm import mixing, pieces, quality, queries, simhash
from millrace.llm.common import stored
from tests.llm.test_dedup import brute_exact, brute_simhash


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, folder), "stage")
        seen.append((name, before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema.simpleString() == before.schema.simpleString()
    rows = {name: [(r.doc_id, r.text, r.source) for r in before.collect()] for name, before, _ in seen}
    ids = {name: sorted(r.doc_id for r in after.collect()) for name, _, after in seen}

    rejected = {r.doc_id for r in quality.classify(seen[0][1], labels).collect() if r.predicted == 0}
    assert ids["quality"] == sorted(i for i, *_ in rows["quality"] if i not in rejected)
    assert ids["exact dedup"] == sorted({keep for _, keep, _, _ in brute_exact(rows["exact dedup"], True)})
    assert ids["SimHash near-dedup"] == sorted({c for _, _, c in brute_simhash(rows["SimHash near-dedup"], 3, 2)})
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3][1], repeat=2.0).collect()}
    assert ids["mixing"] == sorted(i for i, n in copies.items() for _ in range(n))
    assert min(copies.values()) == 1 and max(copies.values()) <= 2
    text = {i: t for i, t, _ in rows["SentencePiece"]}
    decoded = pieces.decode(seen[4][2], queries.MODEL).collect()
    assert all(r.decoded == (text[r.doc_id] or "") for r in decoded)
    assert {r.doc_id for r in decoded} == set(text)
    assert corpus_pipeline.run(spark, folder).count() == seen[4][2].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_go_row_by_row(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "quite another text of its own that is near to nothing"), (None, "a b c d"), (None, "alone without a name"), (3, "A b c d")]
    rows += [(5, "one two three four five six seven eight"), (5, "One two three four five six seven eight"), (5, "something else entirely, said once")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    kept = {(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()}
    assert {(1, "a b c d"), (2, rows[2][1]), (None, "alone without a name"), (5, rows[8][1])} <= kept
    assert len(kept) == 5 and len({x for x in kept if x[0] == 5}) == 2
    assert simhash.one_of_each(docs).schema.simpleString() == docs.schema.simpleString()


def test_poor_rows_go_row_by_row(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    good, bad = (next(i for i, p in sorted(predicted.items()) if p == wanted and text[i]) for wanted in (1, 0))
    # A clean text under the rejected one's identifier, and both without any.
    more = spark.createDataFrame([(bad, text[good], "en", "s", 1), (None, text[good], "en", "s", 2), (None, text[bad], "en", "s", 3)], SCHEMA)
    kept = [(r.doc_id, r.n_chars) for r in quality.accepted(docs.unionByName(more), labels.where(f"doc_id <> {bad}")).where("n_chars < 4 and source = 's'").collect()]
    assert sorted(kept, key=str) == sorted([(bad, 1), (None, 2)], key=str)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated identifiers, empty and repeated texts: no stage fails or loses a text that nothing is near to."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = docs.orderBy("doc_id").limit(40)
    clean = {r.text for r in first.collect()}
    odd = [(None, None, None, None, None), (None, "", None, "x", None), (3, None, "en", None, 1), (3, "   ", "en", "x", 2)]
    shared = first.selectExpr("7 AS doc_id", "concat(text, ' and a word of my own ', doc_id) AS text", "lang", "cast(null as string) AS source", "n_chars")
    given = docs.unionByName(shared).unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(first)
    given.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    at = str(tmp_path)
    seen, now = [], spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, at), "stage")
        seen.append(now)
    kept = [(r.doc_id, r.text or "") for r in seen[0].collect()]
    after = {r.text or "" for r in seen[1].collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert {t.translate(lower) for _, t in kept} == {t.translate(lower) for t in after}
    rows = [(r.doc_id, r.text) for r in seen[1].collect() if r.doc_id is not None]
    marks = {}
    for i, t in rows:
        marks.setdefault(simhash.fingerprint((t or "").encode(), 3), set()).add((i, t))
    lone = {t for m, texts in marks.items() if len(texts) == 1 and all((m ^ o).bit_count() > 2 for o in marks if o != m) for _, t in texts}
    assert lone and lone <= {r.text for r in seen[2].collect()} and lone <= {r.text for r in seen[3].collect()}
    assert clean and seen[4].select("doc_id").count() >= seen[3].count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
