"""Spelling variants by pivotal grams.

Words are near if one inserted, deleted or replaced code point turns one into the other.
All bigrams are put in one global order, the rarest first. A word's *prefix* is every place
whose bigram is not above its third rarest one. One edit spoils at most one of two disjoint
bigrams, so two disjoint places of the prefix are enough to index a word: its
*pivots*, chosen by dynamic programming over the places so that the words that hold them are fewest.
If a's third bigram is not above b's in the order, and both are near, a pivot of a that the
edit left whole lies in b's prefix, at most one place away. So pivots are joined with the prefixes
of the other words, and every near pair is found from one side at least.

Position limits: a whole pivot has the edit on one side, so the other side is equal, and of the
side with the edit either the first or the second half is equal too. What must be equal, with
the pivot's place and the length of the indexed word, is the key of the join; the prefix side
asks for the three lengths in reach. So a key is shared by words that have more than half of their
code points in common, however frequent a bigram is, and the pairs that meet are verified by
their edit distance inside the join.

A word of over 64 code points, where one bigram may stand at thousands of places, is looked up by its two
halves instead, one of which any edit leaves whole.

A word's form is its near word of the largest count, if that is at least ten times its own;
following forms multiplies the count by ten at every step, so roots are reached
in a few rounds of pointer doubling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import UPPER, stored

#: The letters of a word after A-Z are lower-cased: a-z and the code points from LATIN on, LETTERS in all.
LATIN, LATIN_END = 0xC0, 0xFF
LETTERS = 26 + LATIN_END - LATIN + 1
#: Code points of a word and occurrences at least, and how much more frequent a form is.
LENGTH, COUNT, TIMES = 7, 2, 10
#: Every this many occurrences, by a hash of document and run, one loses a code point.
DAMAGE = 31
#: Code points of a word above which it is looked up by halves.
LONG = 64
#: Words are laid out this many code points at a time.
BLOCK = 1 << 19


def damaged(key: Column, run: Column, every: int = DAMAGE) -> Column:
    """``run`` without the code point that its hash names, where the hash says so. A null key counts as empty."""
    h = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int | None = DAMAGE) -> DataFrame:
    """word, n: the distinct words of at least 7 code points that occur at least twice, counted over all whole texts."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, UPPER.lower())
    long = F.lit(f"[a-z\\u{LATIN:04X}-\\u{LATIN_END:04X}]{{{LENGTH},}}+")
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(lower, long, F.lit(0))).alias("run"))
    word = F.col("run") if every is None else damaged(F.col("key"), F.col("run"), every)
    found = runs.select(word.alias("word")).where(F.length("word") >= LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)


def _letters(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters of all words, laid end to end, and the words' lengths."""
    given = batch.to_pylist()
    codes = np.frombuffer("".join(given).encode("utf-32-le"), np.uint32).astype(np.int32)
    return np.where(codes < 128, codes - ord("a"), codes - LATIN + 26), np.fromiter(map(len, given), np.int64, len(given))


def grams(found: DataFrame) -> np.ndarray:
    """How many places of distinct words hold each bigram: an array over all LETTERS ** 2 pairs of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**2, np.int64)
        for batch in batches:
            if batch.num_rows:
                letters, size = _letters(batch.column(0))
                code = letters[:-1].astype(np.int64) * LETTERS + letters[1:]
                inside = np.ones(len(letters), bool)
                inside[np.cumsum(size) - 1] = False
                total += np.bincount(code[inside[:-1]], minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    out = np.zeros(LETTERS**2, np.int64)
    for row in found.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


def choose(ranks: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the order of the third rarest bigram, which places form the prefix, and the two pivots.

    ``ranks``: the order of each place's bigram, words as rows, with a number above all ranks behind a word's end.
    ``cost``: the words that hold it. The pivots are the cheapest two places of the prefix
    that are two or more apart, by dynamic programming over the places; the first of equal ones.
    """
    last = np.partition(ranks, 2, axis=1)[:, 2]
    prefix = ranks <= last[:, None]
    price = np.where(prefix, cost, np.iinfo(np.int64).max // 4)
    n, places = price.shape
    row = np.arange(n)
    one, pair = price[:, 0].copy(), np.full(n, np.iinfo(np.int64).max)
    one_at, pair_at = np.zeros(n, np.int32), np.zeros((n, 2), np.int32)
    for p in range(2, places):
        # ``one`` is the cheapest place up to p - 2.
        better = one + price[:, p] < pair
        pair = np.where(better, one + price[:, p], pair)
        pair_at[better] = np.stack([one_at, np.full(n, p)], axis=1)[better]
        cheaper = price[:, p - 1] < one
        one = np.where(cheaper, price[:, p - 1], one)
        one_at = np.where(cheaper, p - 1, one_at)
    assert prefix[row, pair_at[:, 0]].all() and prefix[row, pair_at[:, 1]].all()
    return last, prefix, pair_at


def places(found: DataFrame) -> DataFrame:
    """``found`` (word, n) with the columns last, pivots and prefix, the latter two arrays of places from 0."""
    count = grams(found)
    order = np.empty(len(count), np.int32)
    order[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))

    def lay(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters, size = _letters(batch.column(0))
        start = np.cumsum(size) - size
        width = int(size.max()) - 1
        at = start[:, None] + np.arange(width)
        inside = np.arange(width) < (size - 1)[:, None]
        at = np.where(inside, at, 0)
        code = letters[at].astype(np.int64) * LETTERS + letters[at + 1]
        last, prefix, pivots = choose(np.where(inside, order[code], np.iinfo(np.int32).max), np.where(inside, count[code], 0))
        total = np.concatenate([[0], np.cumsum(prefix.sum(axis=1))])
        pivot_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(size) + 1, 2), pa.int32()), pa.array(pivots.ravel(), pa.int32()))
        prefix_lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(np.nonzero(prefix)[1], pa.int32()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(last, pa.int32()), pivot_lists, prefix_lists], ["word", "n", "last", "pivots", "prefix"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # By length, so that a block of equal rows has little room behind its words, and a giant word is alone.
            size = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
            by = np.argsort(size, kind="stable")
            batch, size = batch.take(pa.array(by)), size[by]
            begin = 0
            for i in range(1, len(size) + 1):
                if i == len(size) or (i + 1 - begin) * int(size[i]) > BLOCK:
                    yield lay(batch.slice(begin, i - begin))
                    begin = i

    return found.select("word", "n").mapInArrow(run, "word string, n long, last int, pivots array<int>, prefix array<int>")


def _key(kind: int, size: Column, at: Column, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), size, at, *parts)


def _sides(word: Column, at: Column, size: Column, shift: Column) -> Column:
    """The four keys of a bigram at ``at``, for an indexed word of ``size`` code points whose bigram is ``shift`` places earlier.

    Null where ``word`` is too short for the equal parts. On the side of the edit either the first or the second half is equal.
    """
    own = F.length(word)
    piece = lambda start, n: F.substring(word, start + 1, n)
    behind, before = size - at - 2, at - shift
    first_behind, first_before = F.floor(behind / 2).cast("int"), F.floor(before / 2).cast("int")
    second_behind, second_before = behind - first_behind, before - first_before
    left = (shift == 0) & (behind >= 0)
    right = (own - size == shift) & (before >= 0)
    return F.array(
        F.when(left & (own - at - 2 >= first_behind), _key(0, size, at, piece(F.lit(0), at + 2 + first_behind))),
        F.when(left & (own - at - 2 >= second_behind), _key(1, size, at, piece(F.lit(0), at + 2), piece(own - second_behind, second_behind))),
        F.when(right & (at >= first_before), _key(2, size, before, piece(F.lit(0), first_before), piece(at, own - at))),
        F.when(right & (at >= second_before), _key(3, size, before, piece(at - second_before, own - at + second_before))),
    )


def _halves(word: Column, size: Column) -> Column:
    """The two keys of a long word, for an indexed word of ``size`` code points; null where ``word`` is too short for the half."""
    first = F.floor(size / 2).cast("int")
    second, own = size - first, F.length(word)
    return F.array(
        F.when(own >= first, _key(4, size, F.lit(0), F.substring(word, F.lit(1), first))),
        F.when(own >= second, _key(5, size, F.lit(0), F.substring(word, own - second + 1, second))),
    )


def near(found: DataFrame) -> DataFrame:
    """Both directions of every near pair of ``found`` (word, n), once each: word, n, other, other_n.

    Pairs of words of up to LONG code points meet by their pivots, those with a longer word by halves.
    """
    size = F.length("word")
    laid = stored(places(found.where(size <= LONG)), "places")
    index = laid.select("word", "n", "last", F.explode("pivots").alias("at"))
    index = index.select("word", "n", "last", F.explode(_sides(F.col("word"), F.col("at"), size, F.lit(0))).alias("key"))
    ask = laid.select("word", "n", "last", F.explode("prefix").alias("at"))
    # The indexed word may be one shorter, equal or one longer; the bigram lies at the same place, or further by the same number.
    reach = F.array(*(F.struct(F.lit(d).alias("less"), F.lit(s).alias("shift")) for d, s in ((0, 0), (1, 0), (-1, 0), (1, 1), (-1, -1))))
    ask = ask.select("word", "n", "last", "at", F.explode(reach).alias("r"))
    sides = _sides(F.col("word"), F.col("at"), size - F.col("r.less"), F.col("r.shift"))
    ask = ask.select("word", "n", "last", F.explode(sides).alias("key"))

    long = found.where(size >= LONG).select("word", "n", F.lit(0).alias("last"))
    index = index.union(long.select("word", "n", "last", F.explode(_halves(F.col("word"), size)).alias("key")))
    less = F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("less")
    ask = ask.union(long.select("word", "n", "last", less).select("word", "n", "last", F.explode(_halves(F.col("word"), size - F.col("less"))).alias("key")))

    a, b = index.where("key is not null").alias("a"), ask.where("key is not null").alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last")) & (F.col("a.word") != F.col("b.word"))
    # The distance is 1 between different words, and -1 where it is above the threshold.
    close = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    met = a.join(b, meet & close)
    first = F.col("a.word") < F.col("b.word")
    pick = lambda c, x, y: F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    pairs = met.select(pick("word", "a", "b").alias("word"), pick("n", "a", "b").alias("n"), pick("word", "b", "a").alias("other"), pick("n", "b", "a").alias("other_n"))
    pairs = stored(pairs.distinct(), "near")
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root for ``forms`` (word, form), where counts grow TIMES-fold with each step and reach at most ``most``."""
    steps = max(1, int(math.log(max(most, COUNT) / COUNT, TIMES)) + 1)
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int | None = DAMAGE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters with A-Z lower-cased, of at least 7 code points, that occur at least twice over all whole
    texts; ``every`` deletes a code point from one in so many runs first (None: from none). n_near counts the near words;
    form is the one of largest n, the smallest of equal ones, if its n is at least ten times the word's, else null, as form_n;
    root follows forms to the last. Null and empty texts have no words, rows that repeat count again, a null key counts as
    an empty one, other columns are not read, and no words give an empty result.
    """
    found = stored(words(docs, key, text, every), "words")
    links = near(found)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    around = links.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= TIMES * F.col("n")
    around = around.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    around = stored(around, "around")
    most = found.agg(F.max("n")).first()[0] or COUNT
    ends = roots(around.where("form is not null"), most)
    joined = found.join(around, "word", "left").join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


#: Near pairs by the strings that deleting each code point leaves, instead of pivots; CRC-32 by its table.
SQL = f"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
        '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents),
each AS (SELECT k, run, count(*) AS n FROM runs GROUP BY k, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(k || ':' || run))),
        lambda i: ('0x' || substr(hex(encode(k || ':' || run)), 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, bits.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each, bits),
spoilt AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)),
pairs AS (SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
around AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-b_n, b)) AS form, max(b_n) AS form_n, max(a_n) AS n FROM pairs GROUP BY a),
forms AS (SELECT word, form, form_n FROM around WHERE form_n >= {TIMES} * n),
walk AS (SELECT word, form AS root FROM forms UNION SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root),
ends AS (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(a.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN around a USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)"""
