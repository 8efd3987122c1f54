"""Secrets by the Shannon entropy of sliding windows, in DataFrame functions only.

Base spans are what three patterns match: assignments of a long value, access keys, runs of hex digits. They always
stay. Candidate strings are the base spans' values and, for each character class, the runs of its characters that fill a window.
A window slides over a candidate; the counts of its characters change by the one that
leaves and the one that enters, and with c log2 c of the two counts the entropy
log2 w - sum(c log2 c) / w changes, so a step costs the same for any window.
Windows that reach the bits of their class and overlap form a span, which is added if the
allow list does not know it as harmless (words, plain numbers, sequences, placeholders, UUIDs, digests, parts
of addresses) and no base span touches it.

Long candidates are cut into pieces that overlap by a window less one character, so what a step
keeps is bounded and no window is lost. A text is read once and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.pii import found, let

#: The kinds in their order; what the method adds is the last one.
KINDS = ["assign", "access", "hex", "entropy"]
ADDED = KINDS.index("entropy")

# The base patterns, written so that Java's matcher does not backtrack. Letters are spelt in either case, since
# its flag for that and others' differ outside ASCII.
_WORDS = ["password", "passwd", "secret", "token"]
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in _WORDS) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE = {
    "assign": rf"""(?:{_EITHER})["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
    "access": "AKIA[A-Z0-9]++",
    "hex": "[0-9a-f]{16,}+",
}
HINT = {"assign": f"(?:{_EITHER})", "access": "AKIA", "hex": "[0-9a-f]{16}"}
#: The value at the end of an assignment: what stands in it is no separator and no quote.
_NAME = rf"""^(?:{_EITHER})["']?+\x20*+[:=]\x20*+["']?+"""
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Character classes: the characters of a run, the alphabet that they are counted in (hex digits of either case are one), window, bits.
CLASSES = {
    "hex": ("[0-9A-Fa-f]", "0123456789abcdef", 20, 3.0),
    "base64": ("[A-Za-z0-9+/_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 3.9),
}
#: Window for values of base spans, which may have any of these characters; shorter values are one window.
VALUE = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", 24)
#: Characters of a candidate that are walked through at a time.
PIECE = 128

# What is known to be harmless: by the string itself, and by what stands before it where it begins a run.
ALLOWED = [
    "^[A-Za-z/_-]+$",
    "^[0-9+/_-]+$",
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "(?i)abcdefgh|12345678|example|sample|placeholder|changeme|dummy|xxxxxx|000000",
    "(?i)sha-?(1|224|256|384|512)[_-]",
]
ALLOWED_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|checksum|digest|integrity|commit|revision|etag|base64)[\"']?[ ,:=/-]*[\"']?\z|(://|www\.)[^ ]*\z"
CONTEXT = 32
#: Decimals of reported bits.
DECIMALS = 6


def _table(window: int) -> Column:
    """c log2 c for the counts 0 to ``window``."""
    return F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))


def _slide(codes: Column, size: int, window: int) -> Column:
    """The entropy of every window of an array of letter numbers from 0, at least ``window`` of them: an array of doubles."""
    weight = _table(window)
    first = F.slice(codes, 1, window)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(first, lambda c: c == k)))

    def of(start: Column) -> Column:
        total = F.aggregate(start, F.lit(0.0), lambda acc, c: acc + F.get(weight, c))
        state = F.struct(start.alias("counts"), total.alias("sum"), F.array(total).alias("sums"))

        def step(now: Column, i: Column) -> Column:
            out, into = F.get(codes, i), F.get(codes, i + window)
            less, more = F.get(now["counts"], out), F.get(now["counts"], into)
            moved = now["sum"] + F.get(weight, less - 1) - F.get(weight, less) + F.get(weight, more + 1) - F.get(weight, more)
            total = F.when(out == into, now["sum"]).otherwise(moved)
            counts = F.transform(now["counts"], lambda c, k: c + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.concat(now["sums"], F.array(total)).alias("sums"))

        steps = F.slice(F.sequence(F.lit(0), F.size(codes)), 1, F.size(codes) - window)
        return F.aggregate(steps, state, step, lambda end: F.transform(end["sums"], lambda s: F.lit(math.log2(window)) - s / window))

    return let(counts, of)


def window_bits(said: Column, alphabet: str, window: int) -> Column:
    """The entropy of every window of a string over ``alphabet``, from its first to its last; empty if it is shorter than one."""

    def pieces(cut: Column) -> Column:
        behind = lambda i: F.substring(F.coalesce(F.get(cut, i + 1), F.lit("")), 1, window - 1)
        whole = F.filter(F.transform(cut, lambda x, i: F.concat(x, behind(i))), lambda x: F.length(x) >= window)
        letters = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.instr(F.lit(alphabet), F.substring(x, i, F.lit(1))) - 1)
        return F.flatten(F.transform(whole, lambda x: let(letters(x), lambda codes: _slide(codes, len(alphabet), window))))

    return let(F.regexp_extract_all(said, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), pieces)


def _bits_of_value(said: Column) -> Column:
    """The largest window entropy of a base span's value; one that is shorter than a window is a window of its own."""
    alphabet, window = VALUE
    counted = F.transform(F.split(F.lit(alphabet), "(?!$)"), lambda c: F.length(said) - F.length(F.replace(said, c, F.lit(""))))
    short = F.aggregate(counted, F.lit(0.0), lambda acc, c: acc + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    short = F.log2(F.length(said).cast("double")) - short / F.length(said)
    return F.when(F.length(said) < window, short).otherwise(F.array_max(window_bits(said, alphabet, window)))


def _base(text: Column, kind: str) -> Column:
    """Base spans of a kind: start, end, kind, bits."""

    def span(s: Column) -> Column:
        value = F.regexp_replace(s["said"], _NAME, "") if kind == "assign" else s["said"]
        fits = F.length(value) >= LEAST[kind]
        bits = F.when(fits, F.round(_bits_of_value(value), DECIMALS))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), bits.alias("bits"))

    return F.filter(F.transform(found(text, BASE[kind], HINT[kind]), span), lambda s: s["bits"].isNotNull())


def _runs(text: Column, pattern: str, hint: str) -> Column:
    """``found`` with ``before``: what stands between a match and the one before it, its last CONTEXT code points."""
    between = F.split(text, pattern, -1)
    before = lambda s, gap: s.withField("before", F.right(gap, F.lit(CONTEXT)))
    return let(F.struct(found(text, pattern, hint).alias("s"), between.alias("b")), lambda z: F.transform(z["s"], lambda s, i: before(s, F.get(z["b"], i))))


def _dense(text: Column, name: str) -> Column:
    """Spans of overlapping windows of a class with enough entropy that the allow list does not know: start, end, kind, bits."""
    letters, alphabet, window, least = CLASSES[name]
    run = f"{letters}{{{window},}}+"

    def spans(s: Column) -> Column:
        said = F.lower(s["said"]) if alphabet == alphabet.lower() else s["said"]

        def joined(bits: Column) -> Column:
            hits = F.filter(F.transform(bits, lambda b, i: F.when(b >= least, i)), lambda i: i.isNotNull())
            most = F.round(F.array_max(bits), DECIMALS)
            ends = lambda h: F.filter(h, lambda x, i: (i == F.size(h) - 1) | (F.get(h, i + 1) - x >= window))
            starts = lambda h: F.filter(h, lambda x, i: (i == 0) | (x - F.get(h, i - 1) >= window))
            span = lambda a, b: F.struct((s["start"] + a).alias("start"), (s["start"] + b + window).alias("end"), F.lit(ADDED).alias("kind"), most.alias("bits"))
            return let(hits, lambda h: let(ends(h), lambda e: F.transform(starts(h), lambda a, i: span(a, F.get(e, i)))))

        def harmless(x: Column) -> Column:
            own = F.substring(s["said"], x["start"] - s["start"] + 1, x["end"] - x["start"])
            known = (x["start"] == s["start"]) & F.rlike(s["before"], F.lit(ALLOWED_BEFORE))
            for pattern in ALLOWED:
                known = known | F.rlike(own, F.lit(pattern))
            return known

        return F.filter(let(window_bits(said, alphabet, window), joined), lambda x: ~harmless(x))

    return F.flatten(F.transform(_runs(text, run, f"{letters}{{{window}}}"), spans))


def _largest_so_far(xs: Column) -> Column:
    """The running maximum of an array of integers, in blocks so that long arrays stay cheap."""
    width = 256

    def add(ys: Column) -> Column:
        more = lambda acc, y: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), y)))
        return F.slice(F.aggregate(ys, F.array(F.lit(-(2**31))), more), F.lit(2), F.size(ys))

    def joined(blocks: Column) -> Column:
        tops = add(F.transform(blocks, lambda x: F.element_at(x, -1)))
        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: F.greatest(y, F.get(t, i - 1)))))))

    def blocks(ys: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / width).cast("int"))
        return let(F.transform(starts, lambda b: add(F.slice(ys, b * width + 1, F.lit(width)))), joined)

    return let(xs, lambda ys: F.when(F.size(ys) > 0, blocks(ys)).otherwise(ys))


def _merged(spans: Column) -> Column:
    """Sorted ``spans`` of one kind as the runs that overlap without a break, each with the bits of its first one."""

    def of(s: Column) -> Column:
        last = F.size(s) - 1

        def runs(far: Column) -> Column:
            first = F.filter(s, lambda x, i: (i == 0) | (x["start"] >= F.get(far, i - 1)))
            ends = F.filter(far, lambda x, i: (i == last) | (F.get(s, i + 1)["start"] >= x))
            whole = lambda x, e: F.struct(x["start"].alias("start"), e.alias("end"), x["kind"].alias("kind"), x["bits"].alias("bits"))
            return let(ends, lambda e: F.transform(first, lambda x, i: whole(x, F.get(e, i))))

        return let(_largest_so_far(F.transform(s, lambda x: x["end"])), runs)

    return F.when(F.size(spans) > 1, let(spans, of)).otherwise(spans)


def _free(base: Column, dense: Column) -> Column:
    """The ``dense`` spans that no ``base`` span touches: of all spans in order of their start, none before reaches over it, none behind starts in it."""
    mark = lambda own: lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("span"))

    def of(every: Column) -> Column:
        reach = _largest_so_far(F.transform(every, lambda x: F.when(x["own"], -1).otherwise(x["span"]["end"])))
        # From the back: the largest negative start is the nearest one behind.
        behind = F.reverse(_largest_so_far(F.reverse(F.transform(every, lambda x: F.when(x["own"], -(2**31 - 1)).otherwise(-x["start"])))))
        clear = lambda r, b: F.filter(every, lambda x, i: x["own"] & (F.get(r, i) <= x["start"]) & (-F.get(b, i) >= x["span"]["end"]))
        return let(F.struct(reach.alias("r"), behind.alias("b")), lambda z: F.transform(clear(z["r"], z["b"]), lambda x: x["span"]))

    both = let(F.array_sort(F.concat(F.transform(base, mark(False)), F.transform(dense, mark(True)))), of)
    return F.when((F.size(base) > 0) & (F.size(dense) > 0), both).otherwise(dense)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans and dense.

    ``spans`` is an array of start, kind (a place in KINDS), end and bits, sorted by start and kind; positions count code
    points, ends are exclusive; bits is the largest window entropy of the candidate that the span begins in. ``dense``
    counts all spans of dense windows, those that a base span touches included. A null or empty text has no spans, rows that repeat are
    scanned each for itself, other columns are not read.
    """
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = F.col("text")
    given = given.select("doc_id", let(F.struct(
        F.concat(*(_base(whole, kind) for kind in BASE)).alias("base"), F.array_sort(F.concat(*(_dense(whole, name) for name in CLASSES))).alias("dense")
    ), lambda z: F.struct(z["base"].alias("base"), _merged(z["dense"]).alias("dense"))).alias("z"))
    free = _free(F.col("z.base"), F.col("z.dense"))
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["bits"].alias("bits"))
    return given.select("doc_id", F.array_sort(F.transform(F.concat("z.base", free), order)).alias("spans"), F.size("z.dense").cast("long").alias("dense"))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, base counts per kind, the digest of the base spans, all spans as text, and what the windows say: counts and bits."""
    names = F.array(*(F.lit(k) for k in KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *(count(KINDS.index(k)).alias(f"n_{k}") for k in BASE),
        F.sha2(said(F.filter("spans", lambda s: s["kind"] != ADDED)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        count(ADDED).alias("n_entropy"), "dense", F.array_max(F.transform("spans", lambda s: s["bits"])).alias("max_bits"),
    )


_RE2 = {
    "assign": rf"""(?:{_EITHER})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
} | {f"{name}!": f"{letters}{{{window},}}" for name, (letters, _, window, _) in CLASSES.items()}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same with one row per character of every window.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _RE2.items())}) AS p(kind, pattern)),
m AS (SELECT r, kind, text, regexp_extract_all(text, pattern) AS said, regexp_split_to_array(text, pattern) AS gaps FROM d, p
    WHERE regexp_matches(text, pattern)),
s AS (SELECT r, kind, said[i] AS said, right(gaps[i], {CONTEXT}) AS before, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(said[1:i - 1], lambda x: length(x))), 0))::BIGINT AS pos
    FROM m, unnest(range(1, len(said) + 1)) AS u(i)),
v AS (SELECT r, kind, said, before, pos, length(said) AS size, CASE kind WHEN 'assign' THEN regexp_replace(said, {_quoted(_NAME.replace("?+", "?").replace("*+", "*"))}, '')
    WHEN 'hex!' THEN lower(said) ELSE said END AS value FROM s),
c AS (SELECT *, CASE kind WHEN 'hex!' THEN {CLASSES["hex"][2]} WHEN 'base64!' THEN {CLASSES["base64"][2]} ELSE least({VALUE[1]}, length(value)) END AS w,
    row_number() OVER () AS id FROM v WHERE kind LIKE '%!' OR length(value) >= CASE kind WHEN 'assign' THEN {LEAST["assign"]} WHEN 'access' THEN {LEAST["access"]} ELSE {LEAST["hex"]} END),
n AS (SELECT id, i, w, ch, count(*) AS n FROM (SELECT id, i, w, unnest(string_split(substr(value, i + 1, w), '')) AS ch FROM c, unnest(range(length(value) - w + 1)) AS u(i)) GROUP BY ALL),
e AS (SELECT id, i, log2(w) - sum(n * log2(n)) / w AS bits FROM n GROUP BY id, i, w),
b AS (SELECT id, round(max(bits), {DECIMALS}) AS bits FROM e GROUP BY id),
base AS (SELECT r, kind, pos AS a, pos + size AS z, bits FROM c JOIN b USING (id) WHERE kind NOT LIKE '%!'),
hits AS (SELECT id, r, pos + i AS a, pos + i + w AS z, pos + i >= coalesce(max(pos + i + w) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new
    FROM e JOIN c USING (id) WHERE kind LIKE '%!' AND e.bits >= CASE kind WHEN 'hex!' THEN {CLASSES["hex"][3]} ELSE {CLASSES["base64"][3]} END),
dense AS (SELECT id, r, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new::INT) OVER (PARTITION BY id ORDER BY a) AS g FROM hits) GROUP BY id, r, g),
odd AS (SELECT r, a, z, b.bits AS bits, a >= coalesce(max(z) OVER (PARTITION BY r ORDER BY a, z, b.bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new
    FROM dense JOIN b USING (id) JOIN c USING (id, r) WHERE NOT ({" OR ".join(f"regexp_matches(substr(said, a - pos + 1, z - a), {_quoted(x)})" for x in ALLOWED)}
        OR (a = pos AND regexp_matches(before, {_quoted(ALLOWED_BEFORE)})))),
whole AS (SELECT r, min(a) AS a, max(z) AS z, arg_min(bits, (a, z, bits)) AS bits FROM (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY a, z, bits) AS g FROM odd) GROUP BY r, g),
every AS (SELECT * FROM base UNION ALL SELECT r, 'entropy', a, z, bits FROM whole
    WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = whole.r AND base.a < whole.z AND whole.a < base.z)),
said AS (SELECT r, kind, a, bits, kind || ':' || a || ':' || z AS t, list_position([{", ".join(map(_quoted, KINDS))}], kind) AS k FROM every)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    sha256(coalesce(string_agg(t, ',' ORDER BY a, k) FILTER (kind <> 'entropy'), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY a, k), '') AS spans,
    count(*) FILTER (kind = 'entropy') AS n_entropy, (SELECT count(*) FROM whole WHERE whole.r = d.r) AS dense, max(bits) AS max_bits
FROM d LEFT JOIN said USING (r) GROUP BY d.r, doc_id"""
