"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans. A span that its kind's strict pattern and check accept is
a base span and always stays; other proposals (failed checks, looser spellings)
are candidates. Five labelers vote for, against or not at all: the strict pattern (which
has no say on a loose spelling), the check (Luhn, ranges, digit counts), a gazetteer, words of context, and the
characters around the span. Expectation-maximisation over the counts of all vote
patterns estimates how reliable each labeler is and gives every pattern a
probability. A final naive Bayes classifier is trained on these probabilities with
shape features of the span beside the votes; candidates that it accepts and
that touch no base span are added.

Texts are read once; what is kept of a document are its proposals. Votes and
features have few values by construction, so the counts that the model is
trained on fit in one small table however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: The kinds in their order.
KINDS = ["email", "ip", "card", "phone"]

# The strict patterns, written so that Java's matcher neither backtracks nor recurses on long runs. The email and IP
# patterns may only begin where a run begins (or the last match ended), the card pattern takes a run of 12 to 19
# digits as a whole.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
# Looser spellings: kind, pattern, and what a text must contain. Written like the strict ones.
_HEX = "[0-9A-Fa-f]{1,4}"
LOOSE = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]++)++", r"[\[({]at[\])}]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++", " at [A-Za-z0-9-]+ dot "),
    ("ip", rf"(?<![0-9A-Za-z:])(?:{_HEX}:){{7}}+{_HEX}(?![0-9A-Za-z:])", f"[0-9A-Fa-f]:{_HEX}:"),
    ("ip", rf"(?<![0-9A-Za-z:])(?:{_HEX}:){{1,6}}+(?::{_HEX}){{1,6}}+(?![0-9A-Za-z:])", "[0-9A-Fa-f]::[0-9A-Fa-f]"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}+(?![0-9])(?!\.[0-9])", "[0-9]{4}[._/][0-9]{4}"),
    ("phone", r"(?<![0-9+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9]{3}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9+.()/-])(?:\(0[0-9]{2,4}\)|0[0-9]{2,4})[ /-][0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}+(?![0-9])", "0[0-9]{2,4}\\)?[ /-][0-9]"),
]

# Gazetteers and words of context. Fixed values.
TOP_DOMAINS = "com org net edu gov mil int info biz io co de fr es it nl uk us ca au jp cn in br eu ch at be se no dk pl ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CUES = {
    "email": "mail|contact|write|reach|@",
    "ip": r"\bip\b|host|server|addr|client|from|ping",
    "card": "card|visa|master|amex|payment|pay|credit|debit|account|no\\.",
    "phone": "tel|phone|call|fax|mobile|cell|contact|dial",
}
AGAINST = r"version|license|token|sha|isbn|section|chapter|release|build|serial|order|hash|key *= *$"
CONTEXT = 24

VOTES = ["pattern", "check", "gazetteer", "context", "around"]
ROUNDS = 25
#: Pseudo counts of each vote given a label, and of each feature value.
PRIOR = 1.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def running(lengths: Column) -> Column:
    """Sums of all earlier entries of an array of numbers, in blocks so that long arrays stay cheap."""
    width = 256

    def add(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def joined(inner: Column) -> Column:
        outer = add(F.transform(inner, lambda x: F.element_at(x, -1)))
        rows = let(outer, lambda o: F.transform(inner, lambda x, i: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + F.get(o, i))))
        return F.flatten(rows)

    def blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int"))
        return let(F.transform(starts, lambda b: add(F.slice(xs, b * width + 1, F.lit(width)))), joined)

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, blocks(xs)).otherwise(F.array().cast("array<int>")))


def found(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches: an array of start, end (in code points) and the matched text."""

    def spans(z: Column) -> Column:
        steps = F.transform(z["matches"], lambda m, i: F.length(m) + F.length(F.get(z["between"], i)))
        starts = lambda before: F.transform(before, lambda x, i: x + F.length(F.get(z["between"], i)))
        return let(
            starts(running(steps)),
            lambda at: F.transform(
                z["matches"],
                lambda m, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("said")),
            ),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("between"))
    return F.when(F.rlike(text, F.lit(hint)), let(both, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,said:string>>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass the Luhn check."""
    s = F.reverse(_digits(x))
    digit = lambda i: F.ascii(F.substring(s, i, F.lit(1))) - 48
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CHECK: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.rlike(x, F.lit(rf"^(?:{_PART}|0+)\.(?:{_PART}|0+)\.(?:{_PART}|0+)\.(?:{_PART}|0+)$")),
    "card": luhn,
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}
_GAZETTEER: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.when(F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS), 1).otherwise(-1),
    "ip": lambda x: F.when(F.rlike(x, F.lit(r"^(0|22[4-9]|2[3-9][0-9]|[3-9][0-9]{2})\.")), -1).otherwise(0),
    "card": lambda x: F.when(F.rlike(_digits(x), F.lit(CARD_PREFIX)), 1).otherwise(-1),
    "phone": lambda x: F.when(F.rlike(x, F.lit(rf"^\+({'|'.join(CALLING_CODES)})")), 1).otherwise(0),
}


def _around(c: Column) -> Column:
    """A class for the character beside a span."""
    return (
        F.when(c == "", "edge").when(F.rlike(c, F.lit(r"\s")), "space").when(F.rlike(c, F.lit("[0-9]")), "digit")
        .when(F.rlike(c, F.lit(r"\p{L}")), "letter").when(F.rlike(c, F.lit("[\"'=/:#]")), "technical").otherwise("mark")
    )


def _proposal(text: Column, kind: str, strict: Column, valid: Column, span: Column) -> Column:
    """A span with its votes and features."""
    said, start = span["said"], span["start"]
    context = F.lower(F.substring(text, F.greatest(start + 1 - CONTEXT, F.lit(1)), F.least(start, F.lit(CONTEXT))))
    left = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    right = F.substring(text, span["end"] + 1, F.lit(1))
    l_class, r_class = _around(left), _around(right)
    votes = F.array(
        F.when(~strict, 0).when(valid, 1).otherwise(-1),
        F.when(valid, 1).otherwise(-1),
        _GAZETTEER[kind](said),
        F.when(F.rlike(context, F.lit(AGAINST)), -1).when(F.rlike(context, F.lit(CUES[kind])), 1).otherwise(0),
        F.when(l_class.isin("digit", "letter", "technical") | r_class.isin("digit", "letter"), -1).otherwise(1),
    )
    separators = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(said, "[^ ().@:-]", ""), ""))), "")
    features = F.array(
        F.concat(F.lit("left "), l_class),
        F.concat(F.lit("right "), r_class),
        F.concat(F.lit("size "), F.least(F.floor(F.log2(F.length(said))), F.lit(7)).cast("string")),
        F.concat(F.lit("separators "), separators),
    )
    return F.struct(
        start.alias("start"), span["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), (strict & valid).alias("base"),
        votes.alias("votes"), features.alias("features"),
    )


def proposals(text: Column) -> Column:
    """All proposed spans of a text, sorted by start and kind."""

    def of(kind: str, pattern: str, hint: str, strict: bool) -> Column:
        check = CHECK[kind] if strict or kind in ("card", "phone") else lambda _: F.lit(True)
        return F.transform(found(text, pattern, hint), lambda s: _proposal(text, kind, F.lit(strict), check(s["said"]), s))

    strict = F.concat(*(of(kind, STRICT[kind], HINT[kind], True) for kind in KINDS))
    loose = F.concat(*(of(kind, pattern, hint, False) for kind, pattern, hint in LOOSE))
    free = lambda spans: F.filter(loose, lambda s: ~F.exists(spans, lambda b: b["base"] & _touch(b, s)))
    return let(strict, lambda spans: F.array_sort(F.concat(spans, free(spans))))


def _touch(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _estimate(patterns: Column) -> Column:
    """Expectation-maximisation over an array of (votes, n): the probability of each pattern.

    The state is the share of true spans and, per labeler, label and vote, the probability
    of the vote where the labeler votes; one that has no say counts for nothing. It starts with labelers
    that are right four times in five and runs a fixed number of rounds.
    """
    cells = [(j, y, v) for j in range(len(VOTES)) for y in (0, 1) for v in (-1, 0, 1)]
    first = [F.lit({1: 0.8, 0: 0.5, -1: 0.2}[v * (2 * y - 1)]) for _, y, v in cells]
    initial = F.struct(F.lit(0.5).alias("share"), F.array(*first).alias("vote"))

    def posterior(state: Column, votes: Column) -> Column:
        odds = F.log(state["share"] / (1 - state["share"]))
        for j in range(len(VOTES)):
            at = votes[j] + 1
            said = F.log(F.get(state["vote"], 6 * j + 3 + at) / F.get(state["vote"], 6 * j + at))
            odds = odds + F.when(votes[j] == 0, 0.0).otherwise(said)
        return 1 / (1 + F.exp(-odds))

    def step(state: Column, _: Column) -> Column:
        weighted = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * posterior(state, p["votes"])).alias("t")))
        total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, p: acc + f(p))

        def maximise(w: Column) -> Column:
            true, every = total(w, lambda p: p["t"]), total(w, lambda p: p["n"])
            share = lambda j, y, fits: total(w, lambda p: F.when(fits(p["votes"][j]), p["t"] if y else p["n"] - p["t"]).otherwise(0.0))
            votes = [(share(j, y, lambda x, v=v: x == v) + PRIOR) / (share(j, y, lambda x: x != 0) + 2 * PRIOR) for j, y, v in cells]
            return F.struct(((true + PRIOR) / (every + 2 * PRIOR)).alias("share"), F.array(*votes).alias("vote"))

        return let(weighted, maximise)

    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), initial, step)
    return let(state, lambda s: F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), posterior(s, p["votes"]).alias("p"))))


def train(proposed: DataFrame) -> DataFrame:
    """The span classifier: kind, value (a vote or feature; null for the prior), weight in log odds.

    ``proposed``: a column ``spans`` of proposals.
    """
    each = proposed.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").cast("double").alias("n"))
    counts = stored(each, "votes")
    patterns = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    by_kind = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    likely = by_kind.select("kind", F.explode(_estimate(F.col("patterns"))).alias("e")).select("kind", "e.*")
    soft = counts.join(likely, ["kind", "votes"]).select("kind", "n", "p", F.concat(F.array(F.lit(None).cast("string")), _values()).alias("values"))
    sums = soft.select("kind", F.explode("values").alias("value"), (F.col("n") * F.col("p")).alias("t"), (F.col("n") * (1 - F.col("p"))).alias("f"))
    sums = sums.groupBy("kind", "value").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    whole = sums.where("value is null").select("kind", F.col("t").alias("all_t"), F.col("f").alias("all_f"))
    odds = F.log((F.col("t") + PRIOR) / (F.col("f") + PRIOR))
    rest = odds - F.log((F.col("all_t") + 3 * PRIOR) / (F.col("all_f") + 3 * PRIOR))
    return sums.join(whole, "kind").select("kind", "value", F.when(F.col("value").isNull(), odds).otherwise(rest).alias("weight"))


def _values(span: Column | None = None) -> Column:
    """A span's votes and features as one array of words."""
    votes, features = (F.col("votes"), F.col("features")) if span is None else (span["votes"], span["features"])
    return F.concat(F.transform(votes, lambda v, i: F.concat_ws(" ", F.lit("vote"), i.cast("string"), v.cast("string"))), features)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (an array of start, end, kind, base), sorted by start and kind.

    Positions count code points, ends are exclusive. A null or empty text has no
    spans; without any proposal nothing is trained and nothing added. Other columns
    are not read.
    """
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    proposed = stored(given.select("doc_id", proposals(F.col("text")).alias("spans")), "proposals")
    weights = {(r["kind"], r["value"]): r["weight"] for r in train(proposed).collect()}
    table = F.create_map(*(F.lit(x) for (kind, value), w in weights.items() for x in (f"{kind} {value or ''}", w))) if weights else None

    def weight(kind: Column, value: Column | str) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.coalesce(F.element_at(table, F.concat(kind.cast("string"), F.lit(" "), value)), F.lit(0.0))

    def accepted(s: Column, base: Column) -> Column:
        if table is None:
            return s["base"]
        odds = F.aggregate(_values(s), weight(s["kind"], ""), lambda acc, v: acc + weight(s["kind"], v))
        return s["base"] | ((odds > 0) & ~F.exists(base, lambda b: _touch(b, s)))

    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))
    kept = let(F.filter("spans", lambda s: s["base"]), lambda base: F.transform(F.filter("spans", lambda s: accepted(s, base)), bare))
    return proposed.select("doc_id", F.array_sort(F.array_distinct(kept)).alias("spans"))


def said(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found_spans: DataFrame) -> DataFrame:
    """doc_id, base counts per kind, the digest of the base spans, and all spans as text."""
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    every = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found_spans.select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(said(base), 256).alias("base_sha256"), said(every).alias("spans"))
