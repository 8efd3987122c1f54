"""Personal data, chat formatting and segmentation."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, pieces, pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)


def pii_texts():
    random_ = random.Random(5)
    fixed = [
        None, "", "a@b.co_x@y.z", "a@b@c.d", "x@-.-", "..@a.b.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 0000255.1.1.1", "1.2.3",
        "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "5-5--4111111111111111", "x4111111111111111y", "😀 4111 1111 1111 1111 é@é.com ab@cd.ef",
        "+1 (555) 123-4567", "+12", "+1 (((", "+123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "9" * 30, "1 2 3 4 5 6 7 8 9 0 1 2",
        "a" * 50_000, "1" * 50_000, "1." * 20_000, "1 " * 20_000, "a@a" + ".b" * 20_000, "ab@cd.ef " * 3_000,
    ]
    mixed = ["".join(random_.choices("ab1234567890 .-+@()", k=random_.randint(1, 60))) for _ in range(1500)]
    return fixed + mixed


def test_base_spans(spark):
    texts = pii_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(6)
    got = {r.doc_id: r for r in pii.digests(pii.find(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute_base(text)
        count = Counter(k for _, k, _ in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(count[k] for k in range(4)), text
        assert got[i].base_sha256 == hashlib.sha256(said(want).encode()).hexdigest(), text
        assert {x for x in said(want).split(",") if x} <= set(got[i].spans.split(","))


def test_labelers_add_spans_and_reject_failed_checks(spark):
    rows = [(i, f"please call 555-{100 + i} or mail ann{i}@mail.com, card 4111 1111 1111 1111") for i in range(40)]
    rows += [(100 + i, f"serial 411111111111111{i} version 1.2.3.999") for i in (2, 3, 4)]
    rows += [(200, "contact bob [at] mail [dot] com now")]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[200] == "email:8:31"
    assert got[102] == got[103] == got[104] == ""


def test_pii_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(pii.find(empty)).count() == 0
    bare = pii.digests(pii.find(spark.createDataFrame([(1, None), (None, "a@b.co")], "doc_id long, text string"))).collect()
    assert {(r.doc_id, r.spans) for r in bare} == {(1, ""), (None, "email:0:6")}


CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\l", "\\\\e", "<", "[", " ", "\n", "é😀", "</", "s>", " [/INST]", "<s>[INST] "]


def test_formatting_is_reversible(spark):
    random_ = random.Random(2)
    turns = [(c, t, random_.choice(["user", "assistant", "[/INST]x", "", None]), "".join(random_.choices(CONTROL, k=random_.randint(0, 9))) or None) for c in range(80) for t in range(random_.randint(1, 6))]
    turns += [(None, 0, "user", "no id"), (500, None, "user", "no turn"), (500, 1, "assistant", "x" * 30_000), (501, 1, "user", "same"), (501, 1, "user", "same")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.log_of(table)))
    got = {r.conv_id: r for r in rendered.select("*", chat.parse(F.col("formatted")).alias("turns")).collect()}
    digest = {r.conv_id: r for r in chat.digests(rendered).collect()}
    for conv in {c for c, *_ in turns}:
        mine = sorted(((t, r, x) for c, t, r, x in turns if c == conv), key=lambda a: tuple((v is not None, v) for v in a))
        mine = [(r or "", x or "") for _, r, x in mine]
        assert [(t.role, t.text) for t in got[conv].turns] == mine
        learnt = "".join(x for r, x in mine if r == "assistant")
        assert digest[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert digest[conv].loss_chars == len(learnt)
        assert digest[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()


def test_fold_of_events(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "Hel"), (1, 4, 1, "delta", None, "lo"),
        (1, 5, 2, "message", "user", "more"), (1, 6, 1, "regenerate", None, "ignored"), (1, 7, 1, "delta", None, "Good "), (1, 8, 1, "delta", None, "day"),
        (1, 9, 0, "edit", None, "hello"), (1, 10, 3, "message", "user", "bye"), (1, 11, 3, "unknown", None, "x"),
        (2, 1, 5, "delta", "assistant", "only a delta"), (2, 2, 6, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message int, kind string, role string, text string").repartition(3)
    got = sorted(tuple(r) for r in chat.fold(events).collect())
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "Good day"), (1, 3, "user", "bye"), (2, 5, "assistant", "only a delta"), (2, 6, "", "")]
    assert chat.render(chat.fold(events.limit(0))).count() == 0


@pytest.fixture(scope="module")
def model():
    vocabulary = pieces.Vocabulary.load(queries.MODEL)
    keys, to, piece = vocabulary.trie()
    byte_log = float(vocabulary.log[vocabulary.byte_ids].max())
    longest = max(len(t) for t in vocabulary.texts if t)
    steps = pieces.Transitions(keys, to)
    return vocabulary, lambda words: pieces.Lattice(words, steps, piece, vocabulary.log, byte_log, longest), longest


def samples(model, texts, keys, k, seed=1):
    vocabulary, lattice, _ = model
    search = pieces.Search(pa.array(texts, pa.large_string()), keys, lattice, seed)
    out = []
    for x in search.run(k):
        ids, count = search.ids(x["path"], vocabulary.byte_ids)
        bounds = np.append(0, np.cumsum(count))
        out.append([(tuple(ids[bounds[i] : bounds[i + 1]].tolist()), x["log"][i], x["bound"][i], x["inclusion"][i]) if x["alive"][i] else None for i in range(len(texts))])
    return out


def every_segmentation(vocabulary, longest, word):
    index = {t: i for i, t in enumerate(vocabulary.texts) if t}

    def ways(rest):
        if not rest:
            return [((), 0.0)]
        return [((index[rest[:n]], *ids), vocabulary.log[index[rest[:n]]] + log) for n in range(1, min(longest, len(rest)) + 1) if rest[:n] in index for ids, log in ways(rest[n:])]

    found = dict(ways(word))
    norm = np.logaddexp.reduce(list(found.values()))
    return {ids: math.exp(log - norm) for ids, log in found.items()}


def test_sampling_without_replacement(model):
    vocabulary, _, longest = model
    share = every_segmentation(vocabulary, longest, "▁cat".replace("▁", "▁"))
    n = 8000
    first, second = samples(model, [" cat"] * n, list(range(n)), 2)
    one, two = Counter(x[0] for x in first), Counter(x[0] for x in second)
    for ids in sorted(share, key=share.get)[-3:]:
        again = sum(p * share[ids] / (1 - p) for other, p in share.items() if other != ids)
        assert abs(one[ids] / n - share[ids]) < 0.02
        assert abs(two[ids] / n - again) < 0.02
    assert all(a[0] != b[0] and a[2] > b[2] for a, b in zip(first, second, strict=True))
    assert all(abs(x[1] - math.log(share[x[0]])) < 1e-9 for x in first[:50])
    weights = sum(math.exp(x[1] - x[3]) for x in first + second) / n
    assert abs(weights - 1) < 0.05


def test_all_segmentations_of_a_short_word(model):
    vocabulary, _, longest = model
    share = every_segmentation(vocabulary, longest, "▁at")
    rounds = samples(model, [" at"], ["key"], len(share) + 3)
    found = [r[0][0] for r in rounds if r[0]]
    assert sorted(found) == sorted(share)
    assert rounds[len(share) - 1][0][3] == 0.0


def cut_samples(model, texts, k):
    """``samples`` with the cuts that encode makes."""
    vocabulary, lattice, _ = model
    search = pieces.Search(pa.array(texts, pa.large_string()), list(range(len(texts))), lattice, 1, vocabulary.joined())
    out = []
    for x in search.run(k):
        ids, count = search.ids(x["path"], vocabulary.byte_ids)
        bounds = np.append(0, np.cumsum(count))
        out.append([(tuple(ids[bounds[i] : bounds[i + 1]].tolist()), x["log"][i]) if x["alive"][i] else None for i in range(len(texts))])
    return out


def test_pieces_of_several_spaces(model):
    vocabulary, _, longest = model
    for text in ("  x", "   a", "a  b ", "at    "):
        share = every_segmentation(vocabulary, longest, text.replace(" ", "▁"))
        found = {r[0][0]: r[0][1] for r in cut_samples(model, [text], len(share) + 1) if r[0]}
        assert found.keys() == share.keys()
        assert all(abs(found[ids] - math.log(p)) < 1e-9 for ids, p in share.items())
    assert any(len(t) > 1 and set(t) == {"▁"} for t in (vocabulary.texts[i] for ids in share for i in ids))


def log_sum(vocabulary, longest, text):
    """Log sum of the probabilities of all segmentations into pieces."""
    index = {t: i for i, t in enumerate(vocabulary.texts) if t}
    sums = [0.0]
    for end in range(1, len(text) + 1):
        ways = [sums[end - n] + vocabulary.log[index[text[end - n : end]]] for n in range(1, min(longest, end) + 1) if text[end - n : end] in index]
        sums.append(np.logaddexp.reduce(ways))
    return sums[-1]


def test_long_runs_without_a_space(model):
    vocabulary, _, longest = model
    # No piece joins q and j, nor j and q: few segmentations, and a piece over the 63rd character.
    joined = set(vocabulary.joined().tolist())
    a, b = next((a, b) for a in "qjzxvkw" for b in "jqxzvkw" if a != b and not {(ord(a) << 21) + ord(b), (ord(b) << 21) + ord(a)} & joined)
    run = (a + b) * 31 + "that" + b + a
    share = every_segmentation(vocabulary, longest, run)
    found = {r[0][0]: r[0][1] for r in cut_samples(model, [run], len(share) + 1) if r[0]}
    assert found.keys() == share.keys() and len(share) > 3
    assert all(abs(found[ids] - math.log(p)) < 1e-9 for ids, p in share.items())


@pytest.mark.parametrize("text", ["x" * 300, " " * 90 + "def", "internationalization" * 12 + "  end", "a" * 64, "a" * 65, "a" * 66, "http://example.com/" + "path/to/some/page-" * 9])
def test_log_p_over_the_whole_lattice(model, text, monkeypatch):
    monkeypatch.setattr(pieces, "RUN", 40)
    vocabulary, _, longest = model
    whole = log_sum(vocabulary, longest, text.replace(" ", "▁"))
    both = [text, "word " + text, text]
    for r in [*cut_samples(model, both, 3), *samples(model, both, [1, 2, 3], 3)]:
        for i in (0, 2):
            assert "".join(vocabulary.texts[j] for j in r[i][0]) == text.replace(" ", "▁")
            assert abs(r[i][1] - (sum(vocabulary.log[j] for j in r[i][0]) - whole)) < 1e-8


ODD = [None, "", "a", " ", "  a  b ", "\n\n", "▁", " ▁ ▁▁", "日本語 текст 😀\t\r\n", "x" * 5000, "no\0null byte", "a\0", "é" * 200, "word " * 3000]


def test_encode_and_decode_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(3, " ", "again")], "doc_id long, text string, ids string").repartition(3)
    encoded = pieces.encode(docs, queries.MODEL, samples=3)
    decoded = pieces.decode(encoded, queries.MODEL).collect()
    assert {r.doc_id for r in decoded} == set(range(len(ODD)))
    for r in decoded:
        assert r.decoded == (ODD[r.doc_id] or "")
    segmentations = {(r.doc_id, r.sample): tuple(r.ids) for r in encoded.collect()}
    for i in range(len(ODD)):
        mine = [ids for (doc, _), ids in segmentations.items() if doc == i]
        assert len(set(mine)) == len(mine)
    again = {(r.doc_id, r.sample): tuple(r.ids) for r in pieces.encode(docs.repartition(1), queries.MODEL, samples=3).collect()}
    assert again == segmentations
    assert pieces.encode(docs.limit(0), queries.MODEL).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing, queries.MODEL).collect()[0].decoded is None


def planted(random_):
    """Texts with personal data in loose spellings, the spans of these, and texts with things that only look alike."""
    names, hosts, tops = ["ann", "bob.lee", "c-smith"], ["mail", "post-box", "example"], ["com", "org", "net", "de"]
    digits = lambda n: "".join(random_.choices("0123456789", k=n))

    def card():
        body = "4" + digits(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + last

    made = []
    for _ in range(300):
        n, h, t = random_.choice(names), random_.choice(hosts), random_.choice(tops)
        c = card()
        made.append(("email", "please mail to ", f"{n} at {h} dot {t}"))
        made.append(("email", "contact me: ", f"{n} [at] {h} [dot] {t}"))
        made.append(("ip", "the server host ", f"fe80::{random_.randint(1, 9999):x}:{random_.randint(1, 9999):x}"))
        made.append(("card", "paid by visa card ", ".".join(c[i : i + 4] for i in range(0, 16, 4))))
        made.append(("phone", "call by phone ", f"0{digits(3)} {digits(3)} {digits(4)}"))
        made.append(("phone", "tel. ", f"(0{digits(3)})-{digits(3)} {digits(3)}"))
    rows, want = [], {}
    for i, (kind, lead, said) in enumerate(made):
        rows.append((i, f"Some words, {lead}{said} and more"))
        want[i] = f"{kind}:{12 + len(lead)}:{12 + len(lead) + len(said)}"
    for i in range(600):
        odd = random_.choice([f"version {digits(4)}.{digits(4)}.{digits(4)}.1234", f"std::vector{i}::size", f"isbn 0{digits(2)}/{digits(3)}-{digits(4)}", f"section 1::{i}x"])
        rows.append((10_000 + i, f"It says {odd} there"))
    base = [(20_000 + i, f"write to ann{i}@mail.com, ip 10.0.{i % 256}.1, call +49 30 {1234567 + i}, card {card()}") for i in range(300)]
    return rows + base, want


def test_precision_and_recall_on_planted_spans(spark):
    """What the votes, the estimation and the classifier add to the strict patterns."""
    rows, want = planted(random.Random(8))
    found = pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    spans = {r.doc_id: {x for x in r.spans.split(",") if x} for r in found.collect() if r.doc_id < 20_000}
    base = {i: {f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in brute_base(t)} for i, t in rows}
    hit = sum(w in spans[i] for i, w in want.items())
    added = sum(len(x - base[i]) for i, x in spans.items())
    assert hit / len(want) >= 0.9, hit / len(want)
    assert hit / added >= 0.9, hit / added
    assert all(not w & base[i] for i, w in ((i, {w}) for i, w in want.items()))


def test_pii_of_repeated_rows(spark):
    rows = [(1, "mail ann@mail.com"), (1, "mail ann@mail.com"), (1, None), (None, "ip 10.0.0.1"), (2, "")]
    got = [(r.doc_id, r.spans) for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    assert sorted(got, key=str) == sorted([(1, "email:5:17"), (1, "email:5:17"), (1, ""), (None, "ip:3:11"), (2, "")], key=str)
