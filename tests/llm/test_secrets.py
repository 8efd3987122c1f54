"""Secrets: base spans by the stated patterns, windows counted one by one."""

import hashlib
import math
import random
import re
from collections import Counter

from millrace.llm import secretscan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
OTHERS = {"access": (r"AKIA[A-Z0-9]+", 18), "hex": (r"[0-9a-f]+", 16)}
LETTERS = secretscan.CLASSES["base64"][1]


def bits(text):
    return math.log2(len(text)) - sum(c * math.log2(c) for c in Counter(text).values()) / len(text)


def brute_base(text):
    out = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    for k, (pattern, least) in enumerate(OTHERS.values(), 1):
        out += [(m.start(), k, m.end(), m.group()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return sorted(out)


def brute_dense(text):
    """Spans of dense windows before the allow list, per class."""
    out = []
    for name, (letters, _, window, least) in secretscan.CLASSES.items():
        for m in re.finditer(f"{letters}{{{window},}}", text):
            said = m.group().lower() if name == "hex" else m.group()
            cells = set()
            for i in range(len(said) - window + 1):
                if bits(said[i : i + window]) >= least:
                    cells |= set(range(m.start() + i, m.start() + i + window))
            out += [cells] if cells else []
    return out


def texts():
    random_ = random.Random(3)

    def token():
        k, n = random_.random(), random_.choice([10, 16, 24, 30, 40, 60, 128, 129, 300])
        return "".join(random_.choices(LETTERS if k < 0.5 else "0123456789abcdef" if k < 0.7 else "0123456789ABCDEF" if k < 0.8 else "abcde0", k=n))

    lead = ["password", "Token", "api_key", "APIKEY", "ſecret", "toKen", "secret", "é😀", "the ", "AKIA", "sha256:", "https://x.y/", "md5 ", "example", ""]
    fixed = [None, "", "token: secret: abcdefghijklmnop", "password==abcdefghijkl", "password = 'short'", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "0" * 15, "0" * 16, "Ab3" * 20_000]
    made = ["".join(random_.choice(lead) + random_.choice(["", "=", ': "', " = '", " "]) + token() + random_.choice([" ", '"', "\n", ""]) for _ in range(random_.randint(0, 8))) for _ in range(500)]
    return fixed + made


def test_spans(spark):
    given = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], "doc_id long, text string, spans string").repartition(7)
    got = {r.doc_id: r for r in secretscan.digests(secretscan.scan(docs)).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        base = brute_base(text or "")
        count, row = Counter(k for _, k, _, _ in base), got[i]
        assert (row.n_assign, row.n_access, row.n_hex) == (count[0], count[1], count[2]), text
        said = [f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e, _ in base]
        assert row.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest(), text
        spans = [tuple(x.split(":")) for x in row.spans.split(",") if x]
        assert [":".join(x) for x in spans if x[0] != "entropy"] == said
        taken = {p for s, _, e, _ in base for p in range(s, e)}
        dense = set().union(*brute_dense(text or ""))
        added = [set(range(int(s), int(e))) for kind, s, e in spans if kind == "entropy"]
        assert len(added) == row.n_entropy and all(cells <= dense and not cells & taken for cells in added), text
        window = secretscan.VALUE[1]
        of_base = [max(bits(v[j : j + window]) for j in range(max(1, len(v) - window + 1))) for _, _, _, v in base]
        if base and not added:
            assert abs(row.max_bits - max(of_base)) < 1e-5, text


def test_allow_list(spark):
    random_ = random.Random(4)
    key = "".join(random_.choices(LETTERS[:-3], k=40))
    rows = [key, f"sha256:{key}", f"commit {key}", f"https://x.org/{key}", "thequickbrownfoxjumpsoverlazydogsandothers", "01234567-89ab-CDEF-0123-456789abcdef", f"x{key} {key}", f"password={key}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.spans for r in secretscan.digests(secretscan.scan(docs)).orderBy("doc_id").collect()]
    assert got == ["entropy:0:40", "", "", "", "", "", "entropy:0:41,entropy:42:82", "assign:0:49"]


def test_planted_keys_are_found(spark):
    """Random keys of either class in prose: all are found, and the prose stays free."""
    random_ = random.Random(6)
    prose = "Nothing of what stands here is secret at all and Donaudampfschifffahrtsgesellschaft is a long word "
    keys = ["".join(random_.choices(LETTERS[:62], k=random_.randint(32, 80))) for _ in range(150)] + ["".join(random_.choices("0123456789ABCDEF", k=40)) for _ in range(150)]
    docs = spark.createDataFrame([(i, prose * 2 + k + " " + prose) for i, k in enumerate(keys)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secretscan.digests(secretscan.scan(docs)).collect()}
    start = 2 * len(prose)
    hit = sum(any(x.startswith("entropy:") and int(x.split(":")[1]) < start + len(k) and int(x.split(":")[2]) > start for x in got[i].split(",") if x) for i, k in enumerate(keys))
    wide = sum(int(x.split(":")[1]) < start or int(x.split(":")[2]) > start + len(keys[i]) for i in got for x in got[i].split(",") if x)
    assert hit >= 0.98 * len(keys) and wide == 0


def test_long_text_of_many_spans(spark):
    text = f'token="abcdef0123456789abcdef" {LETTERS[:40]} ' * 3000
    row = secretscan.digests(secretscan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_assign, row.n_hex) == (3000, 3000)


def test_scan_of_nothing(spark):
    assert secretscan.digests(secretscan.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
