"""Exact duplicates by owners in Patricia tries.

Rows are partitioned by the length and a hash of their normalised text. A
partition, texts of lengths between two powers of two that agree in a few bits of their hash, is a
compressed radix trie over the full byte strings: texts share the edges that they begin with and fork where they differ,
so two of them meet in a terminal node only if every byte agrees. A terminal holds the smallest identifier of its text,
or the largest one (``keep="largest"``).

1. Every input partition inserts its rows into tries of its own and writes one
   row per document; only the owner of each local text keeps the text. This
   is the pre-aggregation that a hot text needs: however many copies there
   are, at most one text per input partition goes on. When the tries
   outgrow ``budget`` bytes, the heaviest subtrees are written out and forgotten;
   a text that comes again later simply gets another local owner.
2. The local owners are shuffled by length and 64-bit hash, sorted by both, and inserted into
   such tries, one after the other. Rows of one text come in a run, so when a run has
   ended all subtrees are final, and the heaviest can be spilled.
3. Every document looks its owner up through its local owner, which is never hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import UPPER, byte_values, stored

#: Bytes of text that the tries of one task may hold before subtrees are spilled.
TRIE_BUDGET = 64 << 20


class Node:
    """A trie node: the bytes on the edge to it, its children by first byte, and what a terminal holds."""

    __slots__ = ("label", "children", "held")

    def __init__(self, label: bytes, held: object = None):
        self.label, self.children, self.held = label, None, held


def _shared(text: bytes, at: int, label: bytes) -> int:
    """Length of the common prefix of ``text`` from ``at`` and ``label``, by halving: comparisons run over whole slices."""
    low, high = 0, min(len(text) - at, len(label))
    while low < high:
        middle = (low + high + 1) // 2
        if text[at + low : at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made if missing."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at]) if node.children else None
            if child is None:
                leaf = Node(text[at:])
                if node.children is None:
                    node.children = {}
                node.children[text[at]] = leaf
                return leaf
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(text, at, child.label)
            fork = Node(child.label[:n])
            node.children[text[at]] = fork
            child.label = child.label[n:]
            fork.children = {child.label[0]: child}
            node, at = fork, at + n
        return node

    def terminals(self, top: Node | None = None) -> Iterator[object]:
        stack = [top or self.root]
        while stack:
            node = stack.pop()
            if node.held is not None:
                yield node.held
            if node.children:
                stack.extend(node.children.values())

    def cut(self, wanted: int, weigh: Callable[[object], int]) -> Iterator[object]:
        """Take the heaviest subtrees out until ``wanted`` is gone, and give what they held.

        A subtree goes whole if it weighs at most an eighth of what is wanted, else its own subtrees are looked at.
        """
        order: list[tuple[Node, Node | None]] = [(self.root, None)]
        for node, _ in order:
            order.extend((child, node) for child in (node.children or {}).values())
        weight = {id(node): weigh(node.held) if node.held is not None else 0 for node, _ in order}
        above = {}
        for node, parent in reversed(order):
            above[id(node)] = parent
            if parent is not None:
                weight[id(parent)] += weight[id(node)]
        most = max(1, wanted // 8)
        light = [(n, p) for n, p in order[1:] if (weight[id(n)] <= most or not n.children) and (p is self.root or weight[id(p)] > most)]
        for node, parent in sorted(light, key=lambda x: -weight[id(x[0])]):
            if wanted <= 0:
                return
            wanted -= weight[id(node)]
            del parent.children[node.label[0]]
            while parent is not self.root and not parent.children and parent.held is None:
                parent, gone = above[id(parent)], parent
                del parent.children[gone.label[0]]
            yield from self.terminals(node)


#: Bits of the hash that part the texts of one length range.
HASH_BITS = 3


def partition(length: int, short: int) -> tuple[int, int]:
    """The trie of a text: the power of two above its length, and the first bits of its signed 64-bit hash."""
    return length.bit_length(), short >> (64 - HASH_BITS)


def _better(a: int | None, b: int | None, largest: bool) -> bool:
    """Whether identifier ``a`` owns before ``b``; null never owns before a value."""
    if a is None or b is None:
        return a is not None
    return a > b if largest else a < b


class Rows:
    """Output rows, turned into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def full(self) -> bool:
        return self.size > 8 << 20

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _local(batches: Iterator[pa.RecordBatch], schema: pa.Schema, largest: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """One row per input row; the owner of each local text keeps its row as it is."""
    first = TaskContext.get().partitionId() << 36
    tries: dict[tuple[int, int], Trie] = {}
    weight: dict[tuple[int, int], int] = {}
    row, total, out = 0, 0, Rows(schema)

    def weigh(held: list) -> int:
        return 2 * held[3][0] + 200 + 64 * len(held[1])

    def write(held: list) -> int:
        (uid, doc, text, rest), members, sha, key = held
        out.rows.append((uid, doc, sha, uid, True, len(members) + 1, *key, text, *rest))
        out.rows.extend((m, d, sha, uid, False, 0, None, None, None, *([None] * len(rest))) for m, d in members)
        out.size += 64 * len(members) + (len(text) if text else 0)
        return weigh(held)

    for batch in batches:
        docs, raw = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
        others = list(zip(*(batch.column(i).to_pylist() for i in range(2, batch.num_columns)), strict=True)) or [()] * len(docs)
        for doc, text, rest in zip(docs, raw, others, strict=True):
            plain = (text or b"").lower()
            key = (len(plain), xxhash.xxh64_intdigest(plain) - (1 << 63))
            part = partition(*key)
            trie = tries.get(part)
            if trie is None:
                trie, weight[part] = tries.setdefault(part, Trie()), 0
            node, uid = trie.terminal(plain), first + row
            row += 1
            mine = (uid, doc, text, rest)
            if node.held is None:
                node.held = [mine, [], hashlib.sha256(plain).hexdigest(), key]
                weight[part] += weigh(node.held)
                total += weigh(node.held)
            else:
                owner, members, _, _ = node.held
                if _better(doc, owner[1], largest):
                    node.held[0], mine = mine, owner
                members.append(mine[:2])
                weight[part] += 64
                total += 64
            while total > budget:
                heavy = max(weight, key=weight.get)
                before = weight[heavy]
                for held in tries[heavy].cut(max(1, before // 2), weigh):
                    weight[heavy] -= write(held)
                    if out.full():
                        yield out.flush()
                if weight[heavy] == before:
                    # Only the empty text is left, at the root.
                    for held in tries.pop(heavy).terminals():
                        write(held)
                    total -= weight.pop(heavy)
                else:
                    total -= before - weight[heavy]
            if out.full():
                yield out.flush()
    for trie in tries.values():
        for held in trie.terminals():
            write(held)
            if out.full():
                yield out.flush()
    if out.rows:
        yield out.flush()


def _global(batches: Iterator[pa.RecordBatch], schema: pa.Schema, largest: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length and hash come in; per local owner its owner goes out, and the owner's own row in full."""
    key, part, trie, weight, out = None, None, Trie(), 0, Rows(schema)

    def weigh(held: list) -> int:
        return 2 * held[3] + 200 + 64 * len(held[1])

    def write(held: list) -> int:
        (uid, doc, text, rest), others, n, _ = held
        out.rows.append((uid, uid, doc, n, True, text, *rest))
        out.rows.extend((u, uid, doc, n, False, None, *([None] * len(rest))) for u in others)
        out.size += 64 * len(others) + (len(text) if text else 0) + 64
        return weigh(held)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns) if i != 5]
        columns.insert(5, batch.column(5).cast(pa.large_binary()).to_pylist())
        for length, short, uid, doc, n, text, *rest in zip(*columns, strict=True):
            if (length, short) != key:
                key = (length, short)
                if partition(*key) != part:
                    for held in trie.terminals():
                        write(held)
                        if out.full():
                            yield out.flush()
                    part, trie, weight = partition(*key), Trie(), 0
                elif weight > budget:
                    for held in trie.cut(weight // 2, weigh):
                        weight -= write(held)
                        if out.full():
                            yield out.flush()
            node, mine = trie.terminal((text or b"").lower()), (uid, doc, text, rest)
            if node.held is None:
                node.held = [mine, [], n, length]
                weight += weigh(node.held)
                continue
            owner, others, _, _ = node.held
            if _better(doc, owner[1], largest) or doc == owner[1] and uid < owner[0]:
                node.held[0], mine = mine, owner
            others.append(mine[0])
            node.held[2] += n
            weight += 64
    for held in trie.terminals():
        write(held)
        if out.full():
            yield out.flush()
    if out.rows:
        yield out.flush()


def local_owners(docs: DataFrame, key: str, text: str, carry: list[str], largest: bool, budget: int) -> DataFrame:
    """Step 1, stored: one row per document, with the text (and ``carry``) on local owners only."""
    rest = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType(
        [
            T.StructField("uid", T.LongType()),
            T.StructField("doc_id", docs.schema[key].dataType),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("local", T.LongType()),
            T.StructField("owns", T.BooleanType()),
            T.StructField("n", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("short", T.LongType()),
            T.StructField("text", T.StringType()),
            *rest,
        ]
    )
    arrow = _arrow(schema)
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    return stored(given.mapInArrow(lambda it: _local(it, arrow, largest, budget), schema), "trie-local")


def global_owners(local: DataFrame, carry: int, largest: bool, budget: int = TRIE_BUDGET) -> DataFrame:
    """Step 2: per local owner its owner; the owner's row has the text and what is carried."""
    rest = [f"c{i}" for i in range(carry)]
    owners = local.where("owns").select("length", "short", "uid", "doc_id", "n", "text", *rest)
    schema = T.StructType(
        [
            T.StructField("local", T.LongType()),
            T.StructField("owner", T.LongType()),
            T.StructField("keep_id", owners.schema["doc_id"].dataType),
            T.StructField("group_size", T.LongType()),
            T.StructField("wins", T.BooleanType()),
            T.StructField("text", T.StringType()),
            *(T.StructField(c, owners.schema[c].dataType) for c in rest),
        ]
    )
    arrow = _arrow(schema)
    # Texts of one trie come together: its length range and hash bits go before the length itself.
    band, bits = F.length(F.bin("length")), F.shiftright("short", 64 - HASH_BITS)
    dealt = owners.repartition("length", "short").sortWithinPartitions(band, bits, "length", "short")
    return dealt.mapInArrow(lambda it: _global(it, arrow, largest, budget), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", budget: int = TRIE_BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as
    empty. ``keep`` says which identifier owns a text: the smallest or the
    largest. A null identifier owns only a text that has no other. Of rows that
    repeat the owner's identifier exactly one is ``kept``. Other columns are
    not read; an empty table gives an empty result.
    """
    local = local_owners(docs, key, text, [], keep == "largest", budget)
    owners = global_owners(local, 0, keep == "largest", budget).drop("text", "wins")
    members = local.select("uid", "doc_id", "text_sha256", "local")
    return members.join(owners, "local").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("owner")).alias("kept"), "text_sha256"
    )


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", budget: int = TRIE_BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    carry = [c for c in docs.columns if c not in (key, text)]
    local = local_owners(docs, key, text, carry, keep == "largest", budget)
    owners = global_owners(local, len(carry), keep == "largest", budget).where("wins")
    names = {key: "keep_id", text: "text"} | {c: f"c{i}" for i, c in enumerate(carry)}
    return owners.select(*(F.col(names[c]).alias(c) for c in docs.columns))


SQL = f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY plain ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(plain) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS plain FROM documents)
WINDOW w AS (PARTITION BY plain)"""
