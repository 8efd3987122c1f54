"""SentencePiece encoding by sampling segmentations without replacement, and exact decoding.

The lattice of a text has an edge for every vocabulary piece that spells a run
of its characters; a character that no piece spells alone has an edge of byte
pieces. Words are lattices of their own; a task keeps them, so one that occurs often is built once. A text is cut only where no
piece can cross: between two characters that stand next to each other in no piece, so before a run of
spaces, which stays with the word behind it, and often beside a mark or line end.
Forward probabilities of an edge given its start follow from sums over all
ways to the word's end.

Gumbel top-k: every segmentation has its log probability plus Gumbel noise, and
the k largest sums are wanted, which is sampling without replacement. The
search is A*: the tree of prefixes is opened from the prefix with the largest
perturbed bound, which here is exact, because a prefix knows the log probability
of all its completions. The best child of a node inherits the node's bound, so
opening runs straight to a full segmentation; on its way every sibling gets a
Gumbel truncated at that bound, and the best sibling so far is where the next
segmentation departs. Nodes deep in a text have so little probability that none
of their siblings can reach the last bound needed; these are not drawn.

All random numbers are hashes of row key, seed, place and round, so a row has
the same segmentations in any partition.

A segmentation's log inclusion score is log(1 - exp(-exp(log p - kappa))), where
kappa is the next perturbed sum after the k-th: p / inclusion is its weight in
an unbiased sum over segmentations.

Merge ranks of a BPE vocabulary are no probabilities. A piece of rank r gets a
probability in proportion to 1 / (r + 3), as word frequencies have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import slices

SPACE, MARK = " ", "▁"
#: Stands for a mark that the text itself has, which must not be read as a space.
OWN_MARK = 0x110000
#: Characters beyond which the sums of a word are run one by one.
UNIT = 63
#: Places of a long word whose edges are Python numbers at a time.
RUN = 1 << 16
#: Bytes of text that are segmented, and ids that are decoded, at a time.
BATCH, IDS = 1 << 19, 1 << 19
#: Places of words whose lattices a task keeps for its next batches; beyond them it starts anew.
KEPT = 1_000_000
#: The largest Gumbel that a uniform number of 53 bits gives, and the log probability below which siblings are not
#: drawn at first: they could only matter if the last bound needed were below their difference, -4.
LARGEST_GUMBEL = 37.0
FLOOR = -41.0


class Pairs:
    """Pairs of characters, as numbers first * 2^21 + second, as a table over the characters that occur in one."""

    def __init__(self, joined: np.ndarray):
        first, second = joined >> 21, joined & ((1 << 21) - 1)
        known = np.unique(np.concatenate([[0], first, second]))
        self.kind = np.zeros(OWN_MARK + 1, np.int32)
        self.kind[known] = np.arange(len(known))
        self.kind[0] = len(known)
        self.width = len(known) + 1
        self.table = np.zeros(self.width**2, bool)
        self.table[self.kind[first] * self.width + self.kind[second]] = True
        self.kind[self.kind == 0] = len(known)

    def joins(self, codes: np.ndarray) -> np.ndarray:
        """Whether each character but the last stands beside the next one in a pair."""
        kind = self.kind[codes]
        return self.table[kind[:-1] * self.width + kind[1:]]


def _pairs(joined: np.ndarray | Pairs | None) -> Pairs | None:
    return Pairs(joined) if isinstance(joined, np.ndarray) else joined


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model: text and log probability by id, and the ids of the 256 byte pieces."""

    texts: list[str | None]
    log: np.ndarray
    byte_ids: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        texts = [None if special[i] else model.id_to_piece(i) for i in range(n)]
        score = np.array([model.get_score(i) for i in range(n)])
        if score.max() <= 0 and (score == np.round(score)).all():
            score = -np.log(np.minimum(-score, n) + 3.0)
        score[special] = score.min()
        log = score - np.log(np.exp(score - score.max()).sum()) - score.max()
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        return Vocabulary(texts, log, byte_ids)

    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transitions as numbers node * 2^21 + code point, the node each leads to, and the piece that ends in a node."""
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i, text in enumerate(self.texts):
            if not text:
                continue
            at = 0
            for c in map(ord, text):
                step = (at, c)
                if step not in nodes:
                    nodes[step] = len(piece)
                    piece.append(-1)
                at = nodes[step]
            piece[at] = i
        keys = np.array([(a << 21) + c for a, c in nodes], np.int64)
        return keys, np.array(list(nodes.values()), np.int32), np.array(piece, np.int32)

    def joined(self) -> np.ndarray:
        """The pairs of characters that stand next to each other in a piece, as sorted numbers first * 2^21 + second."""
        pairs = {(ord(a) << 21) + ord(b) for text in self.texts if text for a, b in zip(text, text[1:], strict=False)}
        return np.array(sorted(pairs), np.int64)

    def spelled(self) -> list[bytes]:
        """What each id stands for in a text."""
        out = [b"" if t is None else t.replace(MARK, SPACE).encode() for t in self.texts]
        for b, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([b])
        return out


class Transitions:
    """The trie's transitions in an open hash table, asked for many at once."""

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(2, 4 * len(keys)))))))
        size = 1 << (64 - int(self.shift))
        self.keys, self.to, self.mask = np.full(size, -1, np.int64), np.full(size, -1, np.int32), size - 1
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.to[slot[placed]] = to[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The node each transition leads to, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.to[slot], -1)
        left = np.nonzero((found != keys) & (found >= 0))[0]
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def _n_bytes(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points; a lone surrogate of an undecodable byte is that byte."""
    n = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return np.where((codes >= 0xDC80) & (codes <= 0xDCFF), 1, np.where(codes == OWN_MARK, 3, n))


def _byte(codes: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The k-th UTF-8 byte of code points that take n bytes."""
    codes = np.where(codes == OWN_MARK, ord(MARK), codes)
    part = codes >> (6 * (n - 1 - k))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
    return np.where(n == 1, codes & 0xFF, np.where(k == 0, lead | part, 0x80 | (part & 0x3F)))


class Lattice:
    """The edges of all distinct words of a batch, by their place in the words laid end to end."""

    def __init__(self, words: list[str], steps: Transitions, piece: np.ndarray, log: np.ndarray, byte_log: float, longest: int):
        codes = _codes("".join(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        self.start, total = ends - size, len(codes)
        to_end = np.repeat(ends, size) - np.arange(total)
        found, active, node = [], np.arange(total), np.zeros(total, np.int64)
        count = np.zeros(total, np.int32)
        single = np.zeros(total, bool)
        for n in range(1, longest + 1):
            inside = to_end[active] >= n
            active, node = active[inside], node[inside]
            node = steps.follow((node << 21) + codes[active + n - 1])
            on = node >= 0
            active, node = active[on], node[on].astype(np.int64)
            if not len(active):
                break
            ids = piece[node]
            hit = ids >= 0
            found.append((active[hit], n, ids[hit]))
            count[active[hit]] += 1
            if n == 1:
                single[active[hit]] = True
        bare = np.nonzero(~single)[0]
        found.append((bare, 1, np.full(len(bare), -1, np.int32)))
        count[bare] += 1
        self.codes, self.first = codes, np.concatenate([[0], np.cumsum(count)])
        edges = int(self.first[-1])
        self.length, self.ids = np.empty(edges, np.uint8), np.empty(edges, np.int32)
        fill = self.first[:-1].copy()
        for at, n, ids in found:
            self.length[fill[at]], self.ids[fill[at]] = n, ids
            fill[at] += 1
        log_edge = np.where(self.ids >= 0, log[self.ids], 0.0)
        slot = self.first[:-1][bare] + count[bare] - 1
        log_edge[slot] = byte_log * _n_bytes(codes[bare])
        self._sum(log_edge, count, to_end)

    def _sum(self, log_edge: np.ndarray, count: np.ndarray, to_end: np.ndarray) -> None:
        """Log probability of each edge given its start, and the running sum of the probabilities at a start."""
        total = len(self.codes)
        beyond = np.full(total + 1, -np.inf)
        rest = np.zeros(total + 1)
        near = np.minimum(to_end, UNIT + 2)
        by = np.argsort(near.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(near[by], np.arange(1, UNIT + 3))
        for d in range(len(bounds) - 1):
            at = by[bounds[d] : bounds[d + 1]]
            sums, k = None, 0
            left = at
            while len(left):
                e = self.first[left] + k
                far = self.length[e]
                value = log_edge[e] + np.where(far == d + 1, 0.0, rest[np.minimum(left + far, total)])
                if sums is None:
                    beyond[left] = value
                    sums = True
                else:
                    beyond[left] = np.logaddexp(beyond[left], value)
                k += 1
                left = left[count[left] > k]
            rest[at] = beyond[at]
        self._sum_on(log_edge, rest, to_end)
        at = np.repeat(np.arange(total), count)
        end = to_end[at] == self.length
        self.log = log_edge + np.where(end, 0.0, rest[np.minimum(at + self.length, total)]) - rest[at]
        self.run = np.exp(self.log)
        more, k = np.nonzero(count > 1)[0], 1
        while len(more):
            e = self.first[more] + k
            self.run[e] += self.run[e - 1]
            k += 1
            more = more[count[more] > k]
        self.run[self.first[1:] - 1] = 2.0


    def _sum_on(self, log_edge: np.ndarray, rest: np.ndarray, to_end: np.ndarray) -> None:
        """Carry the sums on, place by place, over words that are longer than the places summed together."""
        for first, last in _runs(np.nonzero(to_end > UNIT + 1)[0]):
            for end in range(last, first, -RUN):
                start = max(first, end - RUN)
                ahead, base = rest[start : min(last + UNIT + 1, end + 256)].tolist(), int(self.first[start])
                bounds = (self.first[start : end + 1] - base).tolist()
                edges = slice(base, base + bounds[-1])
                length, log = self.length[edges].tolist(), log_edge[edges].tolist()
                for i in range(end - start - 1, -1, -1):
                    sums = [log[e] + ahead[i + length[e]] if i + length[e] < len(ahead) else log[e] for e in range(bounds[i], bounds[i + 1])]
                    most = max(sums)
                    ahead[i] = most + math.log(sum(math.exp(x - most) for x in sums))
                rest[start:end] = ahead[: end - start]


class Lattices:
    """Lattices of the words that a task has met, built once and kept over its batches; called with words, it acts as their Lattice."""

    PLACES, EDGES = ("codes", "first"), ("length", "ids", "log", "run")

    def __init__(self, build, kept: int = KEPT):
        self.build, self.kept = build, kept
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts = np.empty(0, np.int64)
        self.room: dict[str, np.ndarray] = {}
        self.places = self.edges = self.words = 0

    def __call__(self, words: list[str]) -> Lattices:
        if self.places > self.kept:
            self._clear()
        known = self.numbers
        number = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.nonzero(number < 0)[0]
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            lattice = self.build(fresh)
            at, n = np.arange(self.words, self.words + len(new)), self.places
            known.update(zip(fresh, at.tolist(), strict=True))
            self._append("starts", self.words, lattice.start + n)
            self._append("codes", n, lattice.codes.astype(np.int32))
            self._append("first", n, lattice.first + self.edges)
            for name in self.EDGES:
                self._append(name, self.edges, getattr(lattice, name))
            self.places, self.edges, self.words = n + len(lattice.codes), self.edges + len(lattice.length), self.words + len(new)
            number[new] = at
        self.start = self.starts[number]
        return self

    def _append(self, name: str, at: int, more: np.ndarray) -> None:
        """Write ``more`` behind the first ``at`` entries; there is room for half as many again."""
        old = self.room.get(name)
        if old is None or len(old) < at + len(more):
            old, new = old, np.empty((at + len(more)) * 3 // 2, more.dtype)
            new[:at] = old[:at] if old is not None else ()
            self.room[name] = old = new
        old[at : at + len(more)] = more
        setattr(self, name, old)


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of neighbouring places."""
    if not len(places):
        return []
    cuts = np.nonzero(np.diff(places) > 1)[0]
    return list(zip(places[np.append(0, cuts + 1)].tolist(), (places[np.append(cuts, len(places) - 1)] + 1).tolist(), strict=True))


def _codes(text: str) -> np.ndarray:
    return _marked(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))


def _marked(codes: np.ndarray) -> np.ndarray:
    """Code points as the vocabulary has them: a mark for a space, and a number of its own for a mark."""
    codes[codes == ord(MARK)] = OWN_MARK
    codes[codes == ord(SPACE)] = ord(MARK)
    return codes


def _uniform(key: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """A hash of key, place and stream in the open interval from 0 to 1."""
    x = key ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream * 0xD1342543DE82EF95 & (2**64 - 1)))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


class Search:
    """The k best perturbed segmentations of every text of a batch. Without ``joined`` no text is cut."""

    def __init__(self, texts: pa.Array, keys: list, lattice_of, seed: int, joined: np.ndarray | None = None):
        counts, word, size, words = _words(texts, _pairs(joined))
        self.lattice = lattice = lattice_of(words)
        self.word_start = lattice.start[word]
        ends = np.cumsum(size)
        self.unit_start, self.unit_size = ends - size, size
        self.text_of_unit = np.repeat(np.arange(len(counts)), counts)
        chars = np.bincount(self.text_of_unit, size, len(counts)).astype(np.int64)
        self.text_end = np.cumsum(chars)
        self.text_start = self.text_end - chars
        self.total = int(chars.sum())
        # From a place of the batch to the place in the words.
        self.shift = np.repeat(self.word_start - self.unit_start, size)
        self.key = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in keys], np.uint64)

    def _walk(self, path: np.ndarray, place: np.ndarray, at: np.ndarray, end: np.ndarray, text: np.ndarray, stream: int) -> None:
        """Draw edges from each start to the end of its word, and write them at their places in ``path``."""
        lattice = self.lattice
        # A word of one character has one edge.
        one = end - at == 1
        path[place[one]] = lattice.first[at[one]]
        at, place, end, text = at[~one], place[~one], end[~one], text[~one]
        while len(at):
            u = _uniform(self.key[text], place - self.text_start[text], stream)
            e = lattice.first[at]
            on = np.nonzero(lattice.run[e] < u)[0]
            while len(on):
                e[on] += 1
                on = on[lattice.run[e[on]] < u[on]]
            path[place] = e
            step = lattice.length[e].astype(np.int64)
            at, place = at + step, place + step
            more = at < end
            at, place, end, text = at[more], place[more], end[more], text[more]

    def _nodes(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and edges of a path, where each text's begin, log probability before each node from the batch's start, and of whole texts."""
        place = np.nonzero(path >= 0)[0]
        edge = path[place]
        log = self.lattice.log[edge]
        bounds = np.searchsorted(place, np.append(self.text_start, self.total))
        run = np.concatenate([[0.0], np.cumsum(log)])
        whole = np.zeros(len(bounds) - 1)
        some = np.nonzero(np.diff(bounds))[0]
        if len(some):
            whole[some] = np.add.reduceat(log, bounds[:-1][some])
        return place, edge, bounds, run, whole

    def run(self, k: int, floor: float = FLOOR) -> list[dict]:
        """For each round 0 to k - 1: which texts have a segmentation, its path, log probability and bound; then kappa."""
        n, lattice = len(self.text_start), self.lattice
        paths, out = [], []
        bound = _gumbel(_uniform(self.key, np.zeros(n, np.int64), 1))
        after = self.text_start - 1
        path = np.full(self.total, -1, np.int64)
        self._walk(path, self.unit_start, self.word_start, self.word_start + self.unit_size, self.text_of_unit, 2)
        alive = np.ones(n, bool)
        empty = np.empty(0, np.int64)
        pool = {"text": empty, "g": np.empty(0), "path": empty, "place": empty, "edge": empty}
        for round_ in range(k):
            paths.append(path)
            place, edge, bounds, sums, whole = self._nodes(path)
            out.append({"alive": alive, "path": (place, edge, bounds), "log": whole, "bound": bound})
            # Siblings along the new part of each path, truncated at the path's bound. Sums only fall, so what is above the floor comes first.
            base = sums[bounds[:-1]]
            last = np.searchsorted(-sums[:-1], -(base + floor)) if floor > -np.inf else bounds[1:]
            size = np.where(alive, np.minimum(last, bounds[1:]) - bounds[:-1], 0)
            text = np.repeat(np.arange(n), size)
            node = np.repeat(bounds[:-1] - np.cumsum(size) + size, size) + np.arange(len(text))
            new = place[node] > after[text]
            node, text = node[new], text[new]
            place, edge, before = place[node], edge[node], sums[node] - base[text]
            at = self._word_place(place)
            first, count = lattice.first[at], lattice.first[at + 1] - lattice.first[at]
            node = np.repeat(np.arange(len(place)), count)
            sibling = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + first[node]
            other = sibling != edge[node]
            node, sibling = node[other], sibling[other]
            t, phi = text[node], before[node] + lattice.log[sibling]
            u = _uniform(self.key[t], (place[node] - self.text_start[t]) * 64 + (sibling - first[node]), 3 + 2 * round_)
            g = phi - np.log(np.exp(np.minimum(phi - bound[t], 700.0)) - np.log(u))
            new = {"text": t, "g": g, "path": np.full(len(t), round_), "place": place[node], "edge": sibling}
            pool = {c: np.concatenate([pool[c], new[c]]) for c in pool}
            best = self._best(pool, n)
            alive = alive & (best >= 0)
            bound = np.where(best >= 0, pool["g"][best] if len(pool["g"]) else 0.0, -np.inf)
            if floor > -np.inf and bool((out[0]["alive"] & (out[-1]["log"] < floor) & (bound < floor + LARGEST_GUMBEL)).any()):
                return self.run(k, -np.inf)
            if round_ + 1 == k:
                break
            # The next segmentation of a text departs from an earlier path at its best sibling.
            chosen = best[alive]
            path, after = np.full(self.total, -1, np.int64), self.text_start - 1
            go = np.full(n, -1, np.int64)
            go[np.nonzero(alive)[0]] = chosen
            after = np.where(go >= 0, pool["place"][go] if len(pool["place"]) else 0, after)
            # What stands before the place of departure is copied from the earlier path.
            texts = np.nonzero(alive)[0]
            for r in range(round_ + 1):
                of = texts[pool["path"][chosen] == r]
                size = after[of] - self.text_start[of]
                copy = np.repeat(self.text_start[of] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                path[copy] = paths[r][copy]
            here, e = pool["place"][chosen], pool["edge"][chosen]
            path[here] = e
            unit = np.searchsorted(self.unit_start, here, "right") - 1
            step = lattice.length[e].astype(np.int64)
            at = self._word_place(here) + step
            end = self.word_start[unit] + self.unit_size[unit]
            inside = at < end
            later = alive[self.text_of_unit] & (self.unit_start > after[self.text_of_unit])
            self._walk(
                path,
                np.concatenate([(here + step)[inside], self.unit_start[later]]),
                np.concatenate([at[inside], self.word_start[later]]),
                np.concatenate([end[inside], (self.word_start + self.unit_size)[later]]),
                np.concatenate([texts[inside], self.text_of_unit[later]]),
                4 + 2 * round_,
            )
            keep = np.ones(len(pool["g"]), bool)
            keep[chosen] = False
            pool = {c: v[keep] for c, v in pool.items()}
        for x in out:
            gap = x["log"] - bound
            small = np.exp(np.clip(gap, -700, 30))
            x["inclusion"] = np.where(gap < -30, gap, np.log(-np.expm1(-small)))
        return out

    def _word_place(self, place: np.ndarray) -> np.ndarray:
        """Where a place of the batch lies in the distinct words."""
        return place + self.shift[place]

    @staticmethod
    def _best(pool: dict, n: int) -> np.ndarray:
        """Per text the candidate with the largest sum, the first of equal ones; -1 without any."""
        text, g = pool["text"], pool["g"]
        most, best = np.full(n, -np.inf), np.full(n, -1, np.int64)
        np.maximum.at(most, text, g)
        hit = np.nonzero(g == most[text])[0][::-1]
        best[text[hit]] = hit
        return best

    def ids(self, path: tuple[np.ndarray, np.ndarray, np.ndarray], byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path that ``run`` gave, text by text, and the number of ids per text."""
        place, edge, bounds = path
        piece = self.lattice.ids[edge]
        bare = np.nonzero(piece < 0)[0]
        if not len(bare):
            return piece, np.diff(bounds)
        # A character without a piece gives as many ids as it has bytes.
        codes = self.lattice.codes[self._word_place(place[bare])].astype(np.int64)
        size = _n_bytes(codes)
        count = np.ones(len(place), np.int64)
        count[bare] = size
        out = np.repeat(piece, count)
        which = np.repeat(np.arange(len(bare)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        out[out < 0] = byte_ids[_byte(codes[which], k, size[which])]
        total = np.concatenate([[0], np.cumsum(count)])
        return out, total[bounds[1:]] - total[bounds[:-1]]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def _words(texts: pa.Array, joined: Pairs | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words per text, the distinct word of each and its characters, and the distinct words. ``texts``: a large_string array without nulls.

    A word ends where two characters stand next to each other in no piece. Without ``joined`` a text is one word.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    raw = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None else b""
    codes = np.frombuffer(_text(bytes(raw)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    place, byte = offsets - offsets[0], None
    if len(codes) != len(raw):
        # Where characters start; an undecodable byte is a character, though it may look like the inside of one.
        byte = np.append(np.nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[0], len(raw))
        if len(byte) != len(codes) + 1 or ((codes >= 0xDC80) & (codes <= 0xDCFF)).any():
            byte = np.concatenate([[0], np.cumsum(_n_bytes(codes))])
        place = np.searchsorted(byte, place)
    cut = np.zeros(len(codes) + 1, bool)
    cut[place] = True
    if joined is not None and len(codes):
        cut[1:-1] |= ~joined.joins(_marked(codes))
    bounds = np.nonzero(cut)[0]
    stops = np.ascontiguousarray(bounds if byte is None else byte[bounds], np.int64)
    coded = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(stops), pa.py_buffer(raw)).dictionary_encode()
    try:
        words = coded.dictionary.to_pylist()
    except UnicodeDecodeError:
        words = list(map(_text, coded.dictionary.cast(pa.large_binary()).to_pylist()))
    counts = np.diff(np.searchsorted(bounds, place))
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds), words


def encode(docs: DataFrame, model: str, samples: int = 2, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct segmentations of every whole text: doc_id, sample (from 1), ids, log_p, perturbed, log_inclusion.

    ``model`` is the path of a SentencePiece model with byte pieces, read where
    this is called. A text with fewer than ``samples`` segmentations gives as many as it
    has; null counts as empty, and an empty text has one, without ids. Rows
    that share a key and a text get the same segmentations. Other columns are
    not read.
    """
    vocabulary = Vocabulary.load(model)
    keys, to, piece = vocabulary.trie()
    log, byte_ids = vocabulary.log, vocabulary.byte_ids
    joined = vocabulary.joined()
    byte_log, longest = float(log[byte_ids].max()), max(len(t) for t in vocabulary.texts if t)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[key].dataType),
            T.StructField("sample", T.IntegerType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            *(T.StructField(c, T.DoubleType()) for c in ("log_p", "perturbed", "log_inclusion")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Transitions(keys, to)
        lattices, pairs = Lattices(lambda words: Lattice(words, steps, piece, log, byte_log, longest)), _pairs(joined)
        for batch in slices(batches, 1, BATCH):
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            search = Search(texts, batch.column(0).to_pylist(), lattices, seed, pairs)
            for sample, x in enumerate(search.run(samples), 1):
                ids, count = search.ids(x["path"], byte_ids)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(texts), sample), pa.int32()), lists, *(pa.array(x[c]) for c in ("log", "bound", "inclusion"))],
                    names=schema.names,
                )
                yield out.filter(pa.array(x["alive"]))
            del search, x, ids, lists, out  # before the next batch is segmented

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``ids`` replaced by ``decoded``, the text that it spells. Null ids give null."""
    spelled = pa.array(Vocabulary.load(model).spelled(), pa.large_binary())
    keep = [c for c in encoded.columns if c != ids]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index(ids))), 0), np.int64)
            run_of = np.cumsum(size) // IDS
            cuts = np.concatenate([[0], np.nonzero(np.diff(run_of))[0] + 1, [len(size)]])
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield spell(batch.slice(start, end - start), size[start:end])

    def spell(batch: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        lists = batch.column(batch.schema.get_field_index(ids))
        bounds = np.concatenate([[0], np.cumsum(size)])
        # The pieces laid end to end are the texts laid end to end.
        pieces = spelled.take(lists.flatten())
        place = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1)
        cut = pa.py_buffer(place[bounds].tobytes())
        text = pa.LargeStringArray.from_buffers(len(lists), cut, pieces.buffers()[2]).cast(pa.string())
        text = pc.if_else(pc.is_valid(lists), text, None)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), text], names=schema.names)

    return encoded.mapInArrow(run, schema)
