"""LM scoring: logistic mixing of hashed-context bit predictors, and a unigram base.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end per text.

The model spells each token: its bytes and a terminator (or the end symbol), every
symbol as the bits of a Huffman code that depends on the symbol before.  Each bit is predicted from ``len(SIZES)``
hashed contexts: 1 and 3 symbols before (at the word's start a class of the word
before) and the whole beginning of the word, the first and the last with the group
of the text's last frequent word (frequent words are grouped by the company
they keep), each with counts of zeros and ones from all words of all training documents (a task
counts its own, and the tasks' tables are summed by ranges of slots).  Their logits are combined by weights
that a gate picks by how often the contexts were seen; the mixed probability is
then refined by an adaptive table over its own logit and the gate.  Weights, table and
word groups are learnt from all training documents, with each bit's own count taken out: a task
takes a Newton step for each stretch of its own bits, and the tasks' curvatures, curved weights and table
sums, of fixed size, are added up (so the weights depend a little on how the input is
dealt over tasks).  Every bit's two probabilities sum to 1, so a text's
score is the log10 of a proper probability.  Equal tokens in equal places have equal
scores, so a task spells each once while it has it at hand.

The base needs every token's exact count.  Words that a first look shows to
be frequent (at most ``HEAD``) are counted in a table, the others
meet by hash in one shuffle, where a run of equal hashes gives the count and each
document's part.  No run is longer than a rare word's count.

Null and empty texts are one end token.  Without training documents N and V are 0
and the model predicts evenly.  Rows that repeat are scored each and count each; an
empty table gives an empty result; long texts are one block each.  Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, Scratch, blocks, gathered, lowered, mix64, prefix_hash, release, span_hash, word_spans
from .suffix_dedup import ragged

HEAD = 1 << 17
TERM, END, SYMBOLS = 256, 257, 258
#: Slots of the contexts: the text's group (codes depend on the symbol before), 3 symbols before, the word's beginning, the same with the group.
SIZES = (1 << 18, 1 << 19, 1 << 21, 1 << 21)
#: Different tokens that a task keeps at hand.
KEPT = 2_000_000
UNIT_BYTES = 2 << 20  # text whose equal tokens are spelled once
SHARE = 1 << 17  # symbols (about) of which those with equal bits are told once
SPELL = 16_000  # symbols whose bits are held at a time: they stay in the cache
BASES = tuple(int(x) for x in np.concatenate([[0], np.cumsum(SIZES)[:-1]]))
SLOTS = sum(SIZES)
#: Cells (a slot's zeros and ones are two) that are summed together.
RANGE = 1 << 18
GATES, BINS = 180, 65
CLASSES = 8
GROUPS = 8
MARKS = 192
LEVELS = (1, 3, 12, 60, 400)
#: What weights and table start from counts as so much curvature and so many bits.
STIFF, START = 30.0, 20.0


def _classes() -> np.ndarray:
    """A class for a word's last byte."""
    out = np.full(256, 3, np.int64)
    out[ord("a") : ord("z") + 1] = 1
    out[[ord(c) for c in ".!?"]] = 2
    out[ord(",")] = 4
    out[[ord(c) for c in "0123456789"]] = 5
    out[128:] = 6
    out[[ord(c) for c in "*%&$#@|"]] = 7
    return out


_CLASS = _classes()


class Code:
    """Huffman codes over the symbols, one for each symbol before: the nodes and bits on each symbol's path."""

    def __init__(self, pairs: np.ndarray):
        """pairs: how often each symbol (or the word's start, as TERM) is followed by each."""
        size, node, bit = np.zeros((TERM + 1, SYMBOLS), np.int64), [], []
        for before in range(TERM + 1):
            for s, path in enumerate(self._paths(pairs[before])):
                size[before, s] = len(path)
                node += [before * SYMBOLS + n for n, _ in path]
                bit += [b for _, b in path]
        self.size = size.ravel()
        self.first = np.cumsum(self.size) - self.size
        self.node = mix64(np.array(node, np.uint64) + np.uint64(1)).astype(np.uint32)
        self.bit = np.array(bit, np.int8)

    @staticmethod
    def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
        heap = [(int(64 * c**0.5) + 1, s, s) for s, c in enumerate(counts.tolist())]  # different words count here, not their repetitions: about the root
        heapq.heapify(heap)
        kids: dict[int, tuple[int, int]] = {}
        fresh = SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids[fresh] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
            fresh += 1
        out: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
        todo = [(heap[0][2], [])]
        while todo:
            node, path = todo.pop()
            if node in kids:
                todo += [(kid, [*path, (node - SYMBOLS, bit)]) for bit, kid in enumerate(kids[node])]
            else:
                out[node] = path
        return out

    def rows(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where each symbol's code is, given the symbol before it."""
        before = np.full(len(symbols), TERM, np.int64)
        before[1:] = symbols[:-1]
        return np.where(place == 0, TERM, before) * SYMBOLS + symbols


def added(tasks: DataFrame) -> np.ndarray | None:
    """The sum of the tasks' vectors (a column ``v`` of doubles' bytes)."""

    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column(0):
                part = np.frombuffer(v.as_buffer())
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

    got = tasks.repartition(8).mapInArrow(add, "v binary").collect()  # 8 rows of 300 KB at most
    return sum(np.frombuffer(r["v"]) for r in got) if got else None


def word_groups(train: DataFrame, words: np.ndarray, groups: int = GROUPS - 1, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, group of each): frequent words that keep company in texts, by spherical k-means.

    A word is the vector of the roots of its counts in all texts; only the words' products are needed."""
    words = np.sort(words)
    n = len(words)

    def company(batches):
        products, common = np.zeros((n, n)), np.zeros(n)
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(0)):
                raw = lowered(raw)
                starts, ends, doc = word_spans(raw, off)
                at = head_places(words, span_hash(raw, starts, ends))
                there = np.sqrt(np.bincount(doc[at >= 0] * n + at[at >= 0], minlength=(hi - lo) * n).reshape(-1, n).astype(np.float32))
                products += there.T @ there
                common += (there > 0).sum(axis=0)
        yield pa.record_batch([pa.array([np.append(products, common).tobytes()], pa.binary())], names=["v"])

    total = added(train.select("text").mapInArrow(company, "v binary")) if n else None
    if total is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    products, common = total[: n * n].reshape(n, n), total[n * n :]
    size = np.sqrt(np.maximum(np.diag(products), 1e-18))
    cosine = products / size / size[:, None]
    centres = [int(np.argmax(common))]
    near = cosine[centres[0]]
    while len(centres) < min(groups, n):  # next the word that is most common and far from the others
        centres.append(int(np.argmax(common * np.maximum(1 - near, 0) ** 2)))
        near = np.maximum(near, cosine[centres[-1]])
    middle = np.zeros((n, len(centres)))  # each middle is the sum of these words
    middle[centres, np.arange(len(centres))] = 1
    for _ in range(rounds):
        length = np.sqrt(np.maximum(np.einsum("ig,ij,jg->g", middle, cosine, middle, optimize=True), 1e-18))
        of = np.argmax(cosine @ middle / length, axis=1)
        for g in np.unique(of):
            middle[:, g] = of == g
    return words, of + 1


def ranked(keys: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit hashes, equal ones as they come: their upper bits are sorted with their places as one number."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    sorted_ = keys[order]
    return order if (sorted_[1:] >= sorted_[:-1]).all() else np.argsort(keys, kind="stable")


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted different hashes, which of them each is, how often each is there)."""
    order = ranked(keys)
    runs = np.append(True, keys[order[1:]] != keys[order[:-1]])[: len(keys)]
    at = np.flatnonzero(runs)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(runs) - 1
    return keys[order[at]], inverse, np.diff(np.append(at, len(keys)))


def numbered_small(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each different value is first, which of the sorted different values each is) of values below a limit."""
    if limit > 1 << 25:  # one long text
        _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
        return first, inverse
    there = np.zeros(limit, bool)
    there[values] = True
    different = np.flatnonzero(there)
    number = np.empty(limit, np.int32)
    number[different] = np.arange(len(different))
    inverse = number[values].astype(np.int64)
    first = np.empty(len(different), np.int64)
    first[inverse[::-1]] = np.arange(len(values))[::-1]
    return first, inverse


class Units:
    """The different tokens of a block (word, class of the word before, group of the last frequent word): symbols, counts, and each token's unit."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, marks: tuple[np.ndarray, np.ndarray]):
        raw = self.raw = lowered(raw)
        n = len(off) - 1
        starts, ends, doc = word_spans(raw, off)
        self.words = np.bincount(doc, minlength=n)
        self.doc = doc
        self.key = span_hash(raw, starts, ends)
        different, inverse, times = numbered(self.key)
        self.different, self.inverse, self.times = different, inverse, times
        last = _CLASS[raw[ends - 1]] if len(ends) else np.empty(0, np.int64)
        place = head_places(marks[0], different)
        group = (np.where(place >= 0, marks[1][place], 0) if len(marks[0]) else np.zeros(len(different), np.int64))[inverse]
        told = np.maximum.accumulate(np.where(group > 0, np.arange(len(group)), -1)) if len(group) else group
        first_word = np.cumsum(self.words) - self.words
        state = np.where(told >= first_word[doc], group[told], 0) * CLASSES + last if len(doc) else last  # after each word
        before = np.zeros(len(doc), np.int64)
        before[1:] = np.where(doc[1:] == doc[:-1], state[:-1], 0)
        final = np.zeros(n, np.int64)
        some = self.words > 0
        final[some] = state[(first_word + self.words - 1)[some]]
        ends_of = CLASSES * GROUPS
        mixed = inverse * np.int64(ends_of) + before
        first, unit = numbered_small(mixed, len(different) * ends_of)
        self.word = inverse[first]
        self.start, self.stop, self.before = starts[first], ends[first], np.concatenate([before[first], np.arange(ends_of)])
        self.unit = np.concatenate([unit, len(first) + final])  # the texts' ends are the last units
        self.owner = np.concatenate([doc, np.arange(n)])
        self.count = len(first) + ends_of

    def symbols(self, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, unit of each counted from ``lo``, place within its unit) of some units."""
        hi = self.count if hi is None else hi
        words = len(self.start)
        size = (self.stop - self.start)[lo : min(hi, words)]
        spelled = self.raw[ragged(self.start[lo : min(hi, words)], size)].astype(np.int64)
        ends = hi - max(lo, words) if hi > words else 0
        total = np.concatenate([size + 1, np.ones(ends, np.int64)])
        out = np.full(int(total.sum()), TERM, np.int64)
        unit = np.repeat(np.arange(len(total)), total)
        begin = np.cumsum(total) - total
        place = np.arange(len(out)) - begin[unit]
        out[place < np.concatenate([size, np.zeros(ends, np.int64)])[unit]] = spelled
        out[begin[len(size) :]] = END
        return out, unit, place

    def keys(self) -> np.ndarray:
        """What names a unit in any block."""
        word = np.concatenate([self.different[self.word], np.zeros(self.count - len(self.word), np.uint64)])
        return mix64(word ^ ((self.before.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))

    def alike(self) -> np.ndarray:
        """An order of the words' units in which those of a group that begin alike lie together."""
        words, last = len(self.start), max(len(self.raw) - 1, 0)
        key = (self.before[:words] // CLASSES).astype(np.uint64)
        for i in range(7 if words else 0):
            key = (key << np.uint64(8)) | np.where(self.start + i < self.stop, self.raw[np.minimum(self.start + i, last)], 0).astype(np.uint64)
        return np.argsort(key, kind="stable")

    def shared(self, step: int = 1):
        """Stretches (symbols, place, before, unit of each, order, first of each run): symbols are equal to those of their run, and so are their bits.

        Bits are told by the beginning of the word with the symbol itself, by the group, and up to the third symbol by the class of the word before."""
        every = list(self.stretches(SHARE))
        for lo, hi in (every[i] for k in range(step) for i in range(k, len(every), step)):
            symbols, unit, place = self.symbols(lo, hi)
            before = self.before[lo:hi][unit]
            sums, down = prefix_hash((symbols & 255).astype(np.uint8))
            first = np.arange(len(symbols)) - place
            state = np.where(place < 3, before, before | (CLASSES - 1)) * 2 + (place < 3)
            key = mix64((sums[1:] - sums[first]) * down[first] ^ ((state * SYMBOLS + symbols + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            low = np.uint64((1 << len(key).bit_length()) - 1)  # the key's upper bits and where it is: sorted as one number
            order = (np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)
            key = key[order]
            runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yield lo, hi, symbols, place, before, unit, order, runs

    def pick(self, some: np.ndarray) -> "Spelled":
        """Some of the words' units, and all of the ends'."""
        words = len(self.start)
        return Spelled(self.raw, self.start[some], self.stop[some], np.concatenate([self.before[:words][some], self.before[words:]]))

    def stretches(self, most: int):
        """Units (first, last + 1) of about ``most`` symbols each."""
        total = np.cumsum(np.concatenate([self.stop - self.start + 1, np.ones(self.count - len(self.start), np.int64)]))
        lo = 0
        while lo < self.count:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
            yield lo, hi
            lo = hi


class Spelled(Units):
    """Units without the texts they come from."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, before: np.ndarray):
        self.raw, self.start, self.stop, self.before, self.count = raw, start, stop, before, len(before)


class Kept:
    """Values of units seen before, by their keys; it starts anew when it is full."""

    def __init__(self):
        self.keys, self.values = np.empty(0, np.uint64), np.empty(0)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is there, its value)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        order, at = ranked(keys), np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)  # in order it stays in the cache
        return self.keys[at] == keys, self.values[at]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = ranked(keys)
        if len(self.keys) + len(keys) > KEPT:
            self.keys, self.values = keys[order], values[order]
            return
        keys = np.concatenate([self.keys, keys[order]])
        merged = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[merged], np.concatenate([self.values, values[order]])[merged]


class Pool:
    """Counts units over the blocks of a task; each different one is spelled once when the pool is emptied."""

    def __init__(self, take):
        """take: what is called with units and how often each is there."""
        self.take = take
        self.ends = np.zeros(CLASSES * GROUPS, np.int64)
        self.clear()

    def clear(self) -> None:
        self.known, self.counts, self.parts, self.size = Kept(), np.zeros(KEPT + 1, np.int64), [], 0

    def add(self, units: Units, often: np.ndarray) -> None:
        words = len(units.start)
        self.ends += often[words:]
        there, slot = self.known.find(keys := units.keys()[:words])
        new = np.flatnonzero(~there)
        if self.size + len(new) > KEPT:
            self.empty()
            if len(new := np.arange(words)) > KEPT:  # one long text
                self.take(units.pick(new), np.concatenate([often[:words], np.zeros(CLASSES * GROUPS, np.int64)]))
                return
            there = np.zeros(words, bool)
        self.counts[slot[there].astype(np.int64)] += often[:words][there]
        self.counts[self.size : self.size + len(new)] = often[new]
        self.known.add(keys[new], np.arange(self.size, self.size + len(new), dtype=float))
        size = (units.stop - units.start)[new]
        self.parts.append((units.raw[ragged(units.start[new], size)], size, units.before[new]))
        self.size += len(new)

    def empty(self) -> None:
        if self.parts or self.ends.any():
            self.parts.append((np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)))
            size = np.concatenate([p[1] for p in self.parts])
            stop = np.cumsum(size)
            units = Spelled(np.concatenate([p[0] for p in self.parts]), stop - size, stop, np.concatenate([*(p[2] for p in self.parts), np.arange(CLASSES * GROUPS)]))
            order = units.alike()
            self.take(units.pick(order), np.concatenate([self.counts[: self.size][order], self.ends]))
            self.ends[:] = 0
        self.clear()


def context_hashes(symbols: np.ndarray, place: np.ndarray, before: np.ndarray, some: np.ndarray | None = None) -> list[np.ndarray]:
    """A 32-bit hash of the contexts of each symbol, or of some of them."""
    some = np.arange(len(symbols)) if some is None else some
    sums, down = prefix_hash((symbols & 255).astype(np.uint8))
    place, before = place[some], before[some]
    started = np.uint64(400) + (before % CLASSES).astype(np.uint64)
    group = (before // CLASSES).astype(np.uint64) << np.uint64(50)
    chain, out = np.zeros(len(some), np.uint64), []
    for k in range(1, 4):
        back = symbols[np.maximum(some - k, 0)].astype(np.uint64) + np.uint64(1)
        back = np.where(place >= k, back, np.where(place == k - 1, started, np.uint64(0)))
        chain = chain * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(k)
    out += [mix64(np.where(place == 0, started, np.uint64(0)) ^ group), mix64(chain)]
    first = some - place
    whole = (sums[some] - sums[first]) * down[first]
    whole = np.where(place == 0, np.uint64(400), whole) ^ (np.minimum(place, 60).astype(np.uint64) << np.uint64(57))
    out += [mix64(whole ^ np.uint64(0xABCDEF)), mix64(whole ^ group ^ np.uint64(0x123456789))]
    return [(h >> np.uint64(32)).astype(np.uint32) for h in out]


class Bits:
    """The bits of some symbols; symbols' bits are consecutive."""

    def __init__(self, code: Code, rows: np.ndarray):
        self.size = code.size[rows]
        at = ragged(code.first[rows], self.size)
        self.node, self.bit = code.node[at], code.bit[at]

    def slots(self, context: int, hashes: np.ndarray) -> np.ndarray:
        """Each bit's slot within its context's table."""
        mixed = np.repeat(hashes, self.size)
        mixed ^= self.node
        mixed *= np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
        mixed >>= np.uint32(33 - SIZES[context].bit_length())
        return mixed.astype(np.int64)


def weighed(code: Code, units: Units, often: np.ndarray):
    """Different bits (bits, hashes of their contexts, how often each bit is there), a few at a time."""
    for lo, hi, symbols, place, before, unit, order, runs in units.shared(8):
        rows, hashes = code.rows(symbols, place), context_hashes(symbols, place, before, told := order[runs])
        times = np.add.reduceat(often[lo:hi][unit[order]].astype(float), runs)
        for at in range(0, len(told), SPELL):
            bits = Bits(code, rows[told[at : at + SPELL]])
            yield bits, [h[at : at + SPELL] for h in hashes], np.repeat(times[at : at + SPELL], bits.size)


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Counts of every slot, mixing weights by gate, and the refining table."""

    def __init__(self, code: Code, zeros: np.ndarray, ones: np.ndarray, marks: tuple[np.ndarray, np.ndarray]):
        self.code, self.marks = code, marks
        self.zeros, self.ones = zeros, ones
        self.weights = np.full((GATES, len(SIZES) + 1), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.table = np.tile(np.linspace(-8, 8, BINS), (GATES, 1)).astype(np.float32)
        if zeros is not None:
            self.freeze()

    def settle(self, sums: np.ndarray) -> None:
        """Weights and table from the summed learners."""
        k = len(SIZES) + 1
        curve, curved, mass, hits = np.split(sums, np.cumsum([GATES * k * k, GATES * k, GATES * BINS]))
        curved = curved.reshape(GATES, k) + STIFF * self.weights
        self.weights = np.linalg.solve(curve.reshape(GATES, k, k) + np.eye(k) * STIFF, curved[:, :, None])[:, :, 0].astype(np.float32)
        p = (hits + START * squash(self.table.astype(float).ravel())) / (mass + START)
        self.table = np.clip(stretch(np.clip(p, 1e-5, 1 - 1e-5)), -9, 9).astype(np.float32).reshape(GATES, BINS)

    def freeze(self) -> None:
        """Logits and seen-levels of the slots, from which bits are predicted."""
        self.logit, self.level = [], []
        for base, size in zip(BASES, SIZES, strict=True):
            one, n = self.ones[base : base + size], self.zeros[base : base + size] + self.ones[base : base + size]
            self.logit.append(stretch((one + 0.4) / (n + 0.8)).astype(np.float32))
            self.level.append(np.searchsorted(LEVELS, n, "right").astype(np.int8))

    def gate(self, levels: list[np.ndarray]) -> np.ndarray:
        """By how often the three symbols before and the word's beginning (without and with the group) were seen."""
        return (levels[3].astype(np.int64) * 6 + levels[2]) * 5 + np.minimum(levels[1], 4)

    def mix(self, logits: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(self.weights.T)
        out = columns[-1].take(gate)
        for w, x in zip(columns, logits, strict=False):
            part = w.take(gate)
            part *= x
            out += part
        return np.clip(out, -9, 9, out=out)

    def refined(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Half the mixed logit, half the table's at it."""
        at = np.rint(mixed * np.float32((BINS - 1) / 16)).astype(np.int64)
        np.clip(at, -(BINS // 2), BINS // 2, out=at)
        at += gate * BINS + BINS // 2
        return np.float32(0.5) * (mixed + self.table.ravel().take(at))

    def log10_known(self, units: Units, kept: Kept) -> np.ndarray:
        """log10 probability of each unit; those that ``kept`` has are not spelled again."""
        keys, words = units.keys(), len(units.start)
        there, values = kept.find(keys)
        new = np.flatnonzero(~there[:words])
        new = new[units.pick(new).alike()]
        fresh = self.log10_units(units.pick(new))
        values[new], values[words:] = fresh[: len(new)], fresh[len(new) :]
        kept.add(keys[new], values[new])
        return values

    def log10_units(self, units: Units) -> np.ndarray:
        """log10 probability of each unit."""
        total = np.zeros(units.count)
        for lo, hi, symbols, place, before, _, order, runs in units.shared():
            rows, hashes, parts = self.code.rows(symbols, place), context_hashes(symbols, place, before, told := order[runs]), []
            for at in range(0, len(told), SPELL):
                bits = Bits(self.code, rows[told[at : at + SPELL]])
                slots = [bits.slots(i, h[at : at + SPELL]) for i, h in enumerate(hashes)]
                gate = self.gate([self.level[i].take(s) if i else None for i, s in enumerate(slots)])
                x = self.refined(self.mix([t.take(s) for t, s in zip(self.logit, slots, strict=True)], gate), gate)
                x = np.where(bits.bit == 1, -x, x)  # -log p(bit) = log(1 + e^x)
                parts.append(np.add.reduceat(np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0), np.cumsum(bits.size) - bits.size, dtype=float))
            cost = np.empty(len(symbols))
            cost[order] = np.repeat(np.concatenate(parts), np.diff(np.append(runs, len(order))))
            total[lo:hi] = np.add.reduceat(cost, np.flatnonzero(place == 0))
        return total / -np.log(10)


class Learner:
    """Weights by gate and the refining table from a task's bits; each bit's own count is taken out."""

    def __init__(self, code: Code, zeros: np.ndarray, ones: np.ndarray):
        self.code = code
        both = np.empty((len(zeros), 2), np.float32)
        both[:, 0], both[:, 1] = zeros, ones
        self.cells = both.view(np.complex64).ravel()  # a slot's zeros and ones side by side: one look at memory for both
        self.model = Model(code, None, None, None)
        k = len(SIZES) + 1
        self.curve, self.start = np.tile(np.eye(k) * STIFF, (GATES, 1, 1)), self.model.weights.astype(float)
        self.mass, self.hits = np.zeros(GATES * BINS), np.zeros(GATES * BINS)

    def take(self, units: Units, often: np.ndarray) -> None:
        """A Newton step of every gate's weights for each stretch, with the curvature summed so far, then the table's sums."""
        for bits, hashes, weight in weighed(self.code, units, often):
            bit, weight = bits.bit.astype(np.float32), weight.astype(np.float32)
            x, levels = np.empty((len(SIZES) + 1, len(weight)), np.float32), []
            for i, h in enumerate(hashes):
                slot = bits.slots(i, h)
                slot += BASES[i]
                both = self.cells.take(slot)
                zero, one = both.real + bit, both.imag - bit
                zero -= 1
                if i:
                    seen, level = zero + one, np.zeros(len(bit), np.int8)  # without the bit itself
                    for least in LEVELS:
                        level += seen >= least
                levels.append(level if i else None)
                for part in (zero, one):
                    np.maximum(part, 0, out=part)
                    part += np.float32(0.4)
                np.log(np.divide(one, zero, out=one), out=x[i])
            gate = self.model.gate(levels)
            order = np.argsort(gate.astype(np.uint8), kind="stable")  # each gate's bits in a row
            x[:-1], gate, bit, weight = x[:-1].take(order, axis=1), gate.take(order), bit.take(order), weight.take(order)
            x[-1] = 1
            self.step(x, gate, bit, weight)
            mixed = self.model.mix(list(x[:-1]), gate)
            at = np.clip(np.rint(mixed * np.float32((BINS - 1) / 16)).astype(np.int64), -(BINS // 2), BINS // 2) + gate * BINS + BINS // 2
            self.mass += np.bincount(at, weights=weight, minlength=len(self.mass))
            self.hits += np.bincount(at, weights=weight * bit, minlength=len(self.hits))

    def step(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One Newton step over bits that are sorted by gate."""
        if not len(gate):
            return
        p = squash(self.model.mix(list(x[:-1]), gate))
        curved, slope = x * (weight * np.maximum(p * (1 - p), np.float32(1e-3))), x * (weight * (bit - p))
        cuts = np.flatnonzero(np.append(True, np.diff(gate) != 0))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(gate)), strict=True):
            self.curve[gate[lo]] += curved[:, lo:hi] @ x[:, lo:hi].T
        some = gate[cuts]
        steps = np.linalg.solve(self.curve[some], np.add.reduceat(slope, cuts, axis=1, dtype=float).T[:, :, None])[:, :, 0]
        self.model.weights[some] += np.clip(steps, -0.3, 0.3).astype(np.float32)

    def sums(self) -> np.ndarray:
        """What may be added to other tasks': curvatures, curved weights (both without the start's part), and the table's sums."""
        w = self.model.weights.astype(float)
        own = self.curve - np.eye(w.shape[1]) * STIFF
        curved = (own @ w[:, :, None])[:, :, 0] + STIFF * (w - self.start)
        return np.concatenate([own.ravel(), curved.ravel(), self.mass, self.hits])


def learnt(train: DataFrame, code: Code, marks: tuple[np.ndarray, np.ndarray], zeros: np.ndarray, ones: np.ndarray) -> np.ndarray | None:
    """The sums of all tasks' learners over the training documents."""
    shared = train.sparkSession.sparkContext.broadcast((code, marks, zeros, ones))  # 42 MB

    def learn(batches):
        code_, marks_, zeros_, ones_ = shared.value
        learner = Learner(code_, zeros_, ones_)
        pool = Pool(learner.take)
        for batch in batches:
            for _, _, raw, off in blocks(batch.column(0), UNIT_BYTES):
                units = Units(raw, off, marks_)
                pool.add(units, np.bincount(units.unit, minlength=units.count))
        pool.empty()
        yield pa.record_batch([pa.array([learner.sums().tobytes()], pa.binary())], names=["v"])

    total = added(train.select("text").mapInArrow(learn, "v binary"))
    shared.unpersist()
    return total


def add_counts(code: Code, units: Units, often: np.ndarray, seen: list[np.ndarray]) -> None:
    """Adds the units' bits to each context's table of zeros and ones."""
    for bits, hashes, weight in weighed(code, units, often):
        for i, h in enumerate(hashes):
            slot = bits.slots(i, h)
            slot *= 2
            slot += bits.bit
            np.add.at(seen[i], slot, weight)


def _top(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, weights=counts).astype(np.int64)
    if len(keys) > most:
        at = np.argpartition(-counts, most)[:most]
        keys, counts = keys[at], counts[at]
    return keys, counts


def frequent_words(train: DataFrame, scratch: Scratch, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the most frequent words, the very first of them, counts of pairs of symbols) of the documents, counted task by task."""

    def count(batches):
        keys, counts, pairs = np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((TERM + 1) * SYMBOLS, np.int64)
        for batch in batches:
            for _, _, raw, off in blocks(batch.column(0)):
                raw = lowered(raw)
                starts, ends, _ = word_spans(raw, off)
                k, c = np.unique(span_hash(raw, starts, ends), return_counts=True)
                keys, counts = np.concatenate([keys, k]), np.concatenate([counts, c])
                if len(keys) > 4 * most:
                    keys, counts = _top(keys, counts, most)
                # each word's start, bytes and end in a row; where two white spaces meet there is no word
                spelled = np.full(len(raw) + 2, TERM, np.int64)
                spelled[1:-1] = np.where(_SPACE[raw], TERM, raw)
                follows = spelled[:-1] * SYMBOLS + spelled[1:]
                pairs += np.bincount(follows[(spelled[:-1] != TERM) | (spelled[1:] != TERM)], minlength=len(pairs))
                pairs[TERM * SYMBOLS + END] += len(off) - 1
        keys, counts = _top(keys, counts, most)
        often = counts > 1
        yield pa.record_batch([pa.array(np.concatenate([keys[often].view(np.int64), np.flatnonzero(pairs)])), pa.array(np.concatenate([counts[often], pairs[pairs > 0]])), pa.array(np.concatenate([np.zeros(int(often.sum()), bool), np.ones(int((pairs > 0).sum()), bool)]))], names=["key", "n", "is_pair"])

    summed = train.select("text").mapInArrow(count, "key long, n long, is_pair boolean").groupBy("is_pair", "key").agg(F.sum("n").alias("n"))
    summed = scratch.keep(summed, "frequent")
    keys = summed.filter("not is_pair").orderBy(F.desc("n"), "key").limit(most).select("key").toArrow().column(0).to_numpy().view(np.uint64)
    pairs = np.zeros((TERM + 1) * SYMBOLS, np.int64)
    told = summed.filter("is_pair").select("key", "n").toArrow()  # at most (TERM + 1) * SYMBOLS rows
    pairs[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return np.sort(keys), keys[:MARKS].copy(), pairs.reshape(-1, SYMBOLS)


def head_places(head: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in the sorted head, or -1."""
    if not len(head):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
    return np.where(head[at] == keys, at, -1)


def score_texts(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD) -> DataFrame:
    """Per document held_out, n_tokens, n_known, train_tokens, base_score and score (both log10), and bits_per_byte."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), is_training.alias("train"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    train = rows.filter("train")
    head, frequent, pairs = frequent_words(train, scratch, head_size)
    code = Code(pairs)
    marks = word_groups(train, frequent)
    shared_head, shared_code = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast((code, marks))  # 2 MB at most

    of_head = -1  # the range of the head's words and the texts' ends

    def tables(batches):
        """Counts of a task's cells that are not 0, by range, and of the head's words (last the texts' ends)."""
        head_, (code_, marks_) = shared_head.value, shared_code.value
        cells, words = np.zeros(2 * SLOTS), np.zeros(len(head_) + 1, np.int64)
        seen = np.split(cells, 2 * np.array(BASES[1:]))
        pool = Pool(lambda units, often: add_counts(code_, units, often, seen))
        for batch in batches:
            for _, _, raw, off in blocks(batch.column(0), UNIT_BYTES):
                units = Units(raw, off, marks_)
                pool.add(units, np.bincount(units.unit, minlength=units.count))
                place = head_places(head_, units.different)
                words[place[place >= 0]] += units.times[place >= 0]
                words[-1] += len(off) - 1
        pool.empty()
        for number, part in [*enumerate(np.split(cells, range(RANGE, len(cells), RANGE))), (of_head, words)]:
            at = np.flatnonzero(part)
            if len(at):
                yield pa.record_batch([pa.array([number], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([part[at].astype(np.int64).tobytes()], pa.binary())], names=["number", "at", "n"])

    def sums(batches):
        """The tasks' counts of each range added up."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = held.setdefault(number, np.zeros(len(shared_head.value) + 1 if number == of_head else RANGE, np.int64))
                total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        for number, total in held.items():
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([(total if number == of_head else total.astype(np.float32)).tobytes()], pa.binary())], names=["number", "n"])

    counts = train.select("text").mapInArrow(tables, "number int, at binary, n binary").repartition(parts, "number")
    got = counts.mapInArrow(sums, "number int, n binary").toArrow()  # bounded: 40 MB of cells and the head's counts
    cells, head_counts = np.zeros(2 * SLOTS, np.float32), np.zeros(len(head) + 1, np.int64)
    for number, n in zip(got.column(0).to_pylist(), got.column(1), strict=True):
        if number == of_head:
            head_counts[:] = np.frombuffer(n.as_buffer(), np.int64)
        else:
            cells[number * RANGE : (number + 1) * RANGE] = np.frombuffer(n.as_buffer(), np.float32)[: len(cells) - number * RANGE]
    zeros, ones = cells[::2].copy(), cells[1::2].copy()
    del got, cells
    release()
    head_counts, train_texts = head_counts[:-1], int(head_counts[-1])
    model = Model(code, zeros, ones, marks)
    sums_of_tasks = learnt(train, code, marks, zeros, ones)
    if sums_of_tasks is not None:
        model.settle(sums_of_tasks)
    release()

    def tail(batches):
        """Rare words of each row: hash, row, how often, whether the row is for training."""
        head_ = shared_head.value
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(2)):
                raw = lowered(raw)
                starts, ends, doc = word_spans(raw, off)
                keys = span_hash(raw, starts, ends)
                different, inverse, _ = numbered(keys)
                rare = (head_places(head_, different) < 0)[inverse]
                pair, n = np.unique(doc[rare] * np.int64(len(different)) + inverse[rare], return_counts=True)
                d, k = pair // max(len(different), 1), pair % max(len(different), 1)
                row = batch.column(0).slice(lo, hi - lo).to_numpy()
                is_train = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(different[k].view(np.int64)), pa.array(row[d]), pa.array(np.where(is_train[d], n, -n), pa.int32())], names=["h", "row", "n"])

    def runs(batches):
        """Per row: sum of n * log10(c + 1) and known tokens; and the runs' part of V and N (on any row)."""
        held = None
        for h, row, n in gathered(batches):
            if held is not None:
                h, row, n = (np.concatenate([x, y]) for x, y in zip(held, (h, row, n), strict=True))
            if not len(h):
                continue
            cut = int(np.searchsorted(h, h[-1], "left"))
            held = (h[cut:], row[cut:], n[cut:])
            if cut:
                yield whole_runs(h[:cut], row[:cut], n[:cut])
        if held is not None:
            yield whole_runs(*held)

    def whole_runs(h, row, n):
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        c = np.add.reduceat(np.maximum(n, 0).astype(np.int64), first)
        of = np.repeat(c, np.diff(np.append(first, len(h))))
        times = np.abs(n).astype(np.int64)
        keys, inverse = np.unique(row, return_inverse=True)
        logs = np.bincount(inverse, weights=times * np.log10(of + 1.0))
        known = np.bincount(inverse, weights=np.where(of > 0, times, 0)).astype(np.int64)
        v, total = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        v[0], total[0] = int((c > 0).sum()), int(c.sum())
        return pa.record_batch([pa.array(keys), pa.array(logs), pa.array(known), pa.array(v), pa.array(total)], names=["row", "logs", "known", "v", "total"])

    rare = rows.select("row", "train", "text").mapInArrow(tail, "h long, row long, n int").repartition(parts, "h").sortWithinPartitions("h")
    summed = rare.mapInArrow(runs, "row long, logs double, known long, v long, total long").groupBy("row").agg(*(F.sum(c).alias(c) for c in ("logs", "known", "v", "total")))
    summed = scratch.keep(summed, "tail")
    sizes = summed.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    total = int(sizes["n"]) + int(head_counts.sum()) + train_texts
    different = int(sizes["v"]) + int((head_counts > 0).sum()) + (1 if train_texts else 0)
    unit_log = float(np.log10(total + different + 1.0))
    end_log = float(np.log10(train_texts + 1.0))
    model.zeros = model.ones = None  # what scoring needs is frozen
    shared = spark.sparkContext.broadcast((model, np.log10(head_counts + 1.0), head_counts > 0))  # 30 MB at most

    def score(batches):
        head_ = shared_head.value
        model_, logs, known = shared.value
        logs, known, kept = np.append(logs, 0.0), np.append(known, False), Kept()
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(3), UNIT_BYTES):
                n = hi - lo
                units = Units(raw, off, model_.marks)
                likely = np.bincount(units.owner, weights=model_.log10_known(units, kept)[units.unit], minlength=n)
                at = head_places(head_, units.different)[units.inverse]
                base = np.bincount(units.doc, weights=logs[at], minlength=n) + end_log
                seen = np.bincount(units.doc, weights=known[at], minlength=n).astype(np.int64) + (1 if train_texts else 0)
                size = np.maximum(np.diff(off), 1)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), batch.column(2).slice(lo, n), pa.array(units.words + 1), pa.array(base), pa.array(seen), pa.array(likely), pa.array(-likely * np.log2(10) / size)],
                    names=["doc_id", "row", "train", "n_tokens", "base", "seen", "score", "bits_per_byte"],
                )

    scored = scratch.keep(rows.select("doc_id", "row", "train", "text").mapInArrow(score, f"doc_id {kind}, row long, train boolean, n_tokens long, base double, seen long, score double, bits_per_byte double"), "scored")
    times = scored.groupBy("row").agg(F.count(F.lit(1)).alias("times"))  # rows that repeat share their sums
    tails = times.join(summed, "row", "left").select("row", (F.coalesce("logs", F.lit(0.0)) / F.col("times")).alias("logs"), F.floor(F.coalesce("known", F.lit(0)) / F.col("times")).alias("known"))
    return scored.join(tails, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("seen") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * unit_log).alias("base_score"), "score", "bits_per_byte",
    )
