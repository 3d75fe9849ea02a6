"""Language-model scores by online logistic mixing of context bit predictors, beside a unigram base."""

from __future__ import annotations

import heapq
import os
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.common import (bound_batches, byte_texts, crc_rest, drop_table, groups_by_bytes, row_seq, shuffles_dropped,
                                stage_table)

#: A text is its words, each ended by a blank, and then this unit; UTF-8 lacks the byte 255.
END = b"\xff"
#: The mark of a place in a text is the last word ahead of it with so few bytes, hashed to so many bits: short words tell
#: the language and the kind of text.
MARK_BYTES, MARK_BITS = 4, 12
LOW_MARK = (1 << MARK_BITS) - 1
#: Predictors: the last two bytes, the last four, eight bits of the mark and the last two bytes (hashed tables); the word so
#: far, the mark and the word so far (exact).
TABLES, K = 3, 5
#: So many bytes of a word have all bits of the mark in the third table's context, later ones three.
NEAR, FAR_MARKS = 2, 7
#: Slots of a table for each (context, node) that the corpus has, at least.
ROOM = 2
#: Step of the online weights, and what they start from.
RATE, WEIGHT = 0.1, 0.3
#: Units of a stretched probability.
STRETCH = 128
#: What a bit's counts start from.
DELTA = 0.05
#: Text whose equal words are looked up at once, bits that are scored at a time, bits after which weights are refined.
STEP_BYTES, STEP_BITS, LEARN_BITS = 4 << 20, 1 << 15, 1 << 13
#: Evidence behind the word so far (8 levels); behind the mark and the word so far, or where there's none, behind the last
#: four bytes (3 and 4 levels); first byte of a word or not.
LEVELS_WORD, LEVELS_MORE, LEVELS_FOUR = 8, 3, 4
SECOND = LEVELS_FOUR + LEVELS_MORE
GATES = LEVELS_WORD * SECOND * 2
#: Buckets of the adaptive map over a mixed prediction, and the prediction at its ends.
CELLS, EDGE = 33, 8.0
#: Slots (as a power of two) whose codes are made at a time.
CHUNK_BITS = 16
#: Beginnings with several bytes behind them whose bits are counted at a time.
GROUPS_AT_ONCE = 1 << 11
#: Items held before a task passes their counts on; items of one part.
HELD, PART = 1_000_000, 1 << 17
#: Items whose counts and scores are broadcast for look-up; those of all others are joined.
HEAD = 1 << 20


def _code():
    """A binary code of the 256 bytes: (first entry, length, node and bit of each entry).

    Its shape is Huffman's for guessed frequencies of bytes in words of western European languages, so that a letter takes
    about four or five bits; the probabilities themselves are learnt, so the guess costs time only.
    """
    guess = {0.11: b" en", 0.057: b"itahros", 0.028: b"\xc3uldc", 0.012: b"mpgbf.,", 0.007: b"wyvkzqx\xa9\xa8\xb3\xa4\xbc",
             0.0025: b"j\xa1\xad\xb1\xb6\xa7\xaa\x9f0123456789-'!\xff"}
    often = {b: f for f, group in guess.items() for b in group}
    heap = [(often.get(b, 0.00012), b, b) for b in range(256)]
    heapq.heapify(heap)
    kids, node = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[node] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], node, node))
        node += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    todo = [(node - 1, [])]
    while todo:
        at, path = todo.pop()
        if at < 256:
            paths[at] = path
        else:
            todo += [(kids[at][bit], [*path, (at - 256, bit)]) for bit in (0, 1)]
    length = np.array([len(paths[b]) for b in range(256)])
    flat = [x for b in range(256) for x in paths[b]]
    return (np.cumsum(length) - length, length, np.array([x[0] for x in flat], dtype=np.uint32),
            np.array([x[1] for x in flat], dtype=np.int8))


FIRST, LENGTH, NODE, BIT = _code()
_RNG = np.random.default_rng(17)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_NODE_MIX = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SEED = _RNG.integers(0, 1 << 63, TABLES, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(255)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEP
    return h ^ (h >> np.uint64(29))


# A count is held in eight bits: small ones as they are, others in steps of a ninth.
_COUNT = np.concatenate([np.arange(16), np.rint(16 * 1.111 ** np.arange(240))])
_BETWEEN = (_COUNT[1:] + _COUNT[:-1]) / 2
_CODE = np.searchsorted(_BETWEEN, np.arange(1 << 12)).astype(np.uint16)


def _code_of(n: np.ndarray) -> np.ndarray:
    """A count (a whole number) in eight bits."""
    out = _CODE[np.minimum(n, len(_CODE) - 1).astype(np.int32)]
    large = np.flatnonzero(n >= len(_CODE))
    out[large] = np.searchsorted(_BETWEEN, n[large])
    return out


def _codes(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones in 16 bits."""
    return _code_of(n0) << np.uint16(8) | _code_of(n1)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the first place of each, and of each place which of them it holds, as by ``np.unique``, whose
    stable sort takes longer."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[:len(key)]
    begin = np.flatnonzero(new)
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[begin], np.minimum.reduceat(order, begin) if len(key) else order, which


def _entries(k: int, less: int | None) -> np.ndarray:
    """By code: the stretched probability in units of 1 / STRETCH, times 8, plus the level of evidence.

    ``less``: one occurrence of this bit doesn't count (the one that is predicted).
    """
    n = np.stack([np.repeat(_COUNT, 256), np.tile(_COUNT, 256)])
    if less is not None:
        n[less] = np.maximum(n[less] - 1, 0)
    x = np.clip(np.rint(np.log((n[1] + DELTA) / (n[0] + DELTA)) * STRETCH), -4095, 4095).astype(np.int16) << 3
    top, per = {1: (LEVELS_FOUR, 3), 3: (LEVELS_WORD, 2), 4: (LEVELS_MORE + 1, 2)}.get(k, (1, 1))
    return x | np.searchsorted(2.0 ** (per * np.arange(top - 1)) - 0.5, n.sum(0)).astype(np.int16)


ENTRY = [_entries(k, None) for k in range(K)]
ENTRY_WITHOUT = [np.concatenate([_entries(k, b) for b in (0, 1)]) for k in range(K)]


@dataclass
class Symbols:
    """Bytes to predict: the byte, its context hashes for the tables, whether it starts a word, how often it counts, and
    hashes of all that is ahead of it in its word (56 bits) without and with the mark, with the byte in the lowest eight."""
    byte: np.ndarray
    context: list[np.ndarray]
    start: np.ndarray
    weight: np.ndarray
    word: np.ndarray
    marked: np.ndarray


def _symbols(items: list[bytes], n: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """(each byte behind the same mark and beginning of a word once, with the sum of counts; of each item's bytes, in
    turn, which of them it is).  An item is a word with its blank, or END, and two bytes of the mark."""
    lens = np.fromiter(map(len, items), dtype=np.int64, count=len(items)) - 2
    data = np.frombuffer(b"".join(items), dtype=np.uint8)
    end = np.cumsum(lens + 2)
    mark = (data[end - 2].astype(np.uint64) << np.uint64(8)) | data[end - 1]
    data = np.delete(data, np.append(end - 2, end - 1))
    first = np.cumsum(lens) - lens
    unit = np.repeat(np.arange(len(items)), lens)
    place = np.arange(len(data)) - first[unit]
    power = np.cumprod(np.full(int(lens.max(initial=0)) + 1, _STEP, dtype=np.uint64), dtype=np.uint64)
    term = _BYTE[data] * power[place]
    run = np.cumsum(term, dtype=np.uint64)
    before = _mixed(run - term - (run - term)[first][unit]) if len(data) else term  # hash of the bytes ahead
    byte = data.astype(np.uint64)
    marked = (_mixed(before + (mark[unit] + np.uint64(1)) * _STEP) & ~_LOW) | byte
    marked, at, which = _distinct(marked)
    weight = np.bincount(which, weights=n[unit], minlength=len(marked)).astype(np.int64)
    b1, b2, b3, b4 = (np.where(place[at] >= k, data[np.maximum(at - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3, 4))
    two = b1 | (b2 << np.uint64(8))
    four = two | (b3 << np.uint64(16)) | (b4 << np.uint64(24))
    short = mark[unit[at]]
    short = np.where(place[at] < NEAR, short, _mixed(short + _SEED[0]) & np.uint64(FAR_MARKS) | np.uint64(1 << 32))
    context = [_mixed(two + _SEED[0]), _mixed(four + _SEED[1]), _mixed((two | (short << np.uint64(16))) + _SEED[2])]
    return Symbols(data[at], context, (place[at] == 0).astype(np.int16), weight, (before[at] & ~_LOW) | byte[at],
                   marked), which


def _entry(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, entry of the code) of all bits of some bytes."""
    n = LENGTH[byte]
    sym = np.repeat(np.arange(len(n)), n)
    return sym, np.arange(len(sym)) - np.repeat(np.cumsum(n) - n - FIRST[byte], n)


def _bits(s: Symbols, most: int = STEP_BITS):
    """Pieces of at most about ``most`` bits: (which of all bits, symbol of each, its bit)."""
    upto = np.cumsum(LENGTH[s.byte])
    at = 0
    while at < len(upto):
        begin = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, begin + most)))
        sym, entry = _entry(s.byte[at:to])
        yield slice(begin, int(upto[to - 1])), sym + at, BIT[entry]
        at = to


def _hashes(context: np.ndarray, sym, node) -> np.ndarray:
    """Hashes of (context, node), of which the upper bits are a slot."""
    return _mixed(context[sym] * _NODE_MIX[node])


def _exact(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Codes of the counts of all bits of some bytes, of which each is behind a beginning, ordered by that.

    Behind most beginnings is one byte, whose bits all have its count; those of the others are counted for some beginnings
    at a time.
    """
    begin = pair & ~_LOW
    new = np.append(True, begin[1:] != begin[:-1])[:len(pair)]
    group = np.cumsum(new) - 1
    one = np.bincount(group)[group] == 1
    byte = (pair & _LOW).astype(np.uint8)
    sym, entry = _entry(byte)
    bit = BIT[entry]
    out = _code_of(n)[sym] << ((1 - bit) << 3).astype(np.uint16)
    many = np.flatnonzero(~one[sym])
    at = (np.cumsum(new & ~one) - 1)[sym[many]]
    cuts = np.searchsorted(at, np.arange(0, at[-1] + 1 + GROUPS_AT_ONCE if len(at) else 0, GROUPS_AT_ONCE))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        these = many[lo:hi]
        cell = ((at[lo:hi] - at[lo]) << 9) | (NODE[entry[these]].astype(np.int64) << 1)
        total = np.bincount(cell | bit[these], weights=n[sym[these]], minlength=int(cell.max()) + 2)
        out[these] = _codes(total[cell], total[cell | 1])
    return out


@dataclass
class Counts:
    """What the whole corpus says: tables of codes by slot, and the counts of beginnings that are in several parts."""
    tables: list[np.ndarray]
    beginnings: np.ndarray
    pair: np.ndarray
    n: np.ndarray

    def of_part(self, s: Symbols) -> list[np.ndarray]:
        """The codes of each predictor for all bits of ``s``.

        The symbols of a beginning that is in several parts are counted in all of them; behind it the mark is known to
        its table only.
        """
        sym, entry = _entry(s.byte)
        node = NODE[entry]
        out = [t[_hashes(c, sym, node) >> np.uint64(64 - len(t).bit_length() + 1)] for c, t in zip(s.context, self.tables)]
        own = ~_among(s.word, self.beginnings)
        word, at, of = _distinct(s.word)
        there = _among(self.pair, word & ~_LOW)
        pair = np.append(word, self.pair[there])
        order = np.argsort(pair, kind="stable")
        n = np.append(np.where(own[at], np.bincount(of, weights=s.weight, minlength=len(word)), 0), self.n[there])
        exact = _exact(pair[order], n[order])
        length = LENGTH[(pair[order] & _LOW).astype(np.uint8)]
        first = np.empty(len(pair), dtype=np.int64)
        first[order] = np.cumsum(length) - length  # first bit of each pair
        begin = np.cumsum(LENGTH[s.byte]) - LENGTH[s.byte]
        out.append(exact[(first[of] - begin)[sym] + np.arange(len(sym))])
        out.append(_exact(s.marked, np.where(own, s.weight, 0)))
        return out


def _among(pair: np.ndarray, beginnings: np.ndarray) -> np.ndarray:
    return np.isin(pair & ~_LOW, beginnings)


def _added(sym: np.ndarray, lp: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    lo = sym[0]
    part = np.bincount(sym - lo, weights=lp)
    out[lo:lo + len(part)] = part
    return out


class Mixer:
    """Gated weights over K stretched predictions, and the adaptive map of what they mix to."""

    def __init__(self):
        self.weight = np.full((K, GATES), WEIGHT, dtype=np.float32)
        self.cells = np.zeros((2, GATES * CELLS))  # weights of zeros and ones that fell into a cell
        self.seen = np.zeros(GATES)
        self.square = np.full((K, GATES), 1e-4)

    def mix(self, start: np.ndarray, t: list[np.ndarray]):
        """(gate, inputs, mixed prediction in the stretched domain, its cell) of each bit, from its entries."""
        more = t[4] & 7
        second = np.where(more > 0, more + np.int16(LEVELS_FOUR - 1), t[1] & 7)
        gate = ((t[3] & 7) * np.int16(SECOND) + second) * np.int16(2) + start
        x = [(q >> 3).astype(np.float32) for q in t]
        z = x[0] * self.weight[0][gate]
        for k in range(1, K):
            z += x[k] * self.weight[k][gate]
        z *= np.float32(1 / STRETCH)
        np.clip(z, -12, 12, out=z)
        cell = (np.clip(z, -EDGE, EDGE) * np.float32((CELLS - 1) / (2 * EDGE)) + np.float32((CELLS - 1) / 2 + 0.5)
                ).astype(np.int32) + gate.astype(np.int32) * CELLS
        return gate, x, z, cell

    def refined(self) -> np.ndarray:
        """P(1) by cell: its counts, smoothed by the middle of the cell."""
        mid = 1 / (1 + np.exp(-(np.arange(CELLS) / (CELLS - 1) * 2 * EDGE - EDGE)))
        mid = np.tile(mid, GATES)
        return ((self.cells[1] + 4 * mid) / (self.cells.sum(0) + 4)).astype(np.float32)

    def learn(self, s: Symbols, codes: list[np.ndarray]) -> None:
        """Refine weights and map over the symbols of ``s``, whose own occurrence doesn't count in what predicts it."""
        for these, sym, bit in _bits(s, LEARN_BITS):
            without = bit.astype(np.int32) << 16
            t = [ENTRY_WITHOUT[k][without | c[these]] for k, c in enumerate(codes)]
            gate, x, z, cell = self.mix(s.start[sym], t)
            n = s.weight[sym]
            err = (bit - 1 / (1 + np.exp(-z))) * n * np.float32(1 / STRETCH)
            seen = np.bincount(gate, weights=n, minlength=GATES)
            step = np.stack([np.bincount(gate, weights=err * x[k], minlength=GATES) for k in range(K)])
            step /= np.maximum(seen, 1)
            self.square += step * step
            self.weight += (RATE * step / np.sqrt(self.square)).astype(np.float32)
            self.seen += seen
            self.cells.reshape(-1)[:] += np.bincount(cell + bit * np.int32(GATES * CELLS), weights=n,
                                                     minlength=2 * GATES * CELLS)

    def share(self) -> np.ndarray:
        """What a part adds, as whole numbers, whose sums don't depend on the order: map, weights by evidence, evidence."""
        return np.concatenate([np.rint(x).astype(np.int64).ravel()
                               for x in (self.cells, self.weight * self.seen * 1024, self.seen)])

    def take(self, total: np.ndarray) -> None:
        """Take map and weights from the sum of all shares."""
        cells, w, self.seen = np.split(total, [2 * GATES * CELLS, 2 * GATES * CELLS + K * GATES])
        self.cells = cells.reshape(2, -1).astype(float)
        self.weight = np.where(self.seen > 0, w.reshape(K, GATES) / 1024 / np.maximum(self.seen, 1),
                               WEIGHT).astype(np.float32)

    def log10(self, s: Symbols, codes: list[np.ndarray], refined: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol."""
        out = np.zeros(len(s.byte))
        for these, sym, bit in _bits(s):
            _, _, z, cell = self.mix(s.start[sym], [ENTRY[k][c[these]] for k, c in enumerate(codes)])
            p = 0.5 * (1 / (1 + np.exp(-z)) + refined[cell])
            p = np.where(bit, p, 1 - p)
            lp = np.log10(np.maximum(p, np.float32(1e-7)))
            out += np.bincount(sym, weights=lp, minlength=len(out)) if len(sym) > len(out) // 4 else _added(sym, lp, len(out))
        return out


@dataclass
class Step:
    """Texts as items: words, each with the mark ahead of it (the empty word ends a text)."""
    codes: np.ndarray  # of each item: number of its word, mark
    ids: np.ndarray  # item of each token
    size: np.ndarray  # tokens of each text
    items: list[bytes] | None = None


def mark_of(word: bytes) -> int:
    """The mark that a word sets: a hash if it is short, 0 at a text's end, and so at the next one's beginning, else -1."""
    return zlib.crc32(word) >> (32 - MARK_BITS) if len(word) <= MARK_BYTES else -1


class Words:
    """Words by number, with the marks that they set; 0 is the empty one, which ends texts."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[b""]
        self.marks = np.zeros(0, dtype=np.int64)

    def step(self, texts: list[bytes]) -> Step:
        ids, size = [], []
        for t in texts:
            words = t.lower().split()  # splits at the ASCII blanks
            words.append(b"")
            size.append(len(words))
            ids.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words)))
        run = np.concatenate(ids)
        self.marks = np.append(self.marks, np.array([mark_of(w) for w in islice(self.number, len(self.marks), None)],
                                                    dtype=np.int64))
        mark = np.append(0, self.marks[run])
        mark = mark[np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), 0))][:-1]  # the last one set ahead
        codes, which = np.unique(run.astype(np.int64) << MARK_BITS | mark, return_inverse=True)
        return Step(codes, which, np.array(size))

    def units(self) -> list[bytes]:
        """The words, each with its blank, or END."""
        return [w + b" " if w else END for w in self.number]


def _step(texts: list[bytes]) -> Step:
    words = Words()
    step = words.step(texts)
    unit = words.units()
    step.items = [unit[c >> MARK_BITS] + (c & LOW_MARK).to_bytes(2) for c in step.codes.tolist()]
    return step


def _count_items(batches):
    """Items and their counts in learnt texts, 0 for those of others."""
    words, held = Words(), []

    def merged():
        codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(which, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(codes, n):
        word = pa.array(words.units(), pa.binary()).take(pa.array(codes >> MARK_BITS))
        mark = pa.py_buffer((codes & LOW_MARK).astype(">u2").tobytes())
        mark = pa.Array.from_buffers(pa.binary(2), len(codes), [None, mark]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([word, mark, pa.array(n, pa.int64())], names=["word", "mark", "n"])

    for b in batches:
        texts, out = byte_texts(b.column("t")), b.column("out").to_pylist()
        for learnt in (True, False):
            some = [t for t, o in zip(texts, out) if o != learnt]
            for lo, hi in groups_by_bytes(some, STEP_BYTES):
                step = words.step(some[lo:hi])
                held.append((step.codes, np.bincount(step.ids, minlength=len(step.codes)) * int(learnt)))
                if sum(len(c) for c, _ in held) > 2 * HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD:
                        yield rows(*held[0])
                        words, held = Words(), []
    if held:
        yield rows(*merged())


_PART = "least binary, most binary, words binary, marks binary, n binary"


def _packed(batches):
    """A part's items in order, as one row, so that they are read again together without an exchange."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is not None and table.num_rows:
        table = table.sort_by([("word", "ascending"), ("mark", "ascending")])
        words = table["word"].to_pylist()
        yield pa.RecordBatch.from_pydict({
            "least": [words[0]], "most": [words[-1]], "words": [b"\n".join(words)],  # words hold no line ends
            "marks": [b"".join(table["mark"].to_pylist())], "n": [table["n"].to_numpy().astype("<i8").tobytes()]})


def _parts(batches):
    """(items, counts) of each part."""
    for b in batches:
        for words, marks, n in zip(*(b.column(c).to_pylist() for c in ("words", "marks", "n"))):
            yield ([w + marks[2 * k:2 * k + 2] for k, w in enumerate(words.split(b"\n"))],
                   np.frombuffer(n, dtype="<i8").astype(np.int64))


def _beginnings(cut: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Sorted hashes of the beginnings that the last word of a part has in common with the first one of the next."""
    both = sorted({os.path.commonprefix(c) for c in cut})
    if not both:
        return np.zeros(0, dtype=np.uint64)
    # the units hold no bytes but those in common and one more, which all of them are ahead of
    return np.unique(_symbols([c + b" \0\0" for c in both], np.ones(len(both), dtype=np.int64))[0].word & ~_LOW)


def _count(beginnings: np.ndarray):
    """Counts of (predictor, hash of context and node): zeros and ones; for the word so far, which is counted where its
    items are, only those of (beginning, byte) that are in several parts (in n1)."""
    def counted(items, n):
        s, _ = _symbols(items, n)
        shared = _among(s.word, beginnings)
        word, which = np.unique(s.word[shared], return_inverse=True)
        out = [(np.full(len(word), TABLES, np.int32), word.view(np.int64), np.zeros(len(word), np.int64),
                np.bincount(which, weights=s.weight[shared], minlength=len(word)).astype(np.int64))]
        on = s.weight > 0
        for k in range(TABLES if on.any() else 0):
            # a context's bytes are counted before its bits
            pair, first, which = _distinct((s.context[k] & ~_LOW | s.byte)[on])
            weight = np.bincount(which, weights=s.weight[on])
            sym, entry = _entry(s.byte[on][first])
            h, _, which = _distinct(_hashes(s.context[k][on][first], sym, NODE[entry]))
            out.append((np.full(len(h), k, np.int32), h.view(np.int64),
                        *(np.bincount(which, weights=weight[sym] * (BIT[entry] == b), minlength=len(h)).astype(np.int64)
                          for b in (0, 1))))
        for row in out:
            for at in range(0, len(row[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 17)]) for c in row],
                                                 names=["k", "h", "n0", "n1"])

    def run(batches):
        for items, n in _parts(batches):
            yield from counted(items, n)

    return run


def _chunk(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """Codes of consecutive slots, of the sums of the counts that fall into them."""
    at = part["slot"].to_numpy() & ((1 << CHUNK_BITS) - 1)
    n0, n1 = (np.bincount(at, weights=part[c].to_numpy(), minlength=1 << CHUNK_BITS) for c in ("n0", "n1"))
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "codes": pa.array([_codes(n0, n1).tobytes()])})


def _learn_parts(counts):
    """Each part's share of weights and map, with the count of its tokens and of its words; they don't cross parts."""
    def run(batches):
        for items, n in _parts(batches):
            s, _ = _symbols(items, n)
            mixer = Mixer()
            mixer.learn(s, counts.value.of_part(s))
            share = np.append(mixer.share(), [n.sum(), len({i[:-2] for i, m in zip(items, n.tolist()) if m})])
            yield pa.RecordBatch.from_arrays([pa.array([share], pa.list_(pa.int64()))], names=["share"])
    return run


def _score_parts(counts, mixer: Mixer):
    """Items of a part with the count of their word and the model's log10 probability of their symbols."""
    refined = mixer.refined()

    def run(batches):
        for items, n in _parts(batches):
            s, which = _symbols(items, n)
            lp = mixer.log10(s, counts.value.of_part(s), refined)
            size = np.array([len(i) - 2 for i in items])
            score = np.bincount(np.repeat(np.arange(len(n)), size), weights=lp[which], minlength=len(n))
            number: dict[bytes, int] = defaultdict(count().__next__)
            word = np.array([number[i[:-2]] for i in items])
            of_word = np.bincount(word, weights=n).astype(np.int64)[word]
            for at in range(0, len(n), 1 << 15):
                to = at + (1 << 15)
                yield pa.RecordBatch.from_arrays([pa.array(items[at:to], pa.binary()), pa.array(n[at:to]),
                                                  pa.array(of_word[at:to]), pa.array(score[at:to])],
                                                 names=["item", "often", "n", "lp"])
    return run


@dataclass
class Head:
    """The most frequent items: place of each in the arrays of counts and scores, whose last entry is for all others."""
    place: dict[bytes, int]
    n: np.ndarray
    lp: np.ndarray


def train(docs: DataFrame, held_out, text_col: str = "text") -> tuple[DataFrame, Head, int, int]:
    """(items, most frequent items, N, V), the first without the second: of each (word, mark ahead of it) of ``docs`` the
    count n of the word in the rows that aren't ``held_out`` and log10 of the probability lp that the model learnt from
    these gives to its bytes.

    All counts are of the whole corpus.  Of the last bytes, and of the mark with the last two: a table of (predictor,
    context, node) in Spark, from which a table with ROOM slots for each of them is made.  Of the word so far, with and
    without the mark: items are range-partitioned by word, so that equal beginnings of words lie together, and are counted
    exactly in their part; what is behind the few beginnings that go across the border of parts is summed over all.

    Weights are learnt online in each part: the gated weights follow the error of every byte of the corpus, predicted by
    what all other bytes say (its own occurrence is taken out of the counts), and the adaptive map counts where
    predictions fell.  Equal bytes behind an equal mark and beginning are one step, weighed by their number.  Maps add up, and
    weights are averaged by the bits seen at their gate, all in whole numbers, whose sums don't depend on the order.
    """
    spark = docs.sparkSession
    counted = stage_table(docs.select(F.col(text_col).alias("t"), held_out.alias("out"))
                          .mapInArrow(_count_items, "word binary, mark binary, n long")
                          .groupBy("word", "mark").agg(F.sum("n").alias("n")), "lm-items")
    parts = counted.count() // PART + 1
    items = stage_table(counted.repartitionByRange(parts, "word").mapInArrow(_packed, _PART), "lm-parts")
    drop_table(counted)
    ends = sorted((bytes(r["least"]), bytes(r["most"])) for r in items.select("least", "most").collect())
    beginnings = _beginnings([(x[1], y[0]) for x, y in zip(ends[:-1], ends[1:])])
    found = stage_table(items.mapInArrow(_count(beginnings), "k int, h long, n0 long, n1 long")
                        .groupBy("k", "h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "lm-counts")
    sizes = {r["k"]: r["count"] for r in found.groupBy("k").count().collect()}
    tables = []
    for k in range(TABLES):
        bits = max(8, (ROOM * sizes.get(k, 0)).bit_length())
        tables.append(np.zeros(1 << bits, dtype=np.uint16))
        slot = F.shiftrightunsigned("h", 64 - bits)
        for r in (found.where(F.col("k") == k).select(slot.alias("slot"), "n0", "n1")
                  .groupBy(F.shiftrightunsigned("slot", CHUNK_BITS).alias("chunk")).applyInArrow(_chunk, "chunk long, codes binary")
                  .toArrow().to_pylist()):  # two bytes a slot
            codes = np.frombuffer(r["codes"], dtype=np.uint16)[:1 << bits]
            tables[k][r["chunk"] << CHUNK_BITS:][:len(codes)] = codes
    shared = found.where(F.col("k") == TABLES).select("h", "n1").toArrow()
    drop_table(found)
    counts = spark.sparkContext.broadcast(Counts(tables, beginnings, shared["h"].to_numpy().astype(np.int64).view(np.uint64),
                                                 shared["n1"].to_numpy()))
    mixer = Mixer()
    share = (items.mapInArrow(_learn_parts(counts), "share array<long>")
             .select(F.posexplode("share").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at")
             .toArrow()["x"].to_numpy())
    tokens, words = 0, 0
    if len(share):
        mixer.take(share[:-2])
        tokens, words = share[-2:].tolist()
    scored = stage_table(items.mapInArrow(_score_parts(counts, mixer), "item binary, often long, n long, lp double"),
                         "lm-scored-items")
    drop_table(items)
    # items at least as frequent as the count from which there are at most HEAD; counts sum to the tokens, so there are
    # at most sqrt(2 * tokens) distinct ones
    upto = F.sum("items").over(W.orderBy(F.desc("often")).rowsBetween(W.unboundedPreceding, 0))
    least = (scored.groupBy("often").agg(F.count(F.lit(1)).alias("items")).withColumn("upto", upto)
             .where(F.col("upto") <= HEAD).agg(F.min("often")).first()[0])
    most = scored.where(F.col("often") >= least if least is not None else F.lit(False)).select("item", "n", "lp").toArrow()
    rest = scored.where(F.col("often") < least) if least is not None else scored
    head = Head(dict(zip(most["item"].to_pylist(), range(most.num_rows))), np.append(most["n"].to_numpy(), 0),
                np.append(most["lp"].to_numpy(), 0.0))
    return rest.select("item", "n", "lp"), head, tokens, words


def _score(head):
    """Of each text: tokens, known tokens, sum of log10(c + 1) and score of the broadcast items, and the other items
    with their counts."""
    def run(batches):
        known: Head = head.value
        missing = len(known.n) - 1
        for b in batches:
            texts = byte_texts(b.column("t"))
            for lo, hi in groups_by_bytes(texts, STEP_BYTES):
                s = _step(texts[lo:hi])
                begin = np.cumsum(s.size) - s.size
                at = np.fromiter((known.place.get(i, missing) for i in s.items), dtype=np.int64, count=len(s.items))
                there, n, lp = at < missing, known.n[at], known.lp[at]
                logs = np.log10(n + 1)
                per = np.add.reduceat(np.stack([n[s.ids] > 0, logs[s.ids], lp[s.ids]]), begin, axis=1)
                rare = np.flatnonzero(~there[s.ids])
                of_text = np.repeat(np.arange(len(s.size)), s.size)[rare]
                pair, times = np.unique(of_text * len(s.items) + s.ids[rare], return_counts=True)  # (text, item) once
                cuts = pa.array(np.searchsorted(pair, np.arange(len(s.size) + 1) * len(s.items)), pa.int32())
                tails = pa.array([s.items[i] for i in (pair % len(s.items)).tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id")[lo:hi], b.column("seq")[lo:hi], pa.array(s.size),
                     pa.array(per[0].astype(np.int64)), pa.array(per[1]), pa.array(per[2]),
                     pa.ListArray.from_arrays(cuts, tails), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))],
                    names=["id", "seq", "n_tokens", "known", "logs", "score", "rare", "times"])
    return run


def score_language(docs: DataFrame, mod: int = 7, held: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Score every whole text by a context-mixing model and a unigram base learnt from the texts that aren't held out.

    A text is the sequence of its words and an end, as it is for the base.  Held out are ids with
    crc32(id as text) mod ``mod`` equal to ``held``.  A-Z are lower-cased.  The model gives each byte and the end of a
    text bit by bit: predictions by contexts (the last two and four bytes of the word; the mark, which is the last short word
    ahead, hashed, and the last two bytes; the word so far; the mark and the word so far) are stretched, weighed by
    a weight set that the evidence for them selects, mixed and refined by an adaptive map; score is log10 of the
    product, so -score * log2(10) are the text's total bits.  While scoring, nothing is learnt, so scores don't depend
    on the order of texts, and each (word, mark ahead of it) is scored once (see
    :func:`train`).  base_score is the sum over words and the end token of log10((c + 1) / (N + V + 1)); the HEAD most
    frequent items are looked up where the text is, all others by a join.

    Null texts count as empty (the end token alone); repeated rows each get a row; a null id hashes as the empty
    text; without training texts the model is the untrained one and N = V = 0.  Other columns aren't read.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with shuffles_dropped(spark):
        items, most, tokens, kinds = train(docs, crc_rest(F.col(id_col), mod) == held, text_col)
    head = spark.sparkContext.broadcast(most)  # HEAD items at most
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), row_seq().alias("seq"), F.col(text_col).alias("t"))
    scored = stage_table(rows.mapInArrow(
        _score(head), f"id {kind}, seq long, n_tokens long, known long, logs double, score double, "
                      "rare array<binary>, times array<long>"), "lm-scored")
    times = F.col("times")
    rare = (scored.select("seq", F.explode(F.arrays_zip("rare", "times")).alias("w"))
            .select("seq", F.col("w.rare").alias("item"), F.col("w.times").alias("times"))
            .join(items, "item").groupBy("seq")
            .agg(F.sum(F.when(F.col("n") > 0, times)).alias("more"),
                 F.sum(times * F.log10(F.col("n") + 1)).alias("more_logs"),
                 F.sum(times * F.col("lp")).alias("more_score")))
    total = float(np.log10(tokens + kinds + 1))
    return (scored.drop("rare", "times").join(rare, "seq", "left")
            .select(F.col("id").alias(id_col), (crc_rest(F.col("id"), mod) == held).alias("held_out"), "n_tokens",
                    (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                    F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(total))
                    .alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")))
