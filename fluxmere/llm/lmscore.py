"""Language-model scores from an Elias-Fano n-gram trie in memory-mapped levels."""

from __future__ import annotations

import os
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import slices, utf8, words
from .util import fold, held, local_path, new_path

END = np.uint64(0xE7D0F7EC57A11E5D)
DISCOUNT = 0.75
ORDER = 3
SLICE = 4 << 20  # bytes of text scored at once
HELD = 1 << 21  # entries that a task sums up before it hands them on

_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i
_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def place_of(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th set bit (from 0) of each 64-bit word stands; sums of its bytes side by side in one word."""
    with np.errstate(over="ignore"):
        s = word - (word >> np.uint64(1) & np.uint64(0x5555555555555555))
        s = (s & np.uint64(0x3333333333333333)) + (s >> np.uint64(2) & np.uint64(0x3333333333333333))
        s = (s + (s >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
        k = k.astype(np.uint64)
        shift = ((((k * _ONES | _TOPS) - s & _TOPS) >> np.uint64(7)) * _ONES >> np.uint64(56)) << np.uint64(3)
        rest = k - (s << np.uint64(8) >> shift & np.uint64(255))
        byte = (word >> np.minimum(shift, np.uint64(63)) & np.uint64(255)).astype(np.int64)
    return shift.astype(np.int64) + _SELECT[byte, rest.astype(np.int64) & 7]


def mapped(path: str) -> np.ndarray:
    return np.asarray(np.load(path, mmap_mode="r"))


class EliasFano:
    """A monotone sequence of n numbers below u in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, low_bits: int, universe: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.universe, self.low, self.high, self.zeros = n, low_bits, universe, low, high, zeros
        self.ones = np.arange(len(zeros), dtype=np.int64) * 64 - zeros  # set bits before each word

    @staticmethod
    def build(values: np.ndarray, universe: int, path: str) -> None:
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1) if universe > n else 0
        v = values.astype(np.uint64)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits and n:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (n + (universe >> bits) + 2 + 63) // 64 + 1
        flags = np.zeros(size * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        np.save(f"{path}.low.npy", low)
        np.save(f"{path}.high.npy", high)
        np.save(f"{path}.zeros.npy", zeros)
        np.save(f"{path}.head.npy", np.array([n, bits, universe], np.uint64))

    @classmethod
    def load(cls, path: str) -> EliasFano:
        n, bits, universe = (int(x) for x in np.load(f"{path}.head.npy"))
        return cls(n, bits, universe, *(mapped(f"{path}.{k}.npy") for k in ("low", "high", "zeros")))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        out |= self.low[word + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return out & np.uint64((1 << self.low_bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th number, for sorted places i: the i-th set bit tells its high part."""
        if not len(i):
            return np.zeros(0, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + place_of(self.high[word], i - self.ones[word])
        return ((place - i) << self.low_bits) | self._lows(i).astype(np.int64)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the numbers with high part h: the set bits behind the h-th zero bit."""
        last = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, last, "right") - 1
        place = word * 64 + place_of(~self.high[word], last - self.zeros[word]) + 1
        place = np.where(h > 0, place, 0)
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        bits = self.high[word] >> shift
        bits |= self.high[np.minimum(word + 1, len(self.high) - 1)] << (np.uint64(63) - shift) << np.uint64(1)
        with np.errstate(over="ignore"):
            run = np.bitwise_count((~bits & (bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        first = place - h
        long = np.flatnonzero(run == 64)
        if len(long):  # over 64 numbers share a high part: its end is the next zero bit
            word = np.searchsorted(self.zeros, h[long], "right") - 1
            run[long] = word * 64 + place_of(~self.high[word], h[long] - self.zeros[word]) - place[long]
        return first, first + run

    def find(self, v: np.ndarray) -> np.ndarray:
        """Place of each v (sorted) by successor search: the first number not below v, if it is v; else -1."""
        out = np.full(len(v), -1)
        valid = np.flatnonzero(v < self.universe)
        if not self.n or not len(valid):
            return out
        v = v[valid] if len(valid) < len(v) else v
        lo, end = self._bucket((v >> self.low_bits).astype(np.int64))
        want = v.astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        # in a few steps through short runs of one high part, by halves in long ones
        open_ = np.flatnonzero(end - lo > 8)
        hi = end[open_]
        while len(open_):
            mid = (lo[open_] + hi) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi = np.where(less, hi, mid)
            more = lo[open_] < hi
            open_, hi = open_[more], hi[more]
        on = np.flatnonzero(lo < end)
        at, end, want = lo[on], end[on], want[on]
        while len(on):
            low = self._lows(at)
            same = low == want
            out[valid[on[same]]] = at[same]
            more = np.flatnonzero((low < want) & (at + 1 < end))
            on, at, end, want = on[more], at[more] + 1, end[more], want[more]
        return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a byte each, codebook): 256 levels evenly spread between the extremes."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256)
    book = np.linspace(x.min(), x.max(), 256)
    step = book[1] - book[0]
    return (np.round((x - book[0]) / step) if step > 0 else np.zeros(len(x))).astype(np.uint8), book


class Sums:
    """Counts by 64-bit key, handed on as sorted arrays a shard when there are many."""

    def __init__(self, shard_of, shards: int):
        self.shard_of, self.shards, self.parts, self.size = shard_of, shards, [], 0

    def add(self, keys: np.ndarray) -> bool:
        u, c = np.unique(keys, return_counts=True)
        self.parts.append((u, c))
        self.size += len(u)
        return self.size >= 2 * HELD

    def flush(self):
        if not self.parts:
            return
        keys, counts = merge(self.parts)
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        at = np.searchsorted(shard, np.arange(self.shards + 1))
        self.parts, self.size = [], 0
        for s in range(self.shards):
            a, b = at[s], at[s + 1]
            if a < b:
                yield s, *pack_keys(keys[a:b]), pack_counts(counts[a:b])


def merge(parts) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pack_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as gaps of the narrowest width that holds them."""
    gaps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return int(np.int64(np.uint64(keys[0]).view(np.int64))), bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(first: int, raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :width] = body
    with np.errstate(over="ignore"):
        return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64) + np.int64(first).view(np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts under 255 as bytes, the others as eight more behind."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<u8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    big = out == 255
    out[big] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's lower-case words and its end."""
    h, bounds = words(*utf8(column), lower=True)
    n = len(bounds) - 1
    out = np.full(len(h) + n, END, np.uint64)
    text = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(h)) + text] = h
    return out, bounds + np.arange(n + 1)


class Vocabulary:
    """Unigram level: Elias-Fano sequences of word hashes, a file a range of them; ids are ranks. Counts are
    exact, as the base score needs them, in the narrowest type; the model's probabilities are quantised."""

    def __init__(self, folder: str, sizes: list[int], total: int, singles: int):
        self.sizes, self.total = sizes, total
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parts = [None if not n else (EliasFano.load(f"{folder}/u{s}.words"), *(mapped(f"{folder}/u{s}.{k}.npy") for k in ("counts", "prob", "book"))) for s, n in enumerate(sizes)]
        self.unknown = min(1.0, max(singles, 1) / max(total, 1)) if total else 1.0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, count, log10 count as quantised) of sorted hashes; the id of an unknown word is the number of known ones."""
        ids, counts, prob = np.full(len(hashes), self.start[-1]), np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
        shards = len(self.sizes)
        at = np.searchsorted(range_shard(hashes, shards), np.arange(shards + 1))
        for s, part in enumerate(self.parts):
            a, b = at[s], at[s + 1]
            if a < b and part is not None:
                place = part[0].find((hashes[a:b] - np.uint64(range_start(s, shards))).astype(np.int64))
                on = np.flatnonzero(place >= 0)
                ids[a + on] = place[on] + self.start[s]
                counts[a + on] = part[1][place[on]]
                prob[a + on] = part[3][part[2][place[on]]]
        return ids, counts, prob


def range_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)).astype(np.int64) * shards) >> 24


def range_start(shard: int, shards: int) -> int:
    """The least key of a shard: range_shard(key) is ``shard`` from here on."""
    return -(-(shard << 24) // shards) << 40


def write_words(stem: str, shard: int, shards: int, keys: np.ndarray, counts: np.ndarray) -> None:
    first = range_start(shard, shards)
    EliasFano.build(keys - np.uint64(first), min(1 << 64, range_start(shard + 1, shards)) - first, f"{stem}.words")
    prob, book = quantise(np.log10(counts))
    np.save(f"{stem}.counts.npy", narrow(counts))
    np.save(f"{stem}.prob.npy", prob)
    np.save(f"{stem}.book.npy", book)


def narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max(initial=0))
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max))


class Lookup:
    """Keys of a slice's tokens, level by level: a key is a context's id times the vocabulary's size, plus the word's.

    A context's id is the rank of its gram among those of its length; a text's first word follows an end.
    Each level is asked once for each distinct key.
    """

    def __init__(self, model: dict, h: np.ndarray, bounds: np.ndarray):
        self.bounds, self.size = bounds, sum(model["sizes"]) + 1
        vocabulary, self.tries = _load(model)
        u, inverse = np.unique(h, return_inverse=True)
        ids, counts, prob = vocabulary.find(u)
        self.ids, self.words, self.inverse = ids[inverse], (counts, prob), inverse
        end = int(vocabulary.find(np.array([END]))[0][0])
        self.context = self.shifted(np.where(self.ids < self.size - 1, self.ids, -1), end if end < self.size - 1 else -1)

    def shifted(self, grams: np.ndarray, first: int) -> np.ndarray:
        """The gram that ends before each token, -1 for none."""
        out = np.empty_like(grams)
        out[1:] = grams[:-1]
        out[self.bounds[:-1]] = first
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys of the next level, tokens that have one: those behind a known context)."""
        on = np.flatnonzero(self.context >= 0)
        return self.context[on].astype(np.uint64) * np.uint64(self.size) + self.ids[on].astype(np.uint64), on

    def unigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, log10 of one more, count as quantised) of each token; powers are taken of distinct words."""
        counts, prob = self.words
        return counts[self.inverse], np.log10(counts + 1.0)[self.inverse], (10.0**prob)[self.inverse]

    def levels(self, values: bool = True):
        """(tokens behind a known context, their discounted share, the context's backoff) of each level; powers are taken of distinct keys."""
        for trie in self.tries:
            keys, on = self.keys()
            k, back = np.unique(keys, return_inverse=True)
            prob, gamma, place = trie.find(k)
            grams = np.full(len(self.ids), -1)
            grams[on] = place[back]
            self.context = self.shifted(grams, -1)
            yield (on, (10.0**prob)[back], (10.0**gamma)[back]) if values else ()


class Trie:
    """A level of the trie, in shards of key ranges. A shard holds, for its range of contexts,

    - ``pointers``: Elias-Fano sequence of where each context's successors begin, all contexts of the range;
    - ``words``: Elias-Fano sequence of their word ids, each context's counted on from the last one's end;
    - a byte a successor and a byte a context: quantised log10 of discounted share and of backoff.

    A successor is searched within its context: pointers give the context's range, the number before the
    range is what its word ids were counted on from, and the successor search finds id and offset together.
    """

    def __init__(self, folder: str, level: int, bounds: list[int], full: list[int], size: int, shared: dict[int, float]):
        self.bounds, self.size, self.shared = np.array(bounds, np.uint64), size, shared
        self.start = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
        self.parts = [None if not n else (
            EliasFano.load(f"{folder}/g{level}-{s}.pointers"), EliasFano.load(f"{folder}/g{level}-{s}.words"),
            *(mapped(f"{folder}/g{level}-{s}.{k}.npy") for k in ("prob", "backoff", "books")),
        ) for s, n in enumerate(full)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of the discounted share or -inf, log10 of the context's backoff, id or -1) of sorted keys."""
        prob, back, ids = np.full(len(keys), -np.inf), np.zeros(len(keys)), np.full(len(keys), -1)
        at = np.concatenate([[0], np.searchsorted(keys, self.bounds), [len(keys)]])
        for s, part in enumerate(self.parts):
            a, b = at[s], at[s + 1]
            if a == b or part is None:
                continue
            pointers, words, codes, backs, books = part
            ctx, word = np.divmod(keys[a:b].astype(np.int64), self.size)
            ctx -= int(self.bounds[s - 1]) // self.size if s else 0
            new = np.append(True, ctx[1:] != ctx[:-1])
            one = ctx[new]
            inside = one < pointers.n - 1  # contexts behind the shard's last one have no successor
            one = np.minimum(one, pointers.n - 2)
            first, end = pointers.at(one), pointers.at(one + 1)
            some = inside & (first < end)
            base = np.zeros(len(one), np.int64)
            behind = np.flatnonzero(some & (first > 0))
            base[behind] = words.at(first[behind] - 1)
            gamma = np.where(some, books[1][backs[one]], 0.0)
            of = np.cumsum(new) - 1
            back[a:b] = gamma[of]
            ask = np.flatnonzero(some[of] & (word < self.size - 1))
            place = words.find(base[of[ask]] + word[ask] + 1)
            hit = (place >= first[of[ask]]) & (place < end[of[ask]])
            on = a + ask[hit]
            prob[on] = books[0][codes[place[hit]]]
            ids[on] = self.start[s] + place[hit]
        if self.shared:
            owner = (keys // np.uint64(self.size)).astype(np.int64)
            known = np.array(sorted(self.shared), np.int64)
            spot = np.minimum(np.searchsorted(known, owner), len(known) - 1)
            hit = known[spot] == owner
            back[hit] = np.array([self.shared[c] for c in known.tolist()])[spot[hit]]
        return prob, back, ids


def write_shard(stem: str, keys: np.ndarray, counts: np.ndarray, size: int, base: int, contexts: int, totals: np.ndarray) -> list:
    """Smooth and write one range of a level, with ``contexts`` contexts from ``base`` on. Returns the sums of its first and last context."""
    ctx, word = (keys // np.uint64(size)).astype(np.int64) - base, (keys % np.uint64(size)).astype(np.int64)
    first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ctx))))
    share = (counts - DISCOUNT) / totals
    mass = np.add.reduceat(share, first)
    prob, book = quantise(np.log10(share))
    back, back_book = quantise(np.log10(np.maximum(1 - mass, 1e-9)))
    backs = np.zeros(contexts, np.uint8)
    backs[ctx[first]] = back
    last = np.append(first[1:], len(ctx)) - 1
    offset = np.concatenate([[0], np.cumsum(word[last] + 1)])
    EliasFano.build(np.searchsorted(ctx, np.arange(contexts + 1)), len(ctx) + 1, f"{stem}.pointers")
    EliasFano.build(offset[owner] + word + 1, int(offset[-1]) + 1, f"{stem}.words")
    np.save(f"{stem}.prob.npy", prob)
    np.save(f"{stem}.backoff.npy", backs)
    np.save(f"{stem}.books.npy", np.stack([book, back_book]))
    return [(int(ctx[first[k]]) + base, float(mass[k])) for k in {0, len(first) - 1}]


BLOBS = "shard int, first long, keys binary, counts binary"


def _load(model: dict) -> tuple[Vocabulary, list[Trie]]:
    """This worker's mapped files of a model; levels that were written since join those it has."""
    size = sum(model["sizes"]) + 1
    vocabulary, tries = held(f"lm {model['folder']}", lambda: (Vocabulary(model["folder"], model["sizes"], model["total"], model["singles"]), []))
    for made in model["levels"][len(tries) :]:
        tries.append(Trie(model["folder"], len(tries) + 2, size=size, **made))
    return vocabulary, tries[: len(model["levels"])]


def blobs(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "first", "keys", "counts"])


def by_shard(counted: DataFrame, shards: int, write, schema: str) -> list:
    """Rows of ``write(shard, keys, counts)`` for each shard's merged blobs; a shard is a partition of its own."""

    def run(batches):
        parts: dict = {}
        for b in batches:
            for s, f, k, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                parts.setdefault(s, []).append((f, k, c))
        for s in sorted(parts):
            keys, counts = merge([(unpack_keys(f, k), unpack_counts(c, (len(k) - 1) // k[0])) for f, k, c in parts.pop(s)])
            rows = write(s, keys, counts)
            if rows:
                yield pa.Table.from_pylist(rows, named).to_batches()[0]

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    named = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])
    return counted.repartitionById(shards, "shard").mapInArrow(run, schema).collect()


def train(texts: DataFrame, order: int = ORDER, cutoff: int = 1) -> dict:
    """Count, smooth and write the model of all of ``texts`` (text) to the shared folder.

    Unigrams, then bigrams, then as many longer grams as ``order`` says: tasks sum up what they see
    and hand on sorted, gap-coded arrays, one a shard; a shard is a range of keys, with as many shards
    as the input has parts, so no task gathers more as the input grows. Ranges are cut by the
    counts of the contexts, inside a frequent context if it outweighs a shard. Grams of two words and
    more that are seen fewer than ``cutoff`` times are left to the backoff; 1 keeps all. Files are written
    whole under a temporary name first, so a repeated task does no harm. The driver holds a few numbers a
    shard. Keys are 64-bit numbers: a level of n grams over v words needs n * v < 2^63, else ValueError
    (a larger ``cutoff`` keeps fewer grams). Repeated rows count as often as they come; other columns aren't read.
    """
    spark = texts.sparkSession
    folder = local_path(new_path(spark, "lm"))
    rows = texts.select("text")
    shards = max(4, rows.rdd.getNumPartitions())

    def count(batches):
        sums = Sums(lambda k: range_shard(k, shards), shards)
        for batch in batches:
            for part in slices(batch, "text"):
                if sums.add(tokens(part.column(0))[0]):
                    yield from (blobs([r]) for r in sums.flush())
        yield from (blobs([r]) for r in sums.flush())

    def write(s, keys, counts):
        with moved(folder, f"u{s}") as temporary:
            write_words(f"{temporary}/u{s}", s, shards, keys, counts)
        return [{"shard": s, "n": len(keys), "total": int(counts.sum()), "singles": int((counts == 1).sum())}]

    found = by_shard(rows.mapInArrow(count, BLOBS), shards, write, "shard int, n long, total long, singles long")
    sizes = [0] * shards
    for r in found:
        sizes[r["shard"]] = r["n"]
    model = {"folder": folder, "sizes": sizes, "total": sum(r["total"] for r in found), "singles": sum(r["singles"] for r in found), "levels": []}
    stem, totals = "u", {r["shard"]: r["total"] for r in found}
    for level in range(2, order + 1) if found else ():
        made, totals = longer(rows, model, level, cutoff, stem, sizes, totals, shards, level == order)
        model = model | {"levels": [*model["levels"], made]}
        stem, sizes = f"g{level}-", made["full"]
    return model


def longer(rows: DataFrame, model: dict, level: int, cutoff: int, stem: str, sizes: list[int], totals: dict, shards: int, last: bool) -> tuple[dict, dict]:
    """Count, smooth and write a level. Its contexts are the grams below, ``sizes`` and ``totals`` a shard in files ``stem``."""
    spark, folder, size = rows.sparkSession, model["folder"], sum(model["sizes"]) + 1
    if sum(sizes) * size >= 1 << 63:
        raise ValueError(f"{sum(sizes)} contexts of {size} words don't fit 64-bit keys: raise the cutoff")
    before, at = {}, 0
    for s in sorted(totals):
        before[s] = at
        at += totals[s]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    step = at / shards

    def cut(batches):
        for b in batches:
            out = []
            for s in b.column(0).to_pylist():
                counts = np.load(f"{folder}/{stem}{s}.counts.npy", mmap_mode="r") if sizes[s] else np.zeros(0, np.int64)
                total = np.cumsum(counts, dtype=np.int64) + before.get(s, 0)
                for k in range(1, shards):
                    if before.get(s, 0) <= k * step < (total[-1] if len(total) else 0):
                        i = int(np.searchsorted(total, k * step, "right"))
                        inside = (k * step - (total[i] - int(counts[i]))) / int(counts[i])
                        split = inside if counts[i] > step else 0
                        out.append(int(starts[s] + i) * size + int(split * size))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["key"])

    bounds = sorted({r["key"] for r in spark.range(len(sizes)).repartition(min(len(sizes), 64)).mapInArrow(cut, "key long").collect()})
    pieces = len(bounds) + 1
    limits = np.array(bounds, np.uint64)

    def count_grams(batches):
        sums = Sums(lambda k: np.searchsorted(limits, k, "right"), pieces)
        for batch in batches:
            for part in slices(batch, "text"):
                look = Lookup(model, *tokens(part.column(0)))
                for _ in look.levels(values=False):
                    pass
                if sums.add(look.keys()[0]):
                    yield from (blobs([r]) for r in sums.flush())
        yield from (blobs([r]) for r in sums.flush())

    def write(s, keys, counts):
        keep = counts >= cutoff
        keys, counts = keys[keep], counts[keep]
        if not len(keys):
            return []
        ctx = (keys // np.uint64(size)).astype(np.int64)
        context_totals = np.zeros(len(keys))
        shard = np.searchsorted(starts, ctx, "right") - 1
        for v in np.unique(shard):
            on = shard == v
            context_totals[on] = np.load(f"{folder}/{stem}{v}.counts.npy", mmap_mode="r")[ctx[on] - starts[v]]
        base = bounds[s - 1] // size if s else 0
        end = bounds[s] // size + 1 if s < len(bounds) else int(starts[-1])
        with moved(folder, f"{level}-{s}") as temporary:
            ends = write_shard(f"{temporary}/g{level}-{s}", keys, counts, size, base, min(end, int(starts[-1])) - base, context_totals)
            if not last:
                np.save(f"{temporary}/g{level}-{s}.counts.npy", narrow(counts))
        return [{"shard": s, "n": len(keys), "total": int(counts.sum()), "context": c, "mass": m} for c, m in ends]

    found = by_shard(rows.mapInArrow(count_grams, BLOBS), pieces, write, "shard int, n long, total long, context long, mass double")
    full, masses = [0] * pieces, {}
    for r in found:
        full[r["shard"]] = r["n"]
        masses.setdefault(r["context"], {})[r["shard"]] = r["mass"]
    shared = {c: float(np.log10(max(1 - sum(m.values()), 1e-9))) for c, m in masses.items() if len(m) > 1}
    return {"bounds": bounds, "full": full, "shared": shared}, {r["shard"]: r["total"] for r in found}


@contextmanager
def moved(folder: str, name: str):
    """A temporary folder whose files are moved to ``folder`` once all are written."""
    temporary = f"{folder}/part-{os.getpid()}-{name}"
    os.makedirs(temporary, exist_ok=True)
    yield temporary
    for f in os.listdir(temporary):
        os.replace(f"{temporary}/{f}", f"{folder}/{f}")
    os.rmdir(temporary)


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: dict, extra: tuple) -> DataFrame:
    """Rows of ``extra`` with token counts, the add-one unigram ``base_score`` and the model's ``score``.

    p(w | v) is the discounted share of the bigram plus, weighted by what the discount and the cutoff
    left over, p(w); p(w | u v) is that of the trigram plus p(w | v) so weighted, and so on; behind a
    context without successors it is the shorter context's. p(w) = (1 - unknown) c / N, and all unknown
    words together, as one word, have the Good-Turing share of words seen once, so probabilities behind
    any context sum to 1. Null and empty texts consist of their end. An empty training table leaves every
    token unknown, at probability 1. Repeated rows repeat their result.
    """
    rows = docs.select(*extra, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", {SCORES}"

    def run(batches):
        vocabulary, _ = _load(model)
        total = vocabulary.total
        norm = np.log10(total + sum(model["sizes"]) + 1)
        unknown, known = vocabulary.unknown, max(1 - vocabulary.unknown, 1e-9) / max(total, 1)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                h, bounds = tokens(part.column(part.num_columns - 1))
                look = Lookup(model, h, bounds)
                c, base, share = look.unigrams()
                base -= norm
                value = np.where(c > 0, share * known, unknown)
                for on, share, back in look.levels() if len(h) else ():
                    value[on] = share + back * value[on]
                value = np.log10(value)
                n = part.num_rows
                text = np.repeat(np.arange(n), np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.diff(bounds)), pa.array(np.bincount(text[c > 0], minlength=n)), pa.array(np.full(n, total, np.int64)), pa.array(np.bincount(text, base, n)), pa.array(np.bincount(text, value, n))],
                    names=[*part.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return rows.mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fold("doc_id", 7) == 2
    model = train(docs.filter(~out))
    return score(docs.withColumn("held_out", out), model, ("doc_id", "held_out"))
