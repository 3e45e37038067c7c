"""Best-fit packing by minimum bin slack, planned on the histogram of lengths."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import fresh, gapless, held, small_batches, stored

# Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Byte-level BPE ids of whole texts, as the tokenizer itself gives them.

    A vocabulary that also lies there as ranks is merged by those, which is several times as fast; a
    test says that ids are equal. Others are the tokenizer's own work. A special token's own text in a
    document is that token, as it is for the tokenizer; ``special=False`` reads it as ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, before = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added} if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        known = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        known = known and spec["model"]["type"] == "BPE" and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.path, self.ordinary, self._tokenizer = path, not special, None
        self.core = self.ranked(path) if known else None

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.encode_special_tokens = self.ordinary
        return self._tokenizer

    def ranked(self, path: str):
        """The same merges by rank, if the vocabulary is also there as ranks; else None."""
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks == path or not os.path.exists(ranks):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})._core_bpe

    def encode(self, text: str) -> bytes:
        if self.core is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.special and any(map(text.__contains__, self.special)):
            return b"".join(self.special.get(x) or self.between(x) for x in self.cut.split(text) if x)
        return self.between(text)

    def between(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()


def piece_rows(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32): a longer document's first piece takes what ``size`` leaves over."""
    n = len(ids) // 4
    head = (n - 1) % size + 1
    out, start = [], 0
    for k in range((n - head) // size + 1):
        end = head + k * size
        out.append((k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
        start = end
    return out


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece of each document's ids, ``end_id`` last. A null text is empty: one piece of one id."""
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = held(f"bpe {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            rows, ids = [[] for _ in range(5)], batch.column(0).to_pylist()
            for d, t in zip(ids, batch.column(1)):
                for row in piece_rows((enc.encode(s) if (s := t.as_py()) else b"") + last, size):
                    for c, v in zip(rows, (d, *row), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best, long ones first.

    Subset sums as bits of one integer: after each length (its copies doubled up in powers of two),
    bit s says that sum s can be reached. Walked back from the highest bit.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, block = left - take, block * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum bin slack over a histogram: (length, first rank, last rank + 1, first bin, copies a bin, offset).

    Each bin opens with the longest remaining length; the fullest combination joins it. A pattern is
    repeated for as many bins as its lengths last, so the work depends on the number of distinct
    lengths, at most ``size``, not on documents.
    """
    counts = {k: n for k, n in histogram.items() if n and k <= size}
    rank, bins, out = dict.fromkeys(counts, 0), 0, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = fullest({k: n for k, n in counts.items() if n}, size - longest) if size > longest else {}
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(counts[k] // m for k, m in pattern.items()), 0
        for k in sorted(pattern, reverse=True):
            m = pattern[k]
            out.append((k, rank[k], rank[k] + m * times, bins, m, offset))
            rank[k] += m * times
            offset += k * m
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
        bins += times
    return out


def pack(parts: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``.

    The driver reads one count a length and plans all bins; rows are ranked within their length
    (in parts, so a hot length is many tasks) and find their bin in the plan, which has a bounded
    number of rows. Rows with a null length get null places.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in parts.filter("length IS NOT NULL").groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(k < 1 or k > size for k in histogram):
        raise ValueError(f"lengths have to be 1 to {size}")
    table = sorted(plan(histogram, size))
    keys = np.array([(k << 44) + a for k, a, *_ in table], np.int64)
    first, bins, copies, offsets, lengths = (np.array([r[i] for r in table], np.int64) for i in (1, 3, 4, 5, 0))
    rank, = fresh(parts, "_rank")
    ranked = gapless(parts, "length", F.struct(*order), order, rank)
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = parts.columns

    def place(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length"))
            known = np.asarray(length.is_valid())
            k = np.asarray(length.fill_null(0)).astype(np.int64)
            r = np.asarray(b.column(b.schema.get_field_index(rank)).fill_null(0)).astype(np.int64)
            i = np.searchsorted(keys, (k << 44) + r, "right") - 1
            if len(keys):
                t = r - first[i]
                seq, off = bins[i] + t // copies[i], offsets[i] + t % copies[i] * lengths[i]
            else:
                seq = off = np.zeros(len(k), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq, mask=~known), pa.array(off, mask=~known)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 1024) -> DataFrame:
    """Cut documents into pieces and pack them. Repeated documents are packed as often as they come.

    Null texts are empty, so they hold the end id alone; null ids pass through; an empty table gives
    an empty result; columns other than doc_id and text are not read.
    """
    parts = stored(pieces(docs, tokenizer or vocabulary(), size), "pieces")
    return pack(parts, size, ["doc_id", "piece", "ids_crc32"])


def op3(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs)
