"""The registered queries themselves: their columns and folds, on tables with odd rows and clashing columns, and on empty ones."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fluxmere.llm.queries import QUERIES

from .test_operators import DE, EN, WORD, make_docs, rows_of, sample

COLUMNS = {
    "op1": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op2": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6": {"doc_id": "bigint", "class_id": "bigint", "component_id": "bigint"},
    "op7": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}


def key(name):
    return name.split("_")[0]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of small tables with clashing columns, and of empty ones; and the rows."""
    r = random.Random(11)
    docs = [*sample(150), (900, "漢字 " * 30, None, "src1"), (901, "🙂 word " * 9000, "en", "src0"), (902, "a b c", None, None)]
    docs += [(1000 + i, " ".join([*(r.choice(EN) for _ in range(30)), r.choice(["idiot", "stupid"])] if i % 3 else [r.choice(DE) for _ in range(30)]), "en" if i % 3 else "de", "src1") for i in range(120)]
    pages = [(1, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, None, "<p>x</p>"), (5, "v", "ü" * 50_000)]
    labels = [(i, 1, int(any(w in (t or "") for w in ("idiot", "stupid")))) for i, t, *_ in docs if i is not None] + [(None, 0, 1), (5, 0, None)]
    vectors = [(i, [float(i % 7), 1.0, r.random()], 0) for i in range(60)] + [(90, None, 0), (91, [0.0, 0.0, 0.0], 0), (92, [], 0), (93, [float("nan"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    clash = [f"{i} AS `{c}`" for i, c in enumerate(["row", "rep", "key", "n", "h", "at", "takes", "target", "_g", "_part", "_cell", "_row", "shard", "score", "kept", "predicted", "held_out", "lang_pred", "length", "sequence_id", "_text", "sha", "_sha", "bytes", "component_id", "k1", "codes", "mine", "law", "taken", "record_type"])]
    frames = {
        "documents": make_docs(spark, docs).selectExpr("doc_id", "text", "lang", "source", "n_chars", *clash),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", *clash),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS score"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").selectExpr("*", *[c for c in clash if "`score`" not in c]),
    }
    full, empty = (tmp_path_factory.mktemp(k) for k in ("full", "empty"))
    for name, df in frames.items():
        df.write.parquet(str(full / f"{name}.parquet"))
        df.limit(0).write.parquet(str(empty / f"{name}.parquet"))
    return {"full": str(full), "empty": str(empty), "docs": docs, "pages": pages, "vectors": vectors}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    out = QUERIES[name](spark, tables["empty"])
    assert out.count() == 0
    assert {k: v for k, v in out.dtypes if k in COLUMNS[key(name)]} == COLUMNS[key(name)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, tables, name):
    out = QUERIES[name](spark, tables["full"])
    want = COLUMNS[key(name)]
    assert {k: v for k, v in out.dtypes if k in want} == want
    got = rows_of(out)
    docs = tables["docs"]
    if "doc_id" in want and key(name) != "op3":
        assert Counter(r["doc_id"] for r in got) == Counter(d[0] for d in docs)
    if "held_out" in want:
        fold, out_of = (7, 2) if key(name) == "op5" else (3, 1)
        assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % fold == out_of) for r in got)
    globals()[f"check_{key(name)}"](got, tables)


def check_op1(got, tables):
    want, by = Counter(), defaultdict(list)
    for p, _, h in tables["pages"]:
        by[h or ""].append(p)
    for h, ids in by.items():
        raw = h.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = min((p for p in ids if p is not None), default=None)
        ids = sorted(ids, key=lambda p: (p is None, p))
        for i, p in enumerate(ids):
            want[(p, len(raw), digest, "revisit" if i else "response", first if i else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def check_op2(got, tables):
    texts = {i: t for i, t, *_ in tables["docs"]}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    bad = {i for i, t in texts.items() if any(w in (t or "") for w in ("idiot", "stupid"))}
    found = {r["doc_id"] for r in got if r["predicted"]}
    assert len(found & bad) >= 0.9 * len(bad) and len(found - bad) <= 2


def check_op3(got, tables):
    per = defaultdict(list)
    for r in got:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in per.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert {r["doc_id"] for r in got} == {d[0] for d in tables["docs"]}


def check_op4(got, tables):
    texts = {i: t for i, t, *_ in tables["docs"]}
    for r in got:
        blank = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1


def check_op5(got, tables):
    texts = {i: t for i, t, *_ in tables["docs"]}
    assert len({r["train_tokens"] for r in got}) == 1
    for r in got:
        assert r["n_tokens"] == len(WORD.findall(texts[r["doc_id"]] or "")) + 1 and r["score"] <= 0 and r["base_score"] < 0


def check_op6(got, tables):
    assert all(r["component_id"] is None or r["component_id"] <= r["doc_id"] for r in got if r["doc_id"] is not None)


def check_op7(got, tables):
    sizes, taken = Counter(), Counter()
    src = defaultdict(set)
    for i, t, _, s in tables["docs"]:
        src[i].add(s)
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, set(order)
    total = 1.5 * sum(sizes.values())
    while open_:  # reshare what is above twice a source's size
        rest = total - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in over} if over else share
        open_ = open_ - over if over else set()
    mine = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = next((x for x in src[r["doc_id"]] if abs(want[x] - r["target"]) < 1e-6 and r["source_size"] == sizes[x]), "none")
        assert s != "none"
        taken[s] += r["taken"]
        mine[s].append(r)
    for s, t in want.items():
        fits = [r["size"] for r in mine[s] if r["taken"] < 2 * r["size"]]
        assert taken[s] <= t + 1e-6 and (t - taken[s] <= max(2, t / 1000) or min(fits, default=10**9) > t - taken[s] - 1), s


def check_op8(got, tables):
    import numpy as np

    live = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in tables["vectors"] if i is not None and v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in live])
    links = {i: int(n) - 1 for (i, _), n in zip(live, (x @ x.T >= 0.9).sum(axis=1), strict=True)}
    total = sum(links.values())
    assert 0.9 * total <= sum(r["n_links"] for r in got) <= total
    assert all(r["n_links"] <= links.get(r["vec_id"], 0) and r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None) for r in got)


def check_op9(got, tables):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in tables["docs"])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] <= 39 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def check_op10(got, tables):
    texts = defaultdict(list)
    for i, t, *_ in tables["docs"]:
        texts[i].append(t or "")
    for r in got:
        words = WORD.findall(texts[r["doc_id"]][0])
        assert r["n_words"] == len(words) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", texts[r["doc_id"]][0]))
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words)) and not (r["base_failed"] and r["kept"])
