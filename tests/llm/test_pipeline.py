"""The pipeline on a small corpus with known toxic texts, near copies and texts without a language."""

from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict

import pyarrow as pa

import corpus_pipeline
from fluxmere.llm import minhash, mix
from fluxmere.llm.util import listed

from .test_operators import DE, EN, make_docs


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        words = [r.choice(EN if i % 3 else DE) for _ in range(40)]
        if i % 5 == 0:
            words[7] = r.choice(["idiot", "stupid", "moron"])
        rows.append((i, " ".join(words), "en" if i % 3 else "de", f"src{i % 4}"))
        labels.append((i, 1, int(i % 5 == 0)))
    copies = [(1000 + i, rows[1][1] + f" x{i}", "en", "src0") for i in range(20)]
    odd = [(2000, None, None, None), (2001, "12 34 !!", "en", "src1"), (2002, "", None, "src2")]
    make_docs(spark, rows + copies + odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, docs, after = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after[name] = [x["doc_id"] for x in docs.collect()]
    assert not {2000, 2001, 2002} & set(after["language_id"]) and len(after["language_id"]) == 320
    assert {i for i in range(300) if i % 5} <= set(after["toxicity"]) and not {i for i in range(0, 300, 5)} & set(after["toxicity"])
    group = {1, *range(1000, 1020)}
    assert sorted(group & set(after["near_duplicates"])) == [1] and len(after["near_duplicates"]) == len(after["toxicity"]) - 20
    assert set(after["mix_sources"]) <= set(after["near_duplicates"]) and max(map(after["mix_sources"].count, after["mix_sources"])) <= 2
    assert set(after["pack"]) == set(after["mix_sources"])
    bins = defaultdict(int)
    for x in docs.collect():
        bins[x["sequence_id"]] += x["length"]
    assert max(bins.values()) <= 1024


class Unspread:
    """Stands for a frame: hands back what would run on its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_signatures_hold_little_at_once(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(EN) + str(r.randrange(1000)) for _ in range(200)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    run = minhash.signatures(Unspread(), "doc_id", "text", minhash.SHINGLE, minhash.BANDS, minhash.ROWS)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run([batch])) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_planned_rows_need_no_python_workers(spark, tmp_path):
    rows = [(i, f"{EN[i % 7]} {i}", "en", f"s{i % 3}" if i % 5 else None) for i in range(60)]
    make_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    plan = mix.stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    kind = "a long, b string, c double, d array<struct<x:long,y:long>>, e array<long>"
    data = [(-(1 << 63), None, 0.5, [(1, 2), (3, 4)], []), (5, "ä", -1.0, [], [7])]
    assert listed(spark, data, kind).schema == spark.createDataFrame(data, kind).schema
    assert listed(spark, data, kind).collect() == spark.createDataFrame(data, kind).collect() and listed(spark, [], kind).collect() == []


def test_stages_hand_over_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(i, f"{EN[i % 7]} {i}", "en", "s") for i in range(20)]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        for before, after in ((10_000, 1000), (0, 1000), (7, 7)):
            for stage in (mix.stage, minhash.stage):
                spark.conf.set(name, before)
                stage(spark, make_docs(spark, rows), "")
                seen = [x["n"] for x in spark.range(2500).coalesce(1).mapInArrow(sizes, "n long").collect()]
                assert max(seen) == after and sum(seen) == 2500
    finally:
        spark.conf.unset(name)


def test_kept_ids_are_joined_alike_at_any_size(spark, tmp_path):
    make_docs(spark, [(i, f"{EN[i % 7]} {i}", "en", "s") for i in range(30)]).write.parquet(str(tmp_path / "documents.parquet"))
    plan = minhash.stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
