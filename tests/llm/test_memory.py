"""What workers and batches hold, on small rows."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import blocks, decontamination, lineage, near_dup, packing, quality


def _held() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


def test_a_task_gives_its_memory_back():
    @blocks.giving_back
    def run(batches):
        for batch in batches:
            parts = [pa.array(np.arange(4096) + k) for k in range(4096)]  # 128 MB in small pieces
            yield batch
            del parts

    before = _held()
    assert list(run(iter([1, 2]))) == [1, 2]
    assert _held() - before < 40


def test_a_kept_text_goes_to_python_once(spark):
    docs = spark.createDataFrame([(1, "some words here", "en"), (2, None, "es")], "doc_id long, text string, lang string")
    scored = quality.score(docs, np.zeros((1 << 10) + 1), keep=["text", "lang"])
    assert scored.columns == ["id", "text", "lang", "score"]
    assert [tuple(r) for r in scored.orderBy("id").collect()] == [(1, "some words here", "en", 0.5), (2, None, "es", 0.5)]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"MapInArrow.*\[(.*?)\]", plan)) == 1 and plan.count(" AS __text") == 1 and "text#" in plan


def test_pairs_are_confirmed_in_small_batches(spark):
    seen = []
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept, before = near_dup.cut, spark.conf.get(name)
    near_dup.cut = lambda df: (seen.append(int(spark.conf.get(name))), kept(df))[1]
    try:
        assert near_dup.confirmed(pairs, docs, "doc_id", "text", 2, 0.8).count() == 2
    finally:
        near_dup.cut = kept
    assert seen[-1] == near_dup.BATCH and spark.conf.get(name) == before


def test_a_task_of_the_benchmark_stage_has_one_python_worker(spark, tmp_path):
    passage = " ".join(f"item{k}" for k in range(15))
    spark.createDataFrame([("a", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    filler = " ".join(f"w{k}" for k in range(600))
    rows = [(1, f"{filler} {passage} end"), (2, passage), (3, filler), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(lineage.ARROW_ROWS)
    try:
        out = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert int(spark.conf.get(lineage.ARROW_ROWS)) <= corpus_pipeline.BATCH
        got = {r["doc_id"]: r["text"] for r in out.collect()}
    finally:
        spark.conf.set(lineage.ARROW_ROWS, before)
    found = decontamination.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), keep=["lang", "source"], block_words=2)
    apart = decontamination.remove_spans(found.where(~decontamination.contaminated()), keep=["lang", "source"])
    assert got == {r["doc_id"]: r["text"] for r in apart.collect()}
    assert set(got) == {1, 3, 4, 5} and got[3] == filler and passage not in got[1] and got[1].endswith(" end")


def test_a_packing_task_keeps_few_words():
    ids = packing.WordIds.__new__(packing.WordIds)
    ids.known = {str(k).encode(): b"" for k in range(packing.KEPT_WORDS + 10)}
    ids.forget()
    assert len(ids.known) == packing.KEPT_WORDS and b"0" in ids.known


def test_forgotten_words_get_the_same_ids(monkeypatch):
    from ledgerloom.llm.queries import tokenizer_path

    texts = [f"the word{k} of thing{k % 7}, and more{k}. Again".encode() for k in range(60)]
    whole = packing.WordIds(tokenizer_path()).encode(texts)
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    monkeypatch.setattr(packing, "KEPT_WORDS", 5)
    small = packing.WordIds(tokenizer_path())
    assert [small.encode([t])[0] for t in texts] == whole
    assert len(small.known) <= 50
