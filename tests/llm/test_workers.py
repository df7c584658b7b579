"""What the pipeline's Python functions leave in a worker: freed memory must not stay with an idle one."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from trailmark.llm import decontamination, ngram_join, packing, quality, workers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
STAGES = {
    "quality": lambda docs: quality.score_quality(docs, quality.ByteConv()),
    "signatures": lambda docs: ngram_join.signatures(docs.selectExpr("doc_id as id", "doc_id", "text")),
    "decontamination": lambda docs: decontamination.decontaminate(docs, docs.selectExpr("doc_id as item_id", "text")),
    "packing": lambda docs: packing.document_pieces(docs, TOKENIZER),
}


def held_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def long_batches(names, n=3):
    """Of 12 MB each; a batch's texts are made when it is asked for."""
    words = np.array(["".join(random.Random(k).choices("abcdefghij", k=6)) for k in range(20_000)])
    for k in range(n):
        pick = np.random.default_rng(k).integers(0, len(words), (6000, 290))
        ids = pa.array(np.arange(6000))
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(words[p]) for p in pick]) if c == "text" else ids for c in names], names=names)


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read")
@pytest.mark.parametrize("stage", STAGES)
def test_a_task_leaves_no_freed_memory_behind(spark, monkeypatch, stage):
    docs, found = spark.createDataFrame([(1, "a benchmark item of more than forty characters, found nowhere")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: found.append((f, self.columns)) or self)
    STAGES[stage](docs)
    f, names = found[0]
    workers.give_back()
    for b in f(long_batches(names)):
        assert b.num_rows
        del b  # the taker keeps none
    left = held_mb()
    workers.give_back()
    assert left - held_mb() < 5


def test_a_task_gives_what_its_function_gives():
    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    run = workers.gives_back(lambda rows: (b.slice(0, 1) for b in rows))
    assert [b.column(0)[0].as_py() for b in run(iter(batches))] == [0, 1, 2]
    assert list(run(iter([]))) == []
