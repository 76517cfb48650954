"""Every stage of the pipeline against brute force on its own input."""

import gc
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import quality_model, secrets
from tessera.llm.scratch import drop_unheld, stash
from tests.conftest import SF
from tests.llm.test_operators import BPE, groups, left, marked


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, which hold no secret of their own, with a key in every twentieth text and two rows without text."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = F.concat(F.lit("\nuse AKIA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 20 == 7, F.concat("text", key)).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    none = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "", "en", "s", 0)], docs.schema)
    docs.union(none).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, monkeypatch, sf_dir):
    inputs = []

    def noted(stage):
        def run(spark, docs, sf_dir):
            inputs.append(docs)
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted(f)) for n, f in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(inputs) == 5 and all(d.columns == inputs[0].columns for d in inputs)
    raw, good, single, cut, masked = ({r.doc_id: r for r in d.collect()} for d in inputs)

    # quality: the model's verdict decides, labelled good documents stay and rows are not altered
    model = quality_model.train(inputs[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(good) == {r.doc_id for r in quality_model.score(inputs[0], model).where("kept").collect()}
    assert all(good[i] == raw[i] for i in good) and 0 < len(good) < len(raw)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in raw}
    assert sum((i in good) == (q == 1) for i, q in label.items()) > 0.9 * len(label)

    # near copies: five-word shingles at 0.8; the smallest id of each group stays
    texts = [(i, r.text) for i, r in good.items()]
    assert set(single) == {top for _, top in groups(texts, 5, 80).values()}
    assert all(single[i] == good[i] for i in single) and len(single) < len(good)

    # repeats: what a 100-byte string repeats goes, and so do emptied documents
    want = {}
    for i, (b, gone) in marked((i, r.text) for i, r in single.items()).items():
        kept = left(b, gone).decode("utf-8", "ignore") if any(gone) else single[i].text
        if kept or not any(gone):
            want[i] = kept
    assert {i: r.text for i, r in cut.items()} == want and any(want[i] != single[i].text for i in want)
    assert all(cut[i].n_chars == len(want[i]) for i in want if want[i] != single[i].text)

    # secrets: all documents stay, and no pattern is left in them
    assert set(masked) == set(cut)
    assert any(masked[i].text != cut[i].text for i in cut)
    for r in masked.values():
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text or "")
    for i, r in cut.items():
        if "[SECRET]" not in (masked[i].text or ""):
            assert masked[i].text == r.text and not re.search(secrets.ASSIGN.replace("]+)", "]{6,})"), r.text or "")

    # packing: every token once, sequences gapless and at most 2048 long
    tokenizer, places, lengths = Tokenizer.from_file(BPE), {}, {}
    for r in last:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        lengths.setdefault(r.doc_id, []).append((r.start, r.length))
    total = 0
    for i, r in masked.items():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        starts = np.cumsum([0, *(length for _, length in sorted(lengths[i]))])
        assert starts[-1] == n and [s for s, _ in sorted(lengths[i])] == starts[:-1].tolist()
        total += n
    assert set(lengths) == set(masked)
    for spans in places.values():
        ends = np.cumsum([0, *(length for _, length in sorted(spans))])
        assert [o for o, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(places) <= 1.05 * -(-total // 2048) + 1


def test_stage_tables_stay_while_held(spark):
    """A table goes with its data frame, and not before."""
    rows = stash(spark.range(5), "held")
    folder = rows.stashed.removeprefix("file:").replace("//", "/")
    drop_unheld(rows)
    assert os.path.isdir(folder) and rows.count() == 5
    del rows
    gc.collect()
    assert not os.path.exists(folder)
