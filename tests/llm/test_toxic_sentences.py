"""Every sentence that carries a document's score is located."""

import numpy as np

from tessera.llm import hashed_text, toxicity


def test_all_offending_sentences_are_located(spark):
    buf = np.frombuffer(b"vile", np.uint8)
    weights = np.zeros(hashed_text.DIMS, np.float32)
    weights[toxicity.sentences(buf, np.array([0, 4]))[4]] = 6.0
    model = toxicity.Bags(weights, -3.0)
    text = "Où est-il? This is vile. A calm one. " + "So vile! " * 50 + "Vile vile"
    rows = [(1, text), (2, "calm. " * 40), (3, ""), (4, None), (5, " . \n"), (6, "é vile")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()}
    parts = [text[s.start : s.end].strip() for s in got[1].sentences]
    assert parts == ["This is vile"] + ["So vile"] * 50 + ["Vile vile"] and got[1].n_offending == 52
    assert all(s.score >= 0.5 for s in got[1].sentences)
    for r in got.values():
        worst = [(s.start, s.end, s.score) for s in r.sentences if (s.start, s.end) == (r.worst_start, r.worst_end)]
        assert worst == ([] if r.worst_start is None else [(r.worst_start, r.worst_end, r.worst_score)])
    # many weak sentences: the document is over 0.5, no sentence is, and the worst is there
    assert got[2].score > 0.5 and got[2].n_offending == 0 and len(got[2].sentences) == 1
    assert [got[i].sentences for i in (3, 4, 5)] == [[], [], []] and len(got[6].sentences) == 1
