"""What a Python worker holds at a time, and what it keeps."""

import pyarrow as pa

from gridcanopy.llm import common, decontaminate, tokens


def test_workers_take_texts_by_slices(monkeypatch):
    """A batch is taken in slices of few bytes, each row once; a scan holds the characters of few texts at a time."""
    texts = ["ä" * 10, None, "", "b" * 100, *["c" * 7] * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = list(common.slices(batch.slice(1), 1, 40))
    assert [i for s in got for i in s.column(0).to_pylist()] == list(range(1, len(texts)))
    assert all(sum(len(t or "") for t in s.column(1).to_pylist()) <= 40 or s.num_rows == 1 for s in got) and len(got) < 12
    assert not list(common.slices(batch.slice(0, 0), 1))

    item = "seven green boats went north at dawn"
    index = decontaminate.ItemIndex([(1, item)])
    texts = [None, item, "x" * 90, f"and {item}, they say", "", item]
    want, most, step = index.scan(texts), [], decontaminate.ItemIndex._scan
    assert [len(places) for places in want] == [0, 1, 0, 1, 0, 1]
    monkeypatch.setattr(decontaminate, "STEP_CHARS", 50)
    monkeypatch.setattr(decontaminate.ItemIndex, "_scan", lambda self, own: most.append(sum(len(t or "") for t in own)) or step(self, own))
    assert index.scan(texts) == want and max(most) <= 50 + 90 and len(most) > 2


def test_packing_leaves_no_words_in_a_worker():
    tokens.word_encoder().encode(["some words to learn"])
    tokens.forget_words()
    assert not tokens._encoders
