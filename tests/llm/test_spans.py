"""SentencePiece encoding with spans: against the library, whole and with other normalisers."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from gridcanopy.llm import spans
from gridcanopy.llm.spans import Pieces, character_map, fields

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a  b ", "▁x▁", "ﬁ①  Å", "a\nb\tc", "<s> </s> <unk> <0x41>", "\x00a", "　x", "  🙂 é é", "x" * 3000, "word " * 500, " " * 300, "a " * 5 + "▁ ▁", "日本語 テキスト", "\r\n\r\n",
    "A ﬁne ①② text  with   ﬀ", "ﬃ", "②", "é́ ",
]


def _library(sp, text):
    """The library's spans, from characters to bytes."""
    if not text:
        return [], []
    found = sp.encode_as_offset_mapping(text)
    at = np.cumsum([0, *(len(c.encode()) for c in text)])
    return found["ids"], [(int(at[a]), int(at[b])) for a, b in found["offsets"]]


def _model(tmp_path, entries, prefix=1, fewer=1, visible=1):
    """The model file with another normaliser: its character map is compiled here into a double array."""
    raw = open(PATH, "rb").read()
    blob = _compiled(entries) if entries else b""
    spec = b"\x0a\x01x\x12" + spans._put(len(blob)) + blob + bytes([0x18, prefix, 0x20, fewer, 0x28, visible])
    rest = b"".join(raw[a:b] for n, _, a, b in fields(raw) if n not in (3, 4))
    path = tmp_path / f"{len(entries)}{prefix}{fewer}{visible}.model"
    path.write_bytes(rest + b"\x1a" + spans._put(len(spec)) + spec)
    return str(path)


def _compiled(entries):
    """Size, double array of the keys, and their replacements."""
    tree, texts = {}, b""
    for key, value in entries.items():
        node = tree
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[0] = len(texts)
        texts += value.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(node, at):
        base = next(b for b in range(1, 1 << 20) if at ^ b not in bases and all((at ^ b ^ c) not in used for c in node))
        bases.add(at ^ base)
        units[at] |= base << 10 | (0 in node) << 8
        for c in node:
            used.add(at ^ base ^ c)
            units[at ^ base ^ c] = c if c else 0
        for c, below in node.items():
            if c:
                place(below, at ^ base ^ c)
            else:
                units[at ^ base] = below | 1 << 31

    place(tree, 0)
    n = (max(units) // 256 + 1) * 256
    array = np.zeros(n, "<u4")
    for k, v in units.items():
        array[k] = v
    return (4 * n).to_bytes(4, "little") + array.tobytes() + texts


MAP = {"ﬁ": "fi", "ﬀ": "ff", "①": "1", "②": " 2 ", "é": "é", "é́": "E", "　": " ", "\t": " ", "日本": "Japan", "x": "", "A": "a  b"}


def _random_texts(n=150):
    rng = random.Random(2)
    parts = [" ", "  ", "a", "word", "ﬁ", "①", "②", "e", "́", "　", "日", "日本", "x", "A", "▁", "\n", "🙂", "\t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_whole_documents_as_the_library(spark, sf_dir, text_rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spans.encode(docs).collect()
    assert len(rows) == len(text_rows)
    for r in rows:
        text = text_rows[r["id"]] or ""
        ids, at = _library(sp, text)
        assert r["ids"] == ids and list(zip(r["starts"], r["ends"])) == at and r["decoded"] == sp.decode(ids)
    for r in spans.digests(docs).collect():
        ids = sp.encode(text_rows[r["id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("settings", [({}, 1, 0, 1), (MAP, 1, 1, 1), (MAP, 0, 0, 1), (MAP, 1, 0, 1), ({}, 1, 1, 1), (MAP, 0, 1, 1)])
def test_normalisers(tmp_path, settings):
    """The library with the same model file gives the same pieces and spans."""
    path = _model(tmp_path, *settings)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    texts = TEXTS + _random_texts()
    for text, (ids, starts, ends) in zip(texts, own.encode(texts)):
        assert ids.tolist() == sp.encode(text), (text, settings)
        want = _library(sp, text)
        if len(want[0]):
            assert list(zip(starts.tolist(), ends.tolist())) == want[1], (text, settings)


def test_character_map_round_trip():
    assert character_map(_compiled(MAP)) == MAP and character_map(b"") == {}


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spans, "SEGMENT", 64)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(PATH)
    texts = ["word and  more   " * 200, "x" * 5000, " " * 1000, "a" + " " * 200 + "b " * 100, "▁▁ ▁ a" * 60, "日本 " * 100]
    for text, (ids, starts, ends) in zip(texts, own.encode(texts)):
        assert ids.tolist() == sp.encode(text) and (ends >= starts).all()
    assert len(own._segments(own.normalise(texts[0])[0])) > 10


def test_odd_rows(spark, odd, empty):
    rows = spans.encode(odd).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert any(i == r["id"] and r["ids"] == sp.encode(t or "") for i, t in text)
    assert spans.encode(empty).count() == 0 and spans.digests(empty).count() == 0
    assert sorted(r["n_tokens"] for r in spans.digests(odd).collect()) == sorted(len(r["ids"]) for r in rows)
