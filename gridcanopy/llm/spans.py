"""SentencePiece encoding that knows which bytes of the text every piece stands for.

The text is normalised here, by longest prefixes of the model's compiled character map, noting for each
normalised byte the source byte it comes from; the library's own model, with its normaliser taken out,
cuts the normalised text, and each piece is projected back to source bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_SPACE = SPACE.encode()
#: Normalised bytes that are cut at a time where the vocabulary has no piece across the end of a word.
SEGMENT = 1 << 20
#: Characters of texts that are encoded together.
GROUP_CHARS = 1 << 21

_pieces: dict[str, Pieces] = {}


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _put(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """``(number, value, begin, end)`` of the fields of a protocol buffer message."""
    at = 0
    while at < len(raw):
        begin = at
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value, begin, at


def character_map(blob: bytes) -> dict[str, str]:
    """The entries of a compiled character map: a double array of prefixes, then their replacements.

    The array is walked from its root; a unit holds the byte that leads to it, the offset of its
    children, and whether an entry ends there.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    labels = np.arange(1, 256)
    out: dict[str, str] = {}
    todo = [(0, b"")]
    while todo:
        node, prefix = todo.pop()
        unit = int(units[node])
        base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
        if unit >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            out[prefix.decode()] = texts[start : texts.index(0, start)].decode()
        at = base ^ labels
        inside = at < len(units)
        found = labels[inside][(units[at[inside]] & 0x800000FF) == labels[inside]]
        todo += [(base ^ int(c), prefix + bytes([int(c)])) for c in found]
    return out


class Normaliser:
    """The model's normalisation of a whole text, with the source of every normalised byte.

    A symbol of the user's that stands at a place is kept, else the longest prefix in the character map is
    replaced, else a character stays.  Then spaces are made visible; a space may be put before the text, and
    repeated ones and those at the ends may go, as the model says.
    """

    def __init__(self, entries: dict[str, str], symbols: list[str] = (), dummy_prefix: bool = True, fewer_spaces: bool = True, visible: bool = True):
        self.dummy_prefix, self.fewer_spaces, self.space = dummy_prefix, fewer_spaces, _SPACE if visible else b" "
        self.tables = [{s: s for s in symbols}, dict(entries)]
        self.sizes = [{k: sorted({len(x) for x in t if x[0] == k}, reverse=True) for k in {x[0] for x in t}} for t in self.tables]
        firsts = sorted({c for sizes in self.sizes for c in sizes})
        self.first = re.compile("[" + "".join(map(re.escape, firsts)) + "]") if firsts else None

    def _longest(self, text: str, at: int) -> tuple[int, str] | None:
        for table, sizes in zip(self.tables, self.sizes):
            for n in sizes.get(text[at], ()):
                if (found := table.get(text[at : at + n])) is not None and at + n <= len(text):
                    return n, found
        return None

    def _chunks(self, text: str) -> Iterator[tuple[str, bytes]]:
        """``(source, result)`` of runs that stay as they are and of replaced prefixes."""
        at = done = 0
        while self.first and (m := self.first.search(text, at)):
            at = m.start()
            if found := self._longest(text, at):
                if done < at:
                    yield text[done:at], text[done:at].encode()
                yield text[at : at + found[0]], found[1].encode()
                at = done = at + found[0]
            else:
                at += 1
        if done < len(text):
            yield text[done:], text[done:].encode()

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each and for their end the place of the source in UTF-8."""
        chunks = [(text, text.encode())] if self.first is None and text else list(self._chunks(text))
        if self.fewer_spaces:
            return self._single_spaces(chunks)
        out, source, begin = [], [], 0
        for s, result in chunks:
            size, raw = len(result), s.encode()
            out.append(result)
            if result == raw:  # every byte comes from the character that it is in
                byte = np.frombuffer(raw, np.uint8)
                starts = np.where((byte & 0xC0) != 0x80, np.arange(size), 0)
                source.append(begin + np.maximum.accumulate(starts))
            else:
                source.append(np.full(size, begin))
            begin += len(raw)
        source = np.concatenate([np.zeros(0, np.int64), *source, [begin]])
        return self._show(b"".join(out), source, 0) if text else (b"", source)

    def _single_spaces(self, chunks: list[tuple[str, bytes]]) -> tuple[bytes, np.ndarray]:
        """As above without spaces that follow a space, or are first or last; one character or prefix at a time."""
        each = [c for s, r in chunks for c in (((x, x.encode()) for x in s) if s.encode() == r else ((s, r),))]
        begin = 0
        for head, (s, result) in enumerate(each):
            if result != b" ":
                break
            begin += len(s.encode())
        else:
            return b"", np.array([begin])
        lead, after_space, out, source = begin, True, [], []
        for s, result in each[head:]:
            result = result.lstrip(b" ") if after_space else result
            if result:
                out.append(result)
                source += [begin] * len(result)
                after_space = result.endswith(b" ")
            begin += len(s.encode())
        raw, source = self._show(b"".join(out), np.array([*source, begin], np.int64), lead)
        while raw.endswith(self.space):
            raw = raw[: -len(self.space)]
        return raw, source[: len(raw) + 1]

    def _show(self, raw: bytes, source: np.ndarray, lead: int) -> tuple[bytes, np.ndarray]:
        """Spaces made visible, and one from ``lead`` put before the text."""
        wide = np.where(np.frombuffer(raw, np.uint8) == 32, len(self.space), 1)
        source = np.append(np.repeat(source[:-1], wide), source[-1])
        raw = raw.replace(b" ", self.space)
        if self.dummy_prefix:
            raw, source = self.space + raw, np.concatenate([np.full(len(self.space), lead), source])
        return raw, source


class Pieces:
    """A model file's pieces: encode with source spans, and decode."""

    def __init__(self, path: str):
        import sentencepiece

        raw = open(path, "rb").read()
        whole = list(fields(raw))
        spec = {n: v for _, body, *_ in (f for f in whole if f[0] == 3) for n, v, *_ in fields(body)}
        kinds = [{n: v for n, v, *_ in fields(body)} for number, body, *_ in whole if number == 1]
        trainer = {n: v for _, body, *_ in (f for f in whole if f[0] == 2) for n, v, *_ in fields(body)}
        if trainer.get(24):
            raise ValueError(f"{path} puts spaces behind words, which this encoder does not")
        symbols = [k[1].decode() for k in kinds if k.get(3, 1) == 4]
        self.normalise = Normaliser(character_map(spec.get(2, b"")), symbols, bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # fixed: a normaliser that changes nothing
        rest = b"".join(raw[begin:end] for number, _, begin, end in whole if number not in (3, 4))
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cut = sentencepiece.SentencePieceProcessor(model_proto=rest + b"\x1a" + _put(len(plain)) + plain)
        n = self.own.get_piece_size()
        names = [self.own.id_to_piece(k) for k in range(n)]
        self.size = np.array([1 if self.own.is_byte(k) else len(p.encode()) for k, p in enumerate(names)], np.int64)
        self.unknown = self.own.unk_id()
        self.digits = np.array([str(k) for k in range(n)], object)
        #: No piece goes on from a word into the next space, so words can be encoded apart.
        self.apart = all(SPACE not in p.lstrip(SPACE) for p in names)

    def _segments(self, raw: bytes) -> list[bytes]:
        """The normalised text in parts of ``SEGMENT`` bytes or more that end before the space of a word."""
        out, done = [], 0
        while self.apart and len(raw) - done > SEGMENT:
            at = raw.find(_SPACE, done + SEGMENT)
            while at > 0 and raw[at - 3 : at] == _SPACE:  # within a run of spaces
                at = raw.find(_SPACE, at + 3)
            if at < 0:
                break
            out.append(raw[done:at])
            done = at
        return [*out, raw[done:]]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(ids, starts, ends)`` of each text; spans are bytes of its UTF-8, ends exclusive."""
        normal = [self.normalise(t or "") for t in texts]
        cut = [self._segments(raw) for raw, _ in normal]
        flat = [s.decode() for segments in cut for s in segments]
        found = self.cut.encode_as_numpy(flat, num_threads=1)
        out, at = [], 0
        for (raw, source), segments in zip(normal, cut):
            parts = found[at : at + len(segments)]
            ids = np.concatenate([np.asarray(p, np.int64) for p in parts])
            sizes = self.size[ids]
            if (ids == self.unknown).any():  # an unknown piece is as long as what it stands for
                pieces = [p for s in flat[at : at + len(segments)] for p in self.cut.encode(s, out_type=str)]
                sizes = np.array([len(p.encode()) if k == self.unknown else n for p, k, n in zip(pieces, ids, sizes)], np.int64)
            ends = np.cumsum(sizes)
            if len(ids) and ends[-1] != len(raw):
                raise RuntimeError("pieces do not cover the normalised text")
            out.append((ids, source[ends - sizes], source[ends]))
            at += len(segments)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.own.decode([i.tolist() for i in ids], num_threads=1) if ids else []


def pieces(path: str | None = None) -> Pieces:
    """The worker's pieces of a model file; they outlive the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``GROUP_CHARS`` characters."""
    begin = 0
    for k, total in enumerate(accumulate(len(t or "") for t in texts)):
        if total // GROUP_CHARS > (total - len(texts[k] or "")) // GROUP_CHARS:
            yield begin, k + 1
            begin = k + 1
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(id, ids, starts, ends, decoded)`` of every row's whole text: piece ids as the library gives them, the
    source bytes of each (``ends`` exclusive), and the text that the ids decode to.

    A piece made of a part of a character has an empty span but for its last part, which has the character's;
    a space that the model puts before the text has an empty span at its start.  Null and empty texts have no
    pieces and decode to the empty text.  Every row, repeated or without id, gives one row; other columns,
    whatever their names, are not read.  Very long texts are cut in segments between words.
    """

    def rows(p: Pieces, ids: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        found = p.encode(texts)
        lists = [pa.array([f[k] for f in found], pa.list_(pa.int32() if k == 0 else pa.int64())) for k in range(3)]
        yield pa.RecordBatch.from_arrays([ids, *lists, pa.array(p.decode([f[0] for f in found]), pa.string())], names=["id", "ids", "starts", "ends", "decoded"])

    return _scan(docs, id_col, text_col, model, rows, "ids array<int>, starts array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256)``: digests of what :func:`encode` returns.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded text in UTF-8,
    ``spans_sha256`` of start and end of each piece as little-endian 64-bit integers.  Rows as there.
    """

    def sha(raw: bytes) -> str:
        return hashlib.sha256(raw).hexdigest()

    def rows(p: Pieces, ids: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        found = p.encode(texts)
        n = pa.array([len(f[0]) for f in found], pa.int64())
        of_ids = [sha(",".join(p.digits[f[0]]).encode()) for f in found]
        of_text = [sha(t.encode()) for t in p.decode([f[0] for f in found])]
        of_spans = [sha(np.stack(f[1:], 1).astype("<i8").tobytes()) for f in found]
        yield pa.RecordBatch.from_arrays([ids, n, pa.array(of_ids), pa.array(of_text), pa.array(of_spans)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return _scan(docs, id_col, text_col, model, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def _scan(docs: DataFrame, id_col: str, text_col: str, model: str | None, rows, columns: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for begin, end in _groups(texts):
                yield from rows(p, b.column(0).slice(begin, end - begin), texts[begin:end])

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, {columns}")
