"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its few fields that matter are read from the wire format, and the same tokenizer is rebuilt
from tokenizers parts: the normaliser (character map, white space rules), the metaspace marker, the pieces with their
scores, and byte fallback. Unigram models use the scores as they are; for BPE models the merges follow from the pieces
and their scores. Batches are encoded and decoded on several threads.

If no piece holds the marker behind another character, no piece ever reaches from a character to a following marker, so
the text may be split there without changing any id; each distinct chunk is then encoded once and remembered.

Parity with the sentencepiece library is verified for every text. Where the model's normaliser only adds and replaces markers, the library,
too, works chunk by chunk, so each distinct chunk is compared once, with its ids, and remembered; a text is equal if its chunks are.
Texts of other models, and texts with a chunk that differs, are compared whole.

The model is read on the driver from `path` and travels to the tasks as bytes (a vocabulary: bounded by its file).
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import packed

MARK = "▁"
#: Rows that the tokenizers library encodes at once, and the bytes of text at which a batch is cut.
BATCH_ROWS = 256
BATCH_BYTES = 2 << 20
#: Threads of an encoding batch; a Spark task has one core, so a cluster raises this together with spark.task.cpus.
THREADS = 2

#: Distinct chunks that a worker remembers.
MEMORY = 1 << 18
#: Markers and the characters behind them.
CHUNK = f"{MARK}*[^{MARK}]+|{MARK}+"
_CHUNK = re.compile(CHUNK)

#: The model that is used where no path is given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Fixed values of the model format: piece kinds and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if not data[at - 1] & 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
            yield key >> 3, value
            continue
        size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                m.pieces.append((part.get(1, b"").decode(), score, part.get(3, NORMAL)))
            elif number == 2:
                part = dict(_fields(value))
                m.kind, m.byte_fallback = part.get(3, UNIGRAM), bool(part.get(35, 0))
                m.treat_whitespace_as_suffix = bool(part.get(24, 0))
            elif number == 3:
                part = dict(_fields(value))
                m.charsmap = part.get(2, b"")
                m.add_dummy_prefix, m.remove_extra_whitespaces = bool(part.get(3, 1)), bool(part.get(4, 1))
                m.escape_whitespaces = bool(part.get(5, 1))
        return m

    def splits(self) -> bool:
        """Whether no piece reaches from a character to a marker behind it, so that texts may be split there."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which they are merged: the best score of the merged piece first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
                found += sorted((-score, ids[a], ids[b], a, b) for a, b in pairs if a in ids and b in ids)
        return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[0])]


def build(model: Model):
    """The tokenizers.Tokenizer that gives the model's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.treat_whitespace_as_suffix or not model.escape_whitespaces:
        raise ValueError("models that mark white space behind words, or not at all, are not supported")
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} has no counterpart here")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    if model.splits():
        out.pre_tokenizer = pre_tokenizers.Split(Regex(CHUNK), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class Codec:
    """encode and decode for batches of texts.

    Where the text may be split at markers, each distinct chunk goes through the tokenizer once, all new ones of a batch in
    one multithreaded call, and is remembered as a place in a pool of ids (MEMORY chunks at most, then it starts anew).
    """

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        from tokenizers import Regex, Tokenizer, decoders, pre_tokenizers

        import sentencepiece

        self.model, self.reference = Model.parse(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokenizer = build(self.model)
        self.chunker = Tokenizer(self.tokenizer.model)
        self.chunker.pre_tokenizer = pre_tokenizers.Split(Regex(CHUNK), "isolated")
        self.chunker.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.odd = np.array([kind not in (NORMAL, USER_DEFINED, BYTE) for *_, kind in self.model.pieces])
        self.bytes, self.byte_length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw], np.int64)
        self.byte_begin = np.cumsum(self.byte_length) - self.byte_length
        self.splits = self.model.splits()
        self.plain = not self.model.charsmap and not self.model.remove_extra_whitespaces
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.pool, self.begin, self.length, self.same, self.equal = ([np.zeros(0, t)] for t in (np.int32, np.int64, np.int64, bool, bool))
        self.pooled = 0

    def normalise(self, text: str) -> str:
        if not self.plain:
            return self.tokenizer.normalizer.normalize_str(text)
        return (MARK * self.model.add_dummy_prefix + text.replace(" ", MARK)) if text else ""

    def learn(self, new: list[str]) -> None:
        """Encode and decode chunks, and remember them."""
        # Chunks with one marker are joined by the hundred: their first pieces, and no others, open with the marker.
        joined = [c for c in new if c[0] == MARK and c[1:2] != MARK]
        groups = [joined[i : i + 512] for i in range(0, len(joined), 512)]
        groups += [[c] for c in new if c[0] != MARK or c[1:2] == MARK]
        while groups:
            texts = ["".join(g) for g in groups]
            ids = [e.ids for e in self.chunker.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.chunker.decode_batch(ids, skip_special_tokens=False)
            again: list[list[str]] = []
            for g, t, i, d in zip(groups, texts, ids, back, strict=True):
                array, same = np.array(i, np.int32), d == t.replace(MARK, " ")
                equal = self.plain and self.model.add_dummy_prefix and t[0] == MARK and self.reference.encode(t[1:].replace(MARK, " ")) == i
                starts = np.nonzero(self.opens[array])[0] if len(g) > 1 else np.zeros(1, np.int64)
                if len(g) > 1 and (not same or not equal or len(starts) != len(g)):
                    again += [[c] for c in g]
                    continue
                at = len(self.places)
                self.places.update(zip(g, range(at, at + len(g)), strict=True))
                self.pool.append(array)
                self.begin.append(starts + self.pooled)
                self.length.append(np.diff(np.append(starts, len(array))))
                self.same.append(np.full(len(g), same))
                self.equal.append(np.full(len(g), equal))
                self.pooled += len(array)
            groups = again
        self.pool, self.begin, self.length, self.same, self.equal = ([np.concatenate(x)] for x in (self.pool, self.begin, self.length, self.same, self.equal))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text."""
        return [ids.tolist() for ids, *_ in self.round_trip(texts)]

    def round_trip(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """Every text's ids, whether they decode to the normalised text, and whether the sentencepiece library gives the same ids."""
        if not self.splits:
            all_ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            wanted = [self.normalise(t).replace(MARK, " ").removeprefix(" " * self.model.add_dummy_prefix) for t in texts]
            back = self.decode(all_ids)
            return [(np.array(i, np.int32), d == w, self.reference.encode(t) == i) for i, d, w, t in zip(all_ids, back, wanted, texts, strict=True)]
        chunks = [_CHUNK.findall(self.normalise(t)) for t in texts]
        if len(self.places) > MEMORY:
            self.forget()
        known = self.places.keys()
        if new := [c for c in set().union(*chunks) if c not in known]:
            self.learn(new)
        pool, begin, length, same, equal = self.pool[0], self.begin[0], self.length[0], self.same[0], self.equal[0]
        out = []
        for t, x in zip(texts, chunks, strict=True):
            at = np.fromiter(map(self.places.__getitem__, x), np.int64, len(x))
            n = length[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(x) else 0
            ids = pool[np.arange(total) + np.repeat(begin[at] - ends + n, n)]
            out.append((ids, bool(same[at].all()), bool(equal[at].all()) or self.reference.encode(t) == ids.tolist()))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def decode_arrays(self, all_ids: list[np.ndarray]) -> list[str]:
        """decode(), by gathering the pieces' bytes; lists with unknown, control or no pieces, or whose bytes are no UTF-8, go to the library."""
        out: list[str] = []
        for ids in all_ids:
            text = None
            if len(ids) and ids.min() >= 0 and ids.max() < len(self.odd) and not self.odd[ids].any():
                n = self.byte_length[ids]
                ends = np.cumsum(n)
                raw = self.bytes[np.arange(ends[-1]) + np.repeat(self.byte_begin[ids] - ends + n, n)].tobytes()
                with contextlib.suppress(UnicodeDecodeError):
                    text = raw.decode()
                    text = text.removeprefix(" ") if self.model.add_dummy_prefix else text
            out.append(self.decode([ids.tolist()])[0] if text is None else text)
        return out


_codecs: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    """One codec for a model in each Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """[start, end) of batches of at most BATCH_ROWS texts and about BATCH_BYTES bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (i - start >= BATCH_ROWS or total + size > BATCH_BYTES):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, model_path: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default; struct `_row`) with `_ids` (token ids), `_exact` (whether the ids decode to the
    normalised text) and `_parity` (whether the sentencepiece library gives the same ids).

    A null text has null ids, `_exact` and `_parity`; an empty text has no ids. Texts of any length are encoded whole. Of merges that tie
    the leftmost comes first, as in the sentencepiece library. Repeated rows are encoded alike. Other columns keep their values,
    whatever their names. No rows in: no rows out.
    """
    with open(model_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    bare, own, row = packed(docs, keep)
    source = bare.select(F.col(own["text"]).cast("string").alias("_text"), row.alias("_row"))
    none = F.lit(None)
    schema = source.select(
        "_row", none.cast("array<int>").alias("_ids"), none.cast("boolean").alias("_exact"), none.cast("boolean").alias("_parity")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(data.value)
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                part = batch.slice(a, b - a)
                texts = part.column(0).to_pylist()
                found = tool.round_trip([t or "" for t in texts])
                ends = np.cumsum([0, *(len(ids) for ids, *_ in found)])
                flat = np.concatenate([ids for ids, *_ in found]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))
                exact, parity = ([None if t is None else f[k] for t, f in zip(texts, found, strict=True)] for k in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), lists, pa.array(exact, pa.bool_()), pa.array(parity, pa.bool_())], names=["_row", "_ids", "_exact", "_parity"]
                )

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids: str = "ids", model_path: str = MODEL) -> DataFrame:
    """tokens' rows (struct `_row`) with `_text`, the text of the ids.

    Null ids give a null text, null members are left out. Lists of any length are decoded whole. Other columns keep their values,
    whatever their names. No rows in: no rows out.
    """
    with open(model_path, "rb") as f:
        data = tokens.sparkSession.sparkContext.broadcast(f.read())
    bare, own, row = packed(tokens)
    source = bare.select(F.col(own[ids]).cast("array<int>").alias("_ids"), row.alias("_row"))
    schema = source.select("_row", F.lit(None).cast("string").alias("_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(data.value)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                lists = [None if x.values is None else x.values.drop_null().to_numpy() for x in part.column(0)]
                found = iter(tool.decode_arrays([x for x in lists if x is not None]))
                texts = [None if x is None else next(found) for x in lists]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.string())], names=["_row", "_text"])

    return source.mapInArrow(run, schema)
