"""SentencePiece encoding and decoding with forward scores shared by common prefixes.

Texts are cut into marked words: runs of the blank mark with the characters up to the next run. Each batch's distinct
marked words are sorted, which lays them out as a trie in depth-first order; a word's forward table starts from the
entries of the prefix that it shares with the word before, and only the rest is computed.

Unigram models: the table's entry for a prefix is its best score and the length of its last piece (Viterbi).
BPE models: the entry is the last piece of the prefix's own encoding. A piece may follow another in an encoding just
when the two, joined and encoded again, come apart in the same place, so the entry for a prefix is the one piece that
may follow the entry before it. The result equals merging pairs by piece score, leftmost first, on the whole word.

Models are read from the standard protobuf file; nothing is trained.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import besides, documents

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: Encoded words that a task remembers between batches.
REMEMBERED = 400_000
_NONE: dict[str, bool] = {}
_NO = object()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed 32-bit values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    charsmap: bytes = b""

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: _NORMAL} | dict(_fields(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(struct.unpack("<f", piece[2])[0])
                m.kinds.append(piece[3])
            elif number == 2:
                spec = dict(_fields(value))
                m.algorithm, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                m.charsmap = spec.get(2, b"")
        if m.charsmap or not m.escape or m.algorithm not in (UNIGRAM, BPE):
            raise ValueError("only identity normalisation with escaped blanks, and unigram or BPE models, are supported")
        if _USER in m.kinds:
            raise ValueError("user-defined pieces are not supported")
        if any(MARK in p.lstrip(MARK) for p in m.pieces):
            raise ValueError("a piece has a blank after other characters, so words can't be encoded apart")
        return m

    def __post_init__(self):
        self.ids: dict[str, int] = {}


class Encoder:
    """Words to piece ids. One table of forward entries is kept for the word encoded last."""

    def __init__(self, model: Model):
        self.m = model
        usable = (_NORMAL, _UNUSED) if model.algorithm == BPE else (_NORMAL,)
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in usable}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == _BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == _UNKNOWN), 0)
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == _UNKNOWN), 0)
        self.unknown_score = min((model.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        # Every ending of a piece; the value says whether it is a piece itself (for BPE: one that is its own encoding, None: not yet known).
        self.endings: dict[str, bool | None] = {p[i:]: False for p in self.ids for i in range(1, len(p))}
        self.endings.update(dict.fromkeys(self.ids, None if model.algorithm == BPE else True))
        self.follows: dict[str, dict[str, bool]] = {}
        self.n_follows = 0
        self.last: list[str] = [""]
        self.best: list[float] = [0.0]
        self.word = ""
        #: Characters that stand in a piece with others.
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: join the adjacent pair whose piece scores best, leftmost first."""
        parts, score = list(text), self.m.scores
        while len(parts) > 1:
            found = [(-score[self.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, a: str, b: str) -> bool:
        if self.n_follows > 1_000_000:
            self.follows.clear()
            self.n_follows = 0
        self.n_follows += 1
        known = self.follows.setdefault(a, {})[b] = self.merged(a + b) == [a, b]
        return known

    def _pieces_ending(self, word: str, i: int) -> list[str]:
        """Pieces that end at ``i``, short ones first; a character counts as a piece."""
        found, endings = [word[i - 1 : i]], self.endings
        for j in range(i - 2, -1, -1) if found[0] in endings else ():
            piece = word[j:i]
            known = endings.get(piece, _NO)
            if known is _NO:
                break
            if known is None:
                known = endings[piece] = self.merged(piece) == [piece]
            if known:
                found.append(piece)
        return found

    def _extend_bpe(self, word: str, i: int) -> None:
        last, follows = self.last, self.follows
        for piece in reversed(self._pieces_ending(word, i)):
            at = i - len(piece)
            if at:
                known = follows.get(last[at], _NONE).get(piece)
                if known is None:
                    known = self._may_follow(last[at], piece)
                if not known:
                    continue
            last.append(piece)
            return
        raise AssertionError(f"no piece ends at {i} of {word!r}")

    def _extend_unigram(self, word: str, i: int) -> None:
        best, last = None, ""
        for piece in reversed(self._pieces_ending(word, i)):
            number = self.ids.get(piece)
            score = self.best[i - len(piece)] + (self.unknown_score if number is None else self.m.scores[number])
            if best is None or score > best:
                best, last = score, piece
        self.best.append(best)
        self.last.append(last)

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word; the words are sorted, so common prefixes stand next to each other."""
        extend = self._extend_bpe if self.m.algorithm == BPE else self._extend_unigram
        for word in words:
            shared, most = 0, min(len(word), len(self.word))
            while shared < most and word[shared] == self.word[shared]:
                shared += 1
            del self.last[shared + 1 :], self.best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                extend(word, i)
            self.word = word
            pieces, at = [], len(word)
            while at:
                pieces.append(self.last[at])
                at -= len(self.last[at])
            yield self._ids(pieces[::-1])

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            number = self.ids.get(piece)
            if number is not None and self.m.kinds[number] == _NORMAL:
                out.append(number)
            elif self.m.byte_fallback:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # unknown characters in a row are one piece
        return out


class Tokenizer:
    def __init__(self, model: Model):
        self.m, self.encoder = model, Encoder(model)
        apart = "" if "\n" in self.encoder.joined else "\n"
        self.cut = re.compile(f"{apart}|{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" if apart else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        if self.m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.m.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        split = [self.cut.findall(self.normal(t)) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = sorted({w for words in split for w in words if w not in known})
        for word, ids in zip(new, self.encoder.encode_sorted(new), strict=True):
            known[word] = struct.pack(f"={len(ids)}i", *ids)
        each = [b"".join([known[w] for w in words]) for words in split]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)))
        return np.frombuffer(b"".join(each), np.int32), offsets

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are joined to characters, the mark in front is dropped."""
        out, held = [], bytearray()

        def flush() -> None:
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()

        for i in ids:
            kind, piece = self.m.kinds[i], self.m.pieces[i]
            if kind == _BYTE:
                held.append(int(piece[1:-1], 16))
                continue
            flush()
            if kind == _UNKNOWN:
                out.append(" ⁇ ")
            elif kind != _CONTROL:
                out.append(piece)
        flush()
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.m.dummy_prefix and text.startswith(" ") else text


def _tokenizer(model: bytes, cache: dict = {}) -> Tokenizer:  # noqa: B006  one per Python worker
    if model not in cache:
        cache.clear()
        cache[model] = Tokenizer(Model.parse(model))
    return cache[model]


def encode(df: DataFrame, text_col: str, keep: list[str], model: bytes) -> DataFrame:
    """Columns ``keep`` with ids (array of int) and n_ids. Null and empty texts give no ids; rows map one to one, repeated ones too.

    An empty input gives no rows. A text of any length is one row of a batch whose bytes Spark bounds. Columns of ``keep`` named like an
    output are left out.
    """
    keep = besides(keep, "ids", "n_ids", "__text")
    shared = df.sparkSession.sparkContext.broadcast(model)
    chosen = df.select(*keep, df[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                ids, offsets = tokenizer.encode_batch([x.as_py() or "" for x in batch["__text"]])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = {c: batch[c] for c in batch.schema.names if c != "__text"}
                yield pa.RecordBatch.from_pydict(columns | {"ids": lists, "n_ids": pa.array(np.diff(offsets), pa.int64())})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    return chosen.mapInArrow(run, f"{kept}, ids array<int>, n_ids long")


def decode(df: DataFrame, ids_col: str, keep: list[str], model: bytes) -> DataFrame:
    """Columns ``keep`` with text. Null ids give a null text, no ids an empty one; an empty input gives no rows. A kept column text is left out."""
    keep = besides(keep, "text", "__ids")
    shared = df.sparkSession.sparkContext.broadcast(model)
    chosen = df.select(*keep, df[ids_col].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            texts = [None if x is None else tokenizer.decode(x) for x in batch["__ids"].to_pylist()]
            columns = {c: batch[c] for c in batch.schema.names if c != "__ids"}
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string())})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__ids")
    return chosen.mapInArrow(run, f"{kept}, text string")


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model's bytes, read by the driver and sent with the job; executors open no file."""
    with open(path, "rb") as f:
        return f.read()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_ids and ids, as SentencePiece encodes the whole text."""
    return encode(documents(spark, sf_dir), "text", ["doc_id"], read_model())
