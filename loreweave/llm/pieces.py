"""Operator 8, SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here field by field, and its normaliser, metaspace marker, piece scores and byte fallback
are rebuilt as a ``tokenizers`` pipeline: a Unigram model from the scores, or for a BPE model the merges that the
scores order. Batches are encoded and decoded by the library's threads; ``parity`` compares with the sentencepiece
library.

Where no piece of the vocabulary holds the metaspace marker behind another character, neither library can join what
stands on both sides of the start of a run of markers: the ids of a text are those of its words, laid end to end. Words
then go through both libraries once, as long as a bounded store knows them, and a text agrees if all its words do.
A text over a batch's size is cut at blanks, so that memory stays bounded whatever its length. Decoding always sees the
texts themselves.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

MARK = "▁"
#: Fixed values of the published sentencepiece_model.proto: model types, and types of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_marker: bool = False


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; 32- and 64-bit values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire in (1, 2, 5):
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            raise ValueError(f"not a model: wire type {wire}")


def parse(raw: bytes) -> Model:
    """The parts of a model's protobuf that encoding needs."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.model_type = spec.get(3, UNIGRAM)
            model.byte_fallback = bool(spec.get(35, 0))
            model.suffix_marker = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model, best score first: each way to cut a piece into two pieces."""
    usable = {piece for piece, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted(((-score, at, piece) for at, (piece, score, kind) in enumerate(model.pieces) if kind == NORMAL))
    return [
        (piece[:cut], piece[cut:])
        for _, _, piece in ranked
        for cut in range(1, len(piece))
        if piece[:cut] in usable and piece[cut:] in usable
    ]


def splits_at_marks(model: Model) -> bool:
    """Whether no piece can reach over the start of a run of markers."""
    return not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _, _ in model.pieces)


def build(model: Model):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.suffix_marker:
        raise ValueError("models that treat white space as a suffix are not supported")
    unknown = next((at for at, x in enumerate(model.pieces) if x[2] == UNKNOWN), 0)
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.model_type == BPE:
        vocab = {piece: at for at, (piece, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED])
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    # markers become blanks in the joined text: where the marker is a piece, no encoding spells it in bytes
    blanks, join = decoders.Replace(MARK, " "), [decoders.ByteFallback(), decoders.Fuse()]
    whole = any(piece == MARK for piece, _, _ in model.pieces)
    tokenizer.decoder = decoders.Sequence([*join, blanks, *tail] if whole else [blanks, *join, *tail])
    return tokenizer


@lru_cache(maxsize=2)
def _ready(raw: bytes):
    return build(parse(raw))


@lru_cache(maxsize=2)
def _standard(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


@lru_cache(maxsize=2)
def _can_cut(raw: bytes) -> bool:
    model = parse(raw)
    return splits_at_marks(model) and model.dummy_prefix and model.escape and not model.squeeze and not model.charsmap


def cut_text(text: str, chars: int) -> list[str]:
    """The text in parts of ``chars`` characters or a little more, cut at blanks that begin a run; those blanks go.

    Every part gets the dummy prefix of a text of its own, which is the blank that went: ids of the parts, laid end to
    end, are the ids of the text.
    """
    parts, start = [], 0
    while len(text) - start > chars:
        at = text.find(" ", start + chars)
        while at > 0 and text[at - 1] in f" {MARK}":
            at = text.find(" ", at + 1)
        if at < 0 or at == len(text) - 1:  # an empty text would have no prefix
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def _batches(lengths: list[int], chars: int) -> Iterator[slice]:
    start = total = 0
    for at, length in enumerate(lengths):
        if total and total + length > chars:
            yield slice(start, at)
            start, total = at, 0
        total += length + 1
    if start < len(lengths):
        yield slice(start, len(lengths))


def encode_batch(texts: list[str], raw: bytes) -> list[list[int]]:
    """Ids of each text, normalised and encoded by the library's threads."""
    return [x.ids for x in _ready(raw).encode_batch_fast(texts, add_special_tokens=False)]


def decode_ids(ids: list[list[int]], raw: bytes) -> list[str]:
    """Texts of ids, decoded by the library's threads."""
    return _ready(raw).decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def _first_of_word(raw: bytes) -> np.ndarray:
    """By id: whether the piece begins a word."""
    return np.array([piece.startswith(MARK) for piece, _, _ in parse(raw).pieces])


def _worded(text: str) -> bool:
    """Whether single blanks part the text's words, so that they can be told apart by them."""
    return bool(text) and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text


class Words:
    """The ids of words met before, and whether the other library agrees on each.

    Words of over ``longest`` characters are encoded anew each time. The store is emptied when the others would come to
    more than ``most`` words or ``chars`` characters; only the words of one batch may exceed that, until the next one. A
    character gives at most four ids of four bytes, so the defaults come to some 100 MB at worst, whatever the texts.
    """

    def __init__(self, raw: bytes, most: int = 1 << 18, run: int = 2000, chars: int = 1 << 22, longest: int = 64) -> None:
        self.raw, self.most, self.run, self.chars, self.longest = raw, most, run, chars, longest
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.held, self.ids, self.begin, self.agree = 0, np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def by_both(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The words' ids laid end to end, where each word's begin, and the other library's agreement.

        Words go through the libraries in runs parted by blanks. None if a run doesn't give a first piece for each word,
        as then nothing tells the ids of one word from the next one's.
        """
        runs = [words[k : k + self.run] for k in range(0, len(words), self.run)]
        texts = [" ".join(r) for r in runs]
        own, theirs = encode_batch(texts, self.raw), _standard(self.raw).encode(texts, num_threads=1)
        first = _first_of_word(self.raw)
        starts = [np.flatnonzero(first[np.array(a, np.int64)]) for a in own]
        if any(len(s) != len(r) or s[0] for s, r in zip(starts, runs, strict=True)):
            return None
        ids = np.fromiter(chain.from_iterable(own), np.int32, sum(map(len, own)))
        before = np.cumsum([0, *map(len, own)])
        agree = [[True] * len(r) if a == b else [encode_batch([w], self.raw)[0] == _standard(self.raw).encode(w) for w in r] for r, a, b in zip(runs, own, theirs, strict=True)]
        return ids, np.concatenate([s + n for s, n in zip(starts, before, strict=False)]), np.fromiter(chain.from_iterable(agree), bool)

    def learn(self, words: list[str]) -> bool:
        """Put new words into the store; False if they can't be told apart."""
        got = self.by_both(words)
        if got is None:
            return False
        ids, begin, agree = got
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.held += sum(map(len, words))
        self.begin = np.concatenate([self.begin[:-1], begin + len(self.ids), [len(self.ids) + len(ids)]])
        self.ids = np.concatenate([self.ids, ids])
        self.agree = np.concatenate([self.agree, agree])
        return True

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]] | None:
        """(ids, agreement) of texts of which ``_worded`` holds; None if their words can't be told apart by first pieces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        told = lists.flatten().dictionary_encode()
        words = told.dictionary.to_pylist()
        short = [w for w in words if len(w) <= self.longest]
        new = [w for w in short if w not in self.at]
        if len(self.at) + len(new) > self.most or self.held + sum(map(len, new)) > self.chars:
            self.clear()
            new = short
        if new and not self.learn(new):
            return None
        place, ids, begin, agrees = self.at, self.ids, self.begin, self.agree
        if len(short) < len(words):  # words for this batch alone, behind the store's
            long = [w for w in words if len(w) > self.longest]
            got = self.by_both(long)
            if got is None:
                return None
            place = dict(zip(long, range(len(self.at), len(self.at) + len(long)), strict=True))
            place.update((w, self.at[w]) for w in short)
            begin = np.concatenate([begin[:-1], got[1] + len(ids), [len(ids) + len(got[0])]])
            ids, agrees = np.concatenate([ids, got[0]]), np.concatenate([agrees, got[2]])
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))[told.indices.to_numpy()]
        length = (begin[1:] - begin[:-1])[at]
        ends = np.cumsum(length)
        flat = ids[np.repeat(begin[at] - ends + length, length) + np.arange(ends[-1])]
        first = lists.offsets.to_numpy()
        agree = np.logical_and.reduceat(agrees[at], first[:-1])
        return list(zip(np.split(flat, ends[first[1:-1] - 1]), agree.tolist(), strict=True))


@lru_cache(maxsize=1)
def _words(raw: bytes) -> Words:
    return Words(raw)


def _encoded(texts: list[str], raw: bytes) -> list[tuple[np.ndarray, bool]]:
    """(ids, agreement) of each text; by words where that is the same."""
    by_words = _can_cut(raw)
    kinds = [by_words and _worded(t) for t in texts]
    own = [t for t, k in zip(texts, kinds, strict=True) if k]
    told = _words(raw).encode(own) if own else []
    if told is None:
        kinds, told = [False] * len(texts), []
    other = [t for t, k in zip(texts, kinds, strict=True) if not k]
    found = iter(told)
    ids = encode_batch(other, raw) if other else []
    rest = iter([(np.fromiter(a, np.int32, len(a)), a == b) for a, b in zip(ids, _standard(raw).encode(other, num_threads=1) if other else [], strict=True)])
    return [next(found) if k else next(rest) for k in kinds]


def encode_texts(texts: list[str], raw: bytes, chars: int = 1_000_000) -> Iterator[tuple[np.ndarray, bool, bool]]:
    """(token ids, round trip, parity) of each text, in batches of about ``chars`` characters so that memory stays bounded."""
    parts = [cut_text(t, chars) if len(t) > chars and _can_cut(raw) else [t] for t in texts]
    flat = list(chain.from_iterable(parts))
    owed = iter([len(p) for p in parts])
    left, got, same, alike = next(owed, 0), [], True, True
    for some in _batches([len(t) for t in flat], chars):
        units = flat[some]
        found = _encoded(units, raw)
        for (ids, agree), text, back in zip(found, units, decode_ids([x[0].tolist() for x in found], raw), strict=True):
            got.append(ids)
            same, alike, left = same and back == text, alike and agree, left - 1
            if not left:
                yield got[0] if len(got) == 1 else np.concatenate(got), same, alike
                left, got, same, alike = next(owed, 0), [], True, True


def encode(docs: DataFrame, model_path: str = MODEL, tokens: bool = True, chars: int = 1_000_000, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip, parity and, with ``tokens``, the ids of every whole text.

    The model file is read on the driver and goes to the tasks by value (half a megabyte, whatever the input).
    ids_sha256 is of the ids as 32-bit little-endian numbers; round_trip says whether decoding gives the text back,
    parity whether the sentencepiece library gives the same ids. A null or empty text has no tokens. A very long text
    is encoded and checked in parts, see ``cut_text`` (as a whole with models that don't allow that).
    Repeated rows are encoded alike; other columns are ignored; an empty table gives no rows.
    """
    import pyarrow as pa

    raw = Path(model_path).read_bytes()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))  # else each task starts a thread for every core of the machine
        for batch in batches:
            lengths = [n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for part in _batches(lengths, chars):
                size = part.stop - part.start
                found = list(encode_texts([t or "" for t in batch.column(1).slice(part.start, size).to_pylist()], raw, chars))
                counts = np.array([len(x[0]) for x in found], np.int64)
                columns = [
                    batch.column(0).slice(part.start, size),
                    pa.array(counts),
                    pa.array([hashlib.sha256(x[0]).hexdigest() for x in found]),
                    pa.array([x[1] for x in found], pa.bool_()),
                    pa.array([x[2] for x in found], pa.bool_()),
                ]
                if tokens:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[0] for x in found]))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean" + ", ids array<int>" * tokens
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)
