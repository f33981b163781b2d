"""SentencePiece (merge type) encoding and decoding.

A text is cut where no piece can span, and each cut part is encoded by
backtracking: the longest piece at each position comes from an Aho-Corasick
automaton over the pieces that merging can produce, a piece is taken only if
merging it together with its left neighbour gives back the same two pieces, and
positions from which no continuation exists are noted in a bit field so that
they are tried once. The result is that of merging the whole text.

Model files are read as they are; supported are merge-type models with identity
normalisation, the default white space mark in front of words and byte fallback.
Other models are refused with ``ValueError``.

Defined results: null and empty texts give the end id alone and decode to the
empty text; null ids decode to the empty text; texts of any length are encoded whole;
repeated rows each give their row; there are no ties (of equal scores the left pair
merges first, as in the model's own rule); an empty table gives no rows; ``encode`` and
``decode`` keep other columns and refuse an output name that is taken; ``round_trip``
returns its own columns only, whatever else the table holds.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, small_batches, table

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bytes, by estimate, that a worker keeps of encoded parts; entries of checked neighbours and of prefixes.
CACHE_BYTES, CACHE_PAIRS, CACHED_PART_CHARS = 96 << 20, 200_000, 40


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(buf):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = buf[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", buf, at)[0], at + 4
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


class PieceModel:
    """Pieces of a merge-type model with encoding by backtracking and decoding."""

    def __init__(self, proto: bytes, unreachable: frozenset[int] | None = None):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for number, value in _fields(proto):
            if number == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                scores.append(entry.get(2, 0.0))
                self.kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        odd = set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("only merge-type models with byte fallback and leading space marks are supported")
        if odd or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only identity normalisation and ordinary pieces are supported")
        self.eos = self.pieces.index("</s>")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece has a space mark inside; parts would not be independent")
        if unreachable is None:
            unreachable = frozenset(i for p, i in self.ids.items() if self.merge(p) != [p])
        self.unreachable = unreachable
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if i not in unreachable:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        reachable = {p for p, i in self.ids.items() if i not in unreachable}
        self.reachable = reachable
        joined = set("".join(p for p in self.pieces if len(p) > 1 and self.ids.get(p) is not None))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and chr(c) != " ")
        odd_ones = "".join(sorted(c for c in joined if re.fullmatch(r"[^\W0-9_]", c) and not c.isalpha()))
        letter, sign = rf"(?![{odd_ones}])[^\W0-9_]" if odd_ones else r"[^\W0-9_]", rf"(?:[^\w{SPACE}{alone}]|[_{odd_ones}])"
        is_letter = re.compile(letter).fullmatch
        joins = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if is_letter(a) and not is_letter(b)} - {SPACE}
        tail = f"(?:[{''.join(map(re.escape, sorted(joins)))}]{sign}*(?:{letter})*)*" if joins else ""
        #: A part: a character that is in no longer piece; or space marks, then signs, then letters
        #: and further signs only if some piece holds them behind a letter. No piece spans two parts.
        self.parts = re.compile(f"{SPACE}*(?:{letter})+{tail}|{SPACE}*{sign}+(?:(?:{letter})+{tail})?|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._prefix: dict[str, int] = {}
        self._parts = _Parts(self)
        self.surface = [
            "" if k == CONTROL else UNKNOWN_SURFACE if k == UNKNOWN else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short string: the best score first, ties at the left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging both together keeps them apart."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def shorter(self, piece: str) -> int:
        """Length of the longest reachable proper prefix; a first character always stands."""
        known = self._prefix.get(piece)
        if known is None:
            if len(self._prefix) >= CACHE_PAIRS:
                self._prefix.clear()
            known = next((n for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.reachable), min(1, len(piece) - 1))
            self._prefix[piece] = known
        return known

    def split(self, part: str) -> list[str]:
        """Pieces of one part, by backtracking."""
        n = len(part)
        longest = [1] * n
        for end, length in self.automaton.iter(part):
            at = end - length + 1
            if length > longest[at]:
                longest[at] = length
        longest.append(0)
        failed = 0 if n < 512 else bytearray((n >> 3) + 1)  # a bit for each position
        known = self._pairs
        out = [part[: longest[0]]]
        at, length = longest[0], longest[longest[0]]
        while at < n:
            left = out[-1] if out else ""
            while length:
                end = at + length
                piece = part[at:end]
                if not (failed and (failed >> end if n < 512 else failed[end >> 3] >> (end & 7)) & 1):
                    if not left:
                        break
                    fits = known.get((left, piece))
                    if fits is None:
                        fits = self.compatible(left, piece)
                    if fits:
                        break
                length = self.shorter(piece)
            if length:
                out.append(piece)
                at = end
                length = longest[at]
            else:
                if not out:
                    raise ValueError("no encoding exists")
                if n < 512:
                    failed |= 1 << at
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                length = self.shorter(piece)
        return out

    def part_ids(self, part: str) -> tuple[int, ...]:
        ids: list[int] = []
        known = self.ids
        for piece in self.split(part):
            i = known.get(piece)
            if i is None:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(i)
        return tuple(ids)

    def encode(self, text: str | None, out: array | None = None) -> array:
        """Ids of a whole text with the end id; appended to ``out`` if given."""
        out = array("i") if out is None else out
        if text:
            known = self._parts
            out.extend(chain.from_iterable([known[p] for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]))
        out.append(self.eos)
        return out

    def decode(self, ids) -> str:
        """Text of ids: byte pieces become characters, a byte that starts none becomes U+FFFD."""
        surface, byte_of = self.surface, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_characters(bytes(run)))
                    run.clear()
                parts.append(surface[i])
            parts.append(_characters(bytes(run)))
            text = "".join(parts)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


class _Parts(dict):
    """Ids by part, in two generations: when the younger has half of the bytes, the older goes."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.before: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.before.pop(part, None) or self.model.part_ids(part)
        if len(part) <= CACHED_PART_CHARS:
            if self.size >= CACHE_BYTES // 2:  # what was in use lately stays
                self.before = dict(self)
                self.clear()
                self.size = 0
            # A string, a tuple of shared numbers and a dictionary's slot.
            self.size += 200 + 2 * len(part) + 8 * len(ids)
            self[part] = ids
        return ids


def _characters(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(proto: bytes, unreachable: frozenset[int] | None = None) -> PieceModel:
    return PieceModel(proto, unreachable)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _shipped(path: str) -> tuple[bytes, frozenset[int]]:
    """What a worker needs: the model file, whose size a vocabulary bounds, and its dead pieces."""
    proto = read_model(path)
    return proto, load(proto).unreachable


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (array<int>): all ids of the whole text and the end id."""
    if ids_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{ids_col} is a column already")
    proto, dead = _shipped(model_path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with at_work("sentencepiece", load.cache_clear):
            model = load(proto, dead)
            for texts in batches:
                flat, offsets = array("i"), array("i", [0])
                for t in texts:
                    model.encode(t.as_py(), flat)
                    offsets.append(len(flat))
                yield pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the text of ``ids_col``; null ids give the empty text."""
    if text_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{text_col} is a column already")
    proto, dead = _shipped(model_path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with at_work("sentencepiece", load.cache_clear):
            model = load(proto, dead)
            for lists in batches:
                out = []
                for x in lists:
                    out.append(model.decode(x.values.to_numpy().tolist()) if x.is_valid else "")
                yield pa.array(out, pa.string())

    return df.withColumn(text_col, text(F.col(ids_col)))


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, rows: int = 200) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) with one model in a worker and one step for both ways.

    ``ids`` are those of ``encode`` (left out unless ``with_ids``), ``ids_sha256`` the digest of their decimals joined by
    blanks, ``decoded_sha256`` that of the text ``decode`` gives for them.
    """
    proto, dead = _shipped(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work("sentencepiece", load.cache_clear):
            model = load(proto, dead)
            decimal = list(map(str, range(len(model.pieces))))
            for whole in batches:
                for lo in range(0, whole.num_rows, rows):
                    b = whole.slice(lo, rows)
                    flat, offsets, digests, decoded = array("i"), array("i", [0]), [], []
                    for t in b.column(1):
                        ids = model.encode(t.as_py()).tolist()
                        digests.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                        decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                        if with_ids:
                            flat.extend(ids)
                        offsets.append(offsets[-1] + len(ids))
                    n = pa.array(np.diff(np.array(offsets)), pa.int64())
                    lists = [pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays([b.column(0), n, *lists, pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names)

    names = [id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    kind = df.schema[id_col].dataType.simpleString()
    listed = "ids array<int>, " if with_ids else ""
    return small_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {listed}ids_sha256 string, decoded_sha256 string")


def op1(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
