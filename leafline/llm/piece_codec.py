"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has the whitespace marker U+2581 after another character, so
the escaped text falls apart at its markers into *chunks*: markers with the word
behind them.  No merge crosses a chunk's edge, so the ids of a text are those of its
chunks in order.  A task keeps a table of the distinct chunks that it has met: each
is segmented once, into a row of ids, and a text is a list of row numbers by position.
New short chunks of a batch are merged together, round by round, in arrays; a long one
is merged by a heap.  The ids are joined back for a whole Arrow batch at once, by gathering the rows.

The table is a task's own.  One table for the corpus would need every chunk of every
text to be shuffled by its word and back by its position, many times the input; a
task's table needs no shuffle.  It is bounded: when it holds ``most_chunks`` rows or
``most_ids`` ids it is begun again after the batch, and longer chunks than
``LONG_CHUNK`` characters live for one batch only.

Decoding gathers the bytes of the pieces in the same way.  As the library does it, a
control piece gives nothing, the first piece loses one leading marker, byte pieces in
a row are read as UTF-8 and each byte that cannot be read gives U+FFFD.

Defined results: a null text reads as empty, which encodes to the begin and end ids
alone and decodes to an empty text; a null list of ids decodes to null; special
strings inside a text are plain characters; equal rows give equal rows; a text of any
length is encoded whole; an empty table gives an empty result.  Columns that are
neither the text nor the result pass through, whatever their names; a result column
must not be there before, which is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from leafline.llm.token_count import MOST_MODEL_BYTES, NORMAL, SPACE, HeapBpe

UNKNOWN, CONTROL, BYTE = 2, 3, 6
LONG_CHUNK = 64
#: Texts of about so many characters are encoded at once; bounds the memory of the joined ids.
BLOCK_CHARS = 1 << 21


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` for each ``start`` and ``size``, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total, dtype=np.int64) + np.repeat(start - (ends - size), size)]


class Merges:
    """Byte-pair merging of many chunks at once.

    Symbols are numbers: the piece's id, a number behind all ids for a character that is
    only part of pieces, and ``other`` for all other characters.  In each round every
    chunk merges its pair of lowest rank, the leftmost of equal ones, as a chunk alone would."""

    def __init__(self, ranks: dict[str, float], ids: dict[str, int], byte_ids: list[int]):
        self.ids, self.byte_ids = ids, np.array(byte_ids, dtype=np.int32)
        number = dict(ids)
        self.pieces = max(number.values(), default=0) + 1
        for c in sorted({c for p in ranks for c in p} - set(number)):
            number[c] = self.pieces + len(number) - len(ids)
        self.other = self.pieces + len(number) - len(ids)
        order = sorted(p for p in ranks if len(p) > 1)
        place = {r: k for k, r in enumerate(sorted({ranks[p] for p in order}))}
        pairs = sorted((number[p[:k]] << 32 | number[p[k:]], place[ranks[p]], number[p]) for p in order for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.none = len(place)
        keys = np.array([x[0] for x in pairs], dtype=np.int64)
        self.rank, self.made = np.array([x[1] for x in pairs] + [self.none], np.int64), np.array([x[2] for x in pairs] + [0], np.int64)
        self._slots(keys)
        singles = {ord(c): n for c, n in number.items() if len(c) == 1}
        self.known = np.full(max(singles, default=0) + 2, self.other, dtype=np.int64)
        self.known[list(singles)] = list(singles.values())

    def _slots(self, keys: np.ndarray) -> None:
        """An open table of the pairs: their places by a hash of the pair."""
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.slot_key, self.slot = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(keys), np.int64)
        left = np.arange(len(keys))
        at = self._hash(keys)
        while len(left):
            free = np.flatnonzero(self.slot_key[at] < 0)
            self.slot_key[at[free]], self.slot[at[free]] = keys[left[free]], left[free]
            lost = self.slot_key[at] != keys[left]
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair of symbols, behind all for one that does not merge."""
        keys = left << 32 | right
        at = self._hash(keys)
        out = np.where(self.slot_key[at] == keys, self.slot[at], len(self.rank) - 1)
        miss = np.flatnonzero((self.slot_key[at] != keys) & (self.slot_key[at] >= 0))
        at = at[miss]
        while len(miss):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.slot_key[at] == keys[miss]
            out[miss[hit]] = self.slot[at[hit]]
            go = ~hit & (self.slot_key[at] >= 0)
            miss, at = miss[go], at[go]
        return out

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and how many each has."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        sym = self.known[np.minimum(code, len(self.known) - 1)]
        chunk = np.repeat(np.arange(len(chunks)), size)
        at = np.arange(len(sym))  # the character at which each symbol begins
        done = []
        pair = np.full(len(sym), len(self.rank) - 1)
        if len(sym):
            inner = np.flatnonzero(chunk[1:] == chunk[:-1])
            pair[inner] = self.pairs(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            best = np.minimum.reduceat(self.rank[pair] << 32 | np.arange(len(sym)), first)
            over = best >> 32 == self.none
            if over.any():
                gone = np.repeat(over, np.diff(first, append=len(sym)))
                done.append((at[gone], sym[gone], chunk[gone]))
                shift = np.cumsum(gone)
                best = best[~over]
                best = (best & 0xFFFFFFFF) - shift[best & 0xFFFFFFFF]
                sym, chunk, at, pair = sym[~gone], chunk[~gone], at[~gone], pair[~gone]
            else:
                best &= 0xFFFFFFFF
            sym[best] = self.made[pair[best]]
            stays = np.ones(len(sym), dtype=bool)
            stays[best + 1] = False
            best -= np.arange(len(best))  # where they are without the symbols merged into others
            sym, chunk, at, pair = sym[stays], chunk[stays], at[stays], pair[stays]
            near = np.concatenate((best, best[best > 0] - 1))
            near = near[near < len(sym) - 1]
            near = near[chunk[near] == chunk[near + 1]]
            pair[best] = len(self.rank) - 1
            pair[near] = self.pairs(sym[near], sym[near + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        at, sym, chunk = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at)
        return self._with_bytes(code, at[order], sym[order], chunk[order], len(chunks))

    def _with_bytes(self, code: np.ndarray, at: np.ndarray, sym: np.ndarray, chunk: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become their bytes."""
        odd = np.flatnonzero(sym >= self.pieces)
        size = np.ones(len(sym), dtype=np.int64)
        c = code[at[odd]]
        size[odd] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        ends = np.cumsum(size)
        out = np.repeat(sym, size).astype(np.int32)
        if len(odd):
            flat = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            places = np.arange(len(flat)) + np.repeat((ends - size)[odd] - (np.cumsum(size[odd]) - size[odd]), size[odd])
            out[places] = self.byte_ids[flat]
        return out, np.bincount(chunk, weights=size, minlength=chunks).astype(np.int64)


class ChunkTable(dict):
    """The distinct chunks of a task with their rows of ids; a chunk that is missing gets a row."""

    def __init__(self, bpe: HeapBpe, merges: Merges, most_chunks: int = 700_000, most_ids: int = 8_000_000):
        super().__init__()
        self.bpe, self.merges, self.most_chunks, self.most_ids = bpe, merges, most_chunks, most_ids
        self.new: list[str] = []
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.flat = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self.ends) - 1 + len(self.new)
        self.new.append(chunk)
        return at

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after another, and how many each has.  Short ones are
        merged together, each long one by a heap."""
        short = [c for c in chunks if len(c) <= LONG_CHUNK]
        flat, size = self.merges.segment(short)
        if len(short) == len(chunks):
            return flat, size
        parts = iter(np.split(flat, np.cumsum(size)[:-1]))
        rows = [next(parts) if len(c) <= LONG_CHUNK else self._by_heap(c) for c in chunks]
        return np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)

    def _by_heap(self, chunk: str) -> np.ndarray:
        number, as_bytes = self.merges.ids, self.merges.byte_ids
        out: list[int] = []
        for s in self.bpe.merged(chunk)[0]:
            if s is not None:
                i = number.get(s)
                out += [i] if i is not None else as_bytes[list(s.encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` in one array, and where each text's begin."""
        units, prefix, row = self.bpe.units, self.bpe.prefix, self.__getitem__
        places: list[int] = []
        cuts = [0]
        for text in texts:
            if text:
                places += map(row, units.findall(prefix + text.replace(" ", SPACE)))
            cuts.append(len(places))
        if self.new:
            flat, size = self.segment(self.new)
            self.flat = np.concatenate((self.flat, flat))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(size)))
        at = np.array(places, dtype=np.int64)
        size = self.ends[at + 1] - self.ends[at]
        joined = gathered(self.flat, self.ends[at], size)
        offsets = np.concatenate(([0], np.cumsum(size)))[np.array(cuts)]
        for chunk in self.new:
            if len(chunk) > LONG_CHUNK:
                del self[chunk]
        self.new = []
        if len(self) > self.most_chunks or len(self.flat) > self.most_ids:
            self._begin()
        return joined, offsets


class PieceCodec:
    """Encoder and decoder of one byte-pair model with byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        bpe = HeapBpe(model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if bpe.units.pattern == "(?s).+":
            raise ValueError("pieces of this model cross whitespace markers")
        kinds = np.array([p.type for p in proto.pieces])
        names = [p.piece for p in proto.pieces]
        as_byte = {int(p[3:5], 16): i for i, p in enumerate(names) if kinds[i] == BYTE}
        self.table = ChunkTable(bpe, Merges(bpe.ranks, {p: i for i, p in enumerate(names) if kinds[i] == NORMAL}, [as_byte[b] for b in range(256)]))
        self.begin, self.end = names.index(proto.trainer_spec.bos_piece), names.index(proto.trainer_spec.eos_piece)
        bodies = [self._bytes(p, int(k), proto.trainer_spec.unk_surface) for p, k in zip(names, kinds, strict=True)]
        self.bytes = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        self.size = np.array([len(b) for b in bodies], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.kinds = kinds
        self.marked = np.array([p.startswith(SPACE) and k == NORMAL for p, k in zip(names, kinds, strict=True)])
        self.strips = bool(proto.normalizer_spec.add_dummy_prefix)

    @staticmethod
    def _bytes(piece: str, kind: int, unknown: str) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (unknown if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def encode(self, texts: list[str], begin_end: bool) -> tuple[np.ndarray, np.ndarray]:
        ids, offsets = self.table.encode(texts)
        if begin_end:
            at = np.column_stack((offsets[:-1], offsets[1:])).reshape(-1)
            ids = np.insert(ids, at, np.tile(np.array([self.begin, self.end], np.int32), len(texts)))
            offsets = offsets + 2 * np.arange(len(offsets))
        return ids, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of lists of ids, which lie one after another."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is no piece of the model")
        size = self.size[ids]
        flat = gathered(self.bytes, self.start[ids], size)
        cuts = np.concatenate(([0], np.cumsum(size)))
        kinds = self.kinds[ids]
        # bytes of a character may not be joined over control pieces
        shown = np.flatnonzero(kinds != CONTROL)
        apart = np.flatnonzero((np.diff(shown) > 1) & (kinds[shown[:-1]] == BYTE) & (kinds[shown[1:]] == BYTE))
        left, right = shown[apart], np.append(shown[apart + 1], len(ids))
        seen = np.cumsum(np.concatenate(([0], kinds != CONTROL)))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            first = int(np.searchsorted(seen, seen[a] + 1)) - 1  # the first piece that is no control piece
            low = int(cuts[a])
            if self.strips and first < b and self.marked[ids[first]]:
                low += 1
            try:
                if right[np.searchsorted(left, a)] < b:
                    raise UnicodeDecodeError("utf-8", b"", 0, 0, "bytes around a control piece")
                out.append(flat[low : cuts[b]].tobytes().decode())
            except UnicodeDecodeError:
                out.append(self._by_runs(ids[a:b], first - a))
        return out

    def _by_runs(self, ids: np.ndarray, first: int) -> str:
        """One text with bytes that may be no UTF-8: each run of byte pieces is read alone."""
        parts: list[str] = []
        run = bytearray()
        for k, i in enumerate(ids.tolist()):
            body = self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes()
            if self.kinds[i] == BYTE:
                run += body
                continue
            parts.append(readable(bytes(run)))
            run.clear()
            parts.append(body.decode()[1 if self.strips and k == first and self.marked[i] else 0 :])
        return "".join(parts) + readable(bytes(run))


def readable(run: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        try:
            out.append(run[at:].decode())
            break
        except UnicodeDecodeError as error:
            good = at + error.start
            out += [run[at:good].decode(), "�"]
            at = good + 1
    return "".join(out)


_CODECS: dict[int, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    key = zlib.crc32(model)
    return _CODECS.get(key) or _CODECS.setdefault(key, PieceCodec(model))


def _sent(df: DataFrame, model_path: str):
    model = Path(model_path).read_bytes()
    if len(model) > MOST_MODEL_BYTES:
        raise ValueError(f"model file of {len(model)} bytes")
    return df.sparkSession.sparkContext.broadcast(model)


def _others(df: DataFrame, read: str, made: str) -> list[str]:
    rest = [c for c in df.columns if c != read]
    if made in rest:
        raise ValueError(f"there is a column {made} already")
    return rest


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``BLOCK_CHARS``."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, side="right")))
        yield at, end
        at = end


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", begin_end: bool = True, packed: bool = False, decoded: str | None = None) -> DataFrame:
    """All columns of ``df`` but ``text``, and the ``ids`` of the text: an array, or with
    ``packed`` their 32-bit little-endian bytes.  One narrow pass.

    ``decoded``: a column for the text that the ids decode to, made in the same pass."""
    rest = _others(df, text, ids)
    if decoded in (ids, *rest):
        raise ValueError(f"there is a column {decoded} already")
    sent = _sent(df, model_path)
    shown = df.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in _blocks(np.array(pa.compute.binary_length(texts))):
                found, offsets = codec.encode(texts.slice(a, b - a).to_pylist(), begin_end)
                if packed:
                    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(4 * offsets.astype("<i8")), pa.py_buffer(found.astype("<i4"))]).cast(pa.binary())
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
                back = [pa.array(codec.decode(found, offsets), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], made, *back], names=schema.names)

    schema = StructType(shown.schema.fields[:-1]).add(ids, BinaryType() if packed else ArrayType(IntegerType()))
    if decoded:
        schema = schema.add(decoded, StringType())
    return shown.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of ``df``, and the ``text`` of the ``ids``, an array or packed bytes."""
    _others(df, "", text)
    sent = _sent(df, model_path)
    shown = df.select(*(F.col(f"`{c}`") for c in df.columns), F.col(f"`{ids}`").alias("ids "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            if pa.types.is_binary(column.type):
                each = [None if v is None else np.frombuffer(v, "<i4") for v in column.to_pylist()]
            else:
                each = [None if v is None else np.array(v, np.int32) for v in column.to_pylist()]
            sizes = np.array([0 if v is None else len(v) for v in each], dtype=np.int64)
            for a, b in _blocks(sizes):
                flat = np.concatenate([np.zeros(0, np.int32), *(v for v in each[a:b] if v is not None)])
                texts = codec.decode(flat, np.concatenate(([0], np.cumsum(sizes[a:b]))))
                made = pa.array([None if v is None else t for v, t in zip(each[a:b], texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], made], names=[*names, text])

    names = df.columns
    return shown.mapInArrow(run, StructType(shown.schema.fields[:-1]).add(text, StringType()))
