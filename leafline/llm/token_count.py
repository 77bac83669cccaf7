"""Token counts of a byte-pair model with byte fallback, by heap and linked list.

A text is escaped as the model's library does it: a dummy space in front, every
space as U+2581, nothing else normalised.  Its symbols are characters; the pair
whose joined piece ranks lowest is merged again and again (the leftmost of equal
ranks), held by a heap over a doubly linked list.  The count is the initial symbols
less the merges; a character that is no piece counts one for each UTF-8 byte.  No
identifier is ever made.

No piece has U+2581 after another character, and some characters are in no longer
piece at all; no merge crosses such a place, so a text falls apart into *units*
that are counted alone, and the counts of frequent units are kept.

Defined results: null and empty texts count 0; special strings inside a text are
plain characters; a text of any length is counted whole; rows that repeat give equal
rows; other columns pass through untouched, whatever their names, but a table that
has one of the result columns is refused; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
#: A model file is sent to the workers; larger files than this are refused.
MOST_MODEL_BYTES = 64 << 20


class HeapBpe:
    """Counts tokens; at most ``2 * most_kept`` unit counts are remembered.

    They are in two generations: when the younger is full, the older goes, and units
    that are met again move on to the new younger one."""

    def __init__(self, model: bytes, most_kept: int = 700_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only byte-pair models with byte fallback and no normalisation are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ranks = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        longer = [p for p in self.ranks if len(p) > 1]
        joined = set().union(*longer) if longer else set()
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        unit = rf"[^{SPACE}{alone}]" if alone else rf"[^{SPACE}]"
        splits = not any(SPACE in p.lstrip(SPACE) for p in longer)
        self.units = re.compile(rf"{SPACE}*{unit}+|{SPACE}+|[{alone}]" if alone else rf"{SPACE}*{unit}+|{SPACE}+") if splits else re.compile(r"(?s).+")
        self.most_kept = most_kept
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def text(self, text: str) -> int:
        """Tokens of one text."""
        if not text:
            return 0
        kept, total = self.kept, 0
        for unit, times in Counter(self.units.findall(self.prefix + text.replace(" ", SPACE))).items():
            n = kept.get(unit)
            if n is None:
                n = self.older.get(unit)
                if n is None:
                    n = self.unit(unit)
                if len(kept) >= self.most_kept:
                    self.older, self.kept = kept, {}
                    kept = self.kept
                if len(unit) <= 64:
                    kept[unit] = n
            total += n * times
        return total

    def unit(self, unit: str) -> int:
        """Tokens of a string that is merged as a whole."""
        ranks = self.ranks
        if unit in ranks and len(unit) <= 2:
            return 1
        symbols, merges = self.merged(unit)
        return len(symbols) - merges + sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in symbols if s is not None and len(s) == 1 and s not in ranks)

    def merged(self, unit: str) -> tuple[list[str | None], int]:
        """The symbols of ``unit`` when no pair is left to merge, None where one was merged into
        a symbol before it, and the number of merges."""
        ranks = self.ranks
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        heap = [(r, i, p) for i, p in enumerate(map("".join, zip(symbols, symbols[1:], strict=False))) if (r := ranks.get(p)) is not None]
        merges = 0
        if heap:
            heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, piece = heappop(heap)
                left = symbols[i]
                if left is None:
                    continue
                j = after[i]
                if j >= n or left + symbols[j] != piece:  # type: ignore[operator]
                    continue
                symbols[i], symbols[j] = piece, None
                merges += 1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    joined = piece + symbols[k]  # type: ignore[operator]
                    if (r := ranks.get(joined)) is not None:
                        heappush(heap, (r, i, joined))
                h = before[i]
                if h >= 0:
                    joined = symbols[h] + piece  # type: ignore[operator]
                    if (r := ranks.get(joined)) is not None:
                        heappush(heap, (r, h, joined))
        return symbols, merges


_MODELS: dict[int, HeapBpe] = {}


def count_tokens(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """All columns of ``df`` but ``text``, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    One narrow pass: no row moves, and a row's count needs nothing but its text."""
    model = Path(model_path).read_bytes()
    if len(model) > MOST_MODEL_BYTES:
        raise ValueError(f"model file of {len(model)} bytes")
    taken = {"n_bytes", "n_tokens", "over_limit"} & set(df.columns)
    if taken:
        raise ValueError(f"there are columns {sorted(taken)} already")
    sent = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        key = zlib.crc32(sent.value)
        bpe = _MODELS.get(key) or _MODELS.setdefault(key, HeapBpe(sent.value))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = pa.array([bpe.text(t.as_py() or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*names, "n_tokens"])

    sized = df.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("text "))
    names = sized.columns[:-1]
    from pyspark.sql.types import LongType, StructType

    schema = StructType(sized.schema.fields[:-1]).add("n_tokens", LongType())
    out = sized.mapInArrow(count, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
