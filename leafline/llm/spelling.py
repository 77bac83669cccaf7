"""Spelling variant grouping: words one edit apart, found by two-dimensional range reporting.

A word is a point: its rank in the lexicon in forward order, and its rank in the order of
the reversed words.  Words that begin with a prefix are an interval of the first order,
words that end with a suffix one of the second.  So the words that differ from ``w`` at
position ``i`` alone are the points in the rectangle of the prefix before ``i`` and the suffix
behind it, among words of the length that the edit gives: replaced characters among
words as long as ``w``, inserted ones among words one longer (a deletion is an insertion
seen from the other word).  A wavelet tree over the second ranks in forward order
reports the points of all rectangles at once, level by level, and does not follow a
branch that is empty.

The lexicon is too large for one tree.  Two words one edit apart agree before a position
or behind it, so words are dealt out twice, by the first half for edits in the second,
and by the second half for edits in the first, both as the shorter and as the longer
word.  A *family* is the words of one such key.  A family of more than ``most`` words is
split at the middle of its positions in the same way, again and again; with one
position left its key says all other characters, so no family can stay large and
none is cut.  Families are hashed to buckets that follow the lexicon, and a bucket's
families of one shape share a tree: words of two families meet in no rectangle.

A bucket returns a row a word (how many near words, and the best of them), never pairs.
Chains of forms are followed from their ends: the words without a form are their own
roots, and each round takes the words whose form has just got its root.  Counts at
least double along a chain, so rounds are few, and a word has few words one edit away,
so no key of the joins is hot.

Defined results: a null text has no words; a null id counts as an empty text in the
hash of the planted errors; texts of any length are read whole; rows that repeat are
documents of their own, so their words count again; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import kernels, scratch

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run whose hash this number divides loses a letter.
ERROR_EVERY = 97
RUN = r"[a-zÀ-ÿ]+"
FAMILY = "size int, lo int, hi int, word binary, n long"
NEAR = "word binary, n long, n_near long, best_n long, best binary"
NEAR_ARROW = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.binary())])
#: Rectangles that descend the tree together; bounds the memory of a bucket.
BLOCK_RECTANGLES = 1 << 18


# The lexicon


def lexicon(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and how often it occurs, of words that are long and frequent enough."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = (h % F.char_length("run")).cast("int")
    word = F.when(h % ERROR_EVERY == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.char_length("run")))).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# Families


def _family_key() -> F.Column:
    """What the words of a family share: its positions, and the characters outside them."""
    tail = F.greatest(F.lit(0), F.col("size") - F.col("hi"))
    return F.xxhash64("size", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.when(tail > 0, F.substring("word", F.octet_length("word") - tail + 1, tail)))


def families(words: DataFrame, most: int) -> DataFrame:
    """Each word (one byte a character) in the families in which it can meet a near word."""
    length = F.octet_length("word")
    shapes = []
    for shorter in (0, 1):  # as the shorter or equal word, and as the longer one
        size = length - shorter
        half = F.floor(size / 2).cast("int")
        shapes += [F.struct(size.alias("size"), F.lit(0).alias("lo"), half.alias("hi")), F.struct(size.alias("size"), half.alias("lo"), (size + 1).alias("hi"))]
    left = words.select(F.explode(F.array(*shapes)).alias("f"), "word", "n").select("f.*", "word", "n")
    out = None
    while True:
        left = scratch.stored(left.withColumn("family", _family_key()), "spelling-families")
        large = left.groupBy("family").count().where(F.col("count") > most).select("family")
        large = scratch.stored(large, "spelling-large")
        split = F.col("hi") - F.col("lo") > 1
        if large.isEmpty():
            return left if out is None else out.unionByName(left)
        again = left.where(split).join(large, "family", "left_semi")
        rest = left.join(large, "family", "left_anti").unionByName(left.where(~split).join(large, "family", "left_semi"))
        out = rest if out is None else out.unionByName(rest)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        left = again.select("size", F.explode(parts).alias("p"), "word", "n").select("size", "p.lo", "p.hi", "word", "n")
        if left.isEmpty():
            return out


# Range reporting


class WaveletTree:
    """The permutation ``values``; reports the points of rectangles of places and values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.levels = max(1, int(n - 1).bit_length()) if n else 0
        self.sums, self.zeros = [], []
        order = np.asarray(values, dtype=np.int64)
        for level in range(self.levels):
            bit = (order >> (self.levels - 1 - level)) & 1
            self.sums.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(n - int(self.sums[-1][-1]))
            order = np.concatenate((order[bit == 0], order[bit == 1]))

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectangle and value of each point with a place in ``x0..x1`` and a value in ``y0..y1``
        (ends exclusive)."""
        which = np.flatnonzero((x0 < x1) & (y0 < y1))
        a, b, least, most = x0[which], x1[which], y0[which], y1[which]
        base = np.zeros(len(which), dtype=np.int64)
        for level in range(self.levels):
            if not len(which):
                break
            width = 1 << (self.levels - 1 - level)
            sums, zeros = self.sums[level], self.zeros[level]
            one_a, one_b = sums[a], sums[b]
            low = (a - one_a < b - one_b) & (least < base + width)
            high = (one_a < one_b) & (most > base + width)
            a, b, base, which, least, most = (
                np.concatenate((left[low], right[high]))
                for left, right in ((a - one_a, zeros + one_a), (b - one_b, zeros + one_b), (base, base + width), (which, which), (least, least), (most, most))
            )
        # a leaf is one value; those at the edge were not told from the interval's ends yet
        inside = (base >= least) & (base < most)
        return which[inside], base[inside]


def _intervals(letters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of words (rows of ``letters``, 0 behind their ends), and how many characters
    each has in common with the one before it in that order."""
    wide = letters.shape[1]
    order = np.argsort(np.ascontiguousarray(letters).view(f"S{wide}").ravel(), kind="stable")
    s = letters[order]
    same = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        differs = s[1:] != s[:-1]
        same[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    return order, np.minimum(same, np.minimum(length[order], np.roll(length[order], 1)))


class Shape:
    """Words of ``size`` and of ``size + 1`` characters that may differ at ``lo <= i < hi``."""

    def __init__(self, words: list[bytes], size: int, lo: int, hi: int):
        self.size, self.lo, self.hi = size, lo, hi
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        wide = size + 1
        self.letters = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        backward = np.frombuffer(b"".join(w[::-1].ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        self.forward, self.same_front = _intervals(self.letters, self.length)
        self.reverse, self.same_back = _intervals(backward, self.length)

    def _spans(self, order: np.ndarray, same: np.ndarray, k: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the interval, among the words that ``counts`` counts, of those that share ``k`` characters."""
        new = same < k
        new[0] = True
        at = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        begin, end = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        begin[order], end[order] = counts[at][of], counts[np.append(at[1:], len(order))][of]
        return begin, end

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of near words, each once from either side where they are equally long,
        else once from the shorter."""
        out = [(np.zeros(0, np.int64),) * 2]
        shorter = np.flatnonzero(self.length == self.size)
        for longer in (0, 1):
            part = self.length == self.size + longer
            if not part.any() or not len(shorter):
                continue
            front, back = part[self.forward], part[self.reverse]
            before, behind = np.concatenate(([0], np.cumsum(front))), np.concatenate(([0], np.cumsum(back)))
            rank = np.empty(len(part), dtype=np.int64)
            named = self.reverse[back]
            rank[named] = np.arange(len(named))
            tree = WaveletTree(rank[self.forward[front]])
            for i in range(self.lo, min(self.hi, self.size + longer)):
                x0, x1 = self._spans(self.forward, self.same_front, i, before)
                y0, y1 = self._spans(self.reverse, self.same_back, self.size + longer - i - 1, behind)
                # a word of the same length is in its own rectangle
                some = shorter[(x1 - x0 > 1 - longer)[shorter] & (y1 - y0 > 1 - longer)[shorter]]
                for a in range(0, len(some), BLOCK_RECTANGLES):
                    one = some[a : a + BLOCK_RECTANGLES]
                    which, value = tree.report(x0[one], x1[one], y0[one], y1[one])
                    w, v = one[which], named[value]
                    # of the places where one character can be inserted the last counts
                    real = w != v if not longer else (self.letters[v, i] != self.letters[w, i])
                    out.append((w[real], v[real]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_words(table: pa.Table) -> pa.Table:
    """One bucket: a row for each word that has a near word here."""
    shapes = [np.array(table[c]) for c in ("size", "lo", "hi")]
    order = np.lexsort(shapes[::-1])
    keys = np.column_stack(shapes)[order]
    cuts = np.flatnonzero(np.append(np.any(np.diff(keys, axis=0, prepend=-1), axis=1), True)) if len(order) else np.zeros(1, int)
    made = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = table.take(pa.array(order[a:b]))
        words, n = part["word"].to_pylist(), np.array(part["n"])
        shape = Shape(words, *keys[a].tolist())
        w, v = shape.pairs()
        if not len(w):
            continue
        other = shape.length[w] != shape.length[v]
        w, v = np.concatenate((w, v[other])), np.concatenate((v, w[other]))
        # the best neighbour: the largest count, then the first in code-point order
        rank = np.empty(len(words), dtype=np.int64)
        rank[shape.forward] = np.arange(len(words))
        by = np.lexsort((rank[v], -n[v], w))
        w, v = w[by], v[by]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        times = np.diff(first, append=len(w))
        best = v[first]
        made.append(pa.table([pa.array([words[k] for k in w[first].tolist()], pa.binary()), pa.array(n[w[first]]), pa.array(times), pa.array(n[best]), pa.array([words[k] for k in best.tolist()], pa.binary())], schema=NEAR_ARROW))
    return pa.concat_tables(made) if made else NEAR_ARROW.empty_table()


# Variants


def neighbours(words: DataFrame, most: int = 20_000, bucket_rows: int = 60_000) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``best_n`` and ``best`` of each word that has a near word."""
    spark = words.sparkSession
    small = words.select(F.encode("word", "ISO-8859-1").alias("word"), "n")
    dealt = families(small, most)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(dealt.count() / bucket_rows))
    found = dealt.select(F.pmod("family", F.lit(buckets)).alias("bucket"), "size", "lo", "hi", "word", "n").groupBy("bucket").applyInArrow(near_words, NEAR)
    text = lambda c: F.decode(c, "ISO-8859-1")
    found = found.select(text("word").alias("word"), "n", "n_near", "best_n", text("best").alias("best"))
    best = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    return best.select("word", "n", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word`` and the last word of its chain of forms."""
    linked = forms.where("form IS NOT NULL").select("word", "form")
    level = forms.where("form IS NULL").select("word", F.col("word").alias("root"))
    parts = []
    while True:
        level = scratch.stored(level, "spelling-roots")
        if level.isEmpty():
            break
        parts.append(level)
        level = linked.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root")
    out = parts[0] if parts else level
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 20_000) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word of the lexicon.

    ``form``: the near word with the largest count, of equal ones the first in code-point
    order, if it is at least twice as frequent; ``root``: where the forms lead."""
    words = scratch.stored(lexicon(docs, key, text), "spelling-lexicon")
    near = neighbours(words, most).select(F.col("word").alias("near_word"), "n_near", "best_n", "best")
    known = words.join(near, F.col("word") == F.col("near_word"), "left")
    better = F.col("best_n") >= 2 * F.col("n")
    forms = scratch.stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = with_roots(forms).withColumnRenamed("word", "root_of")
    return forms.join(roots, F.col("word") == F.col("root_of")).select("word", "form", "root", "n", "n_near", "form_n")
