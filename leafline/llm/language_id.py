"""Language identification by words first, then by shorter and shorter character n-grams.

The model has the log frequency of each word per language, and of character n-grams
of 5 to 1 characters.  A known word scores by its word frequencies.  An unseen word
scores by the mean over its n-grams of the longest length of which any is known.  A
text's score of a language is the sum over its words; the answer is the best
language and its share after a softmax.

Words are runs of letters (``str.isalpha``) in lower case: numerals such as ``½`` are
none.  Words and n-grams are known by 64-bit hashes, so a block of texts is scored by
array operations alone.

The model is fitted on a bounded sample of labelled rows: about ``per_language``
different texts of each language, chosen by a hash of the text, all of them where a
language has fewer; a text that many rows share counts once.  Every word and n-gram of
the sample stays, so the sample's bound is the model's.  Prediction reads every whole
text.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is
every text if no labelled row exists.  Equal scores go to the first language in
alphabetical order.  Rows that repeat get equal results; a very long text is scored
whole, alone in its block; an empty table gives an empty result; other columns pass
through; a table that has a column ``lang_pred`` or ``score`` is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from leafline.llm import kernels
from leafline.llm.kernels import U64

LONGEST = 5
UNDETERMINED = "und"
#: A driver reads one row a language; more are refused.
MOST_LANGUAGES = 1000
#: Added to every count, those of unseen words among them.
PRIOR = 0.5
#: Characters that are scored at once.
BLOCK_CHARACTERS = 1 << 18
CHAR_BASE = 0x8CB92BA72F3D8DD7

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000))
    return _LETTERS[0]


class Words:
    """The words of a block of texts: the distinct ones, and where they are."""

    def __init__(self, texts: list[str | None]):
        lower = [t.lower() if t else "" for t in texts]
        code = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(t) + 1 for t in lower], dtype=np.int64)
        off = np.concatenate(([0], np.cumsum(sizes)))
        inside = letters()[code]
        edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.code, self.documents = code, len(texts)
        self.doc = np.searchsorted(off, starts, side="right") - 1
        h = kernels.word_hashes(code.view(np.uint8), 4 * starts, 4 * ends)
        self.key, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.size = starts[first], (ends - starts)[first]

    def grams(self, some: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the distinct words ``some``, their ends marked where
        ``n`` is more than 1, and the place of each n-gram's word in ``some``."""
        pad = 1 if n > 1 else 0
        size = self.size[some] + 2 * pad
        begin = np.concatenate(([0], np.cumsum(size)))
        nth = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        at = np.repeat(self.start[some] - pad, size) + nth
        marked = np.full(len(at), 0x20, dtype=U64)
        real = (nth >= pad) & (nth < np.repeat(size - pad, size))
        marked[real] = self.code[at[real]]
        word = np.repeat(np.arange(len(some)), size)
        fits = np.flatnonzero(nth + n <= np.repeat(size, size))
        return kernels.mix(kernels.windows(marked + U64(1), n, CHAR_BASE)[fits] + U64(n)) if len(fits) else np.zeros(0, U64), word[fits]


class Table:
    """Of each key the languages that have it and its log count above that of an unseen one."""

    def __init__(self, key: np.ndarray, language: np.ndarray, count: np.ndarray):
        order = np.lexsort((language, key))
        self.keys, first = np.unique(key[order], return_index=True)
        self.ends = np.append(first, len(key)).astype(np.int64)
        self.language = language[order]
        self.gain = np.log((count[order].astype(np.float64) + PRIOR) / PRIOR)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def gains(self, places: np.ndarray, into: np.ndarray, rows: int, languages: int) -> np.ndarray:
        """Sums of the gains of ``places`` over the ``rows`` that ``into`` names."""
        size = self.ends[places + 1] - self.ends[places]
        at = np.repeat(self.ends[places] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)
        cell = np.repeat(into, size) * languages + self.language[at]
        return np.bincount(cell, weights=self.gain[at], minlength=rows * languages).reshape(rows, languages)


class Model:
    """Log frequencies by language of words (``tables[0]``) and of n-grams of 1 to ``LONGEST``
    characters.  The log frequency of a key is its language's ``base`` and the key's gain."""

    def __init__(self, languages: list[str], rows: np.ndarray | list[tuple[int, int, int, int]]):
        """``rows``: length (0 for words), key (as a signed number), language's place and count."""
        length, key, language, count = np.asarray(rows, dtype=np.int64).reshape(-1, 4).T
        self.languages = languages
        self.tables, bases = [], []
        for n in range(LONGEST + 1):
            own = length == n
            table = Table(key[own].view(U64), language[own], count[own])
            sums = PRIOR * (len(table.keys) + 1) + np.bincount(language[own], weights=count[own], minlength=len(languages))
            self.tables.append(table)
            bases.append(np.log(PRIOR / sums))
        self.base = np.array(bases).reshape(LONGEST + 1, len(languages))

    def scores(self, words: Words) -> np.ndarray:
        """Log frequency of each distinct word by language."""
        k = len(self.languages)
        out = np.zeros((len(words.key), k))
        place = self.tables[0].find(words.key)
        known, left = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        out[known] = self.base[0] + self.tables[0].gains(place[known], np.arange(len(known)), len(known), k)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            key, word = words.grams(left, n)
            place = self.tables[n].find(key)
            key, word, place = key[place >= 0], word[place >= 0], place[place >= 0]
            times = np.bincount(word, minlength=len(left))
            some = times > 0
            if some.any():
                mean = self.tables[n].gains(place, word, len(left), k)[some] / times[some, None]
                out[left[some]] = self.base[n] + mean
                left = left[~some]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and share of each text."""
        names, shares = [], []
        for block in blocks(texts):
            words = Words(block)
            times = np.bincount(words.doc, minlength=words.documents)
            if not self.languages:
                names += [UNDETERMINED] * len(block)
                shares.append(np.zeros(len(block)))
                continue
            score = self.scores(words)
            total = np.stack([np.bincount(words.doc, weights=score[words.of, k], minlength=words.documents) for k in range(len(self.languages))], axis=1)
            best = total.argmax(axis=1)
            share = 1.0 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(axis=1)
            names += [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), times.tolist(), strict=True)]
            shares.append(np.where(times > 0, share, 0.0))
        return names, np.concatenate(shares) if shares else np.zeros(0)


def blocks(texts: list[str | None], most: int = BLOCK_CHARACTERS) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters together."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "") + 1
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word and n-gram counts of the sample: length (0 for words), key, language, count."""
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for block in blocks(texts):
                words = Words(block)
                times = np.bincount(words.of, minlength=len(words.key))
                every = np.arange(len(words.key))
                for n in range(LONGEST + 1):
                    if n:
                        key, word = words.grams(every, n)
                        key, of = np.unique(key, return_inverse=True)
                        count = np.bincount(of, weights=times[word], minlength=len(key)).astype(np.int64)
                    else:
                        key, count = words.key, times
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array([lang] * len(key), pa.string()), pa.array(count.astype(np.int64))], names=["length", "gram", "lang", "n"])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 1500) -> Model:
    """A model of the rows of ``df`` whose ``lang`` is not null."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], [])
    languages = sorted(r["lang"] for r in sizes)
    # a language with few texts gives all, whatever the error of the estimate
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / max(1.0, 0.9 * r["texts"])))))
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    counted = sample.select("lang", "text").mapInArrow(_counts, "length int, gram long, lang string, n long").groupBy("length", "lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    which = pa.compute.index_in(counted["lang"], pa.array(languages, pa.string()))
    return Model(languages, np.column_stack([np.array(c, dtype=np.int64) for c in (counted["length"], counted["gram"], which, counted["n"])]))


def predict(df: DataFrame, model: Model, text: str = "text", keep: bool = False) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, and without ``text`` unless ``keep``; no row moves."""
    taken = {"lang_pred", "score"} & set(df.columns)
    if taken:
        raise ValueError(f"there are columns {sorted(taken)} already")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sent.value
        for batch in batches:
            found, score = use.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], pa.array(found, pa.string()), pa.array(score, pa.float64())], names=names)

    rest = [c for c in df.columns if c != text]
    rest = [*rest, text] if keep else rest
    schema = StructType([df.schema[c] for c in rest]).add("lang_pred", StringType()).add("score", DoubleType())
    names = schema.names
    given = [F.col(f"`{c}`") for c in rest] + ([] if keep else [F.col(f"`{text}`").alias("text ")])
    return df.select(*given).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
