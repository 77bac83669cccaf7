"""Votes, reasons and readings that take little work a word against those that are made word by word."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafline.functions import compare, reasons
from leafline.operators import consensus, marks
from leafline.plans import texts

WORDS = ["the", "a", "of", "x", "Of", "q.", "u,", "it", "b-c", "S.", "Ct.", "-", "“q”", "12"]


def misread(made, base, words, slips):
    one = lambda w: [] if made.random() < slips else [made.choice(words)] if made.random() < slips else [w, made.choice(words)] if made.random() < slips else [w]
    return " ".join(v for w in base for v in one(w))


def places(seed, n, readers=(2, 3, 3, 5)):
    made = random.Random(seed)
    for _ in range(n):
        words = made.choice([WORDS, WORDS[:8], WORDS[:4]])
        base = [made.choice(words) for _ in range(made.randrange(1, 12))]
        yield [misread(made, base, words, 0.1) for _ in range(made.choice(readers))]


def test_a_vote_by_stretches_is_the_vote_on_all_words():
    for said in [*places(1, 3000), [], [None, ""], [None, "a b"]]:
        vote = consensus.resolve(said)
        assert consensus.outcome(said) == (vote.text, vote.status, vote.open_words)


def test_words_that_all_have_are_not_voted_on(monkeypatch):
    made = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    said = [" ".join(w + "x" if made.random() < 0.02 else w for w in base) for _ in range(3)]
    seen, own = [], consensus.vote_words
    monkeypatch.setattr(consensus, "vote_words", lambda base, *more, **by: seen.append(len(base)) or own(base, *more, **by))
    assert consensus.outcome(said)[1] == "voted" and sum(seen) < 40
    seen.clear()
    marks.open_places([" ".join([*base[:200], a, *base[200:]]) for a in ("one", "two", "three")])
    assert seen == [3]


def test_open_places_of_shortened_readings_are_those_of_whole_ones():
    for said in places(3, 2000):
        read = [compare.words(r) for r in said if compare.key_of(r)]
        if len(read) > 1:
            assert marks.open_places(said) == marks._cards(read, [consensus.aligned(read[0], other) for other in read[1:]])


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "abcdefghijklmnopqrstuvwxyz0123456789éà"])
def test_runs_of_long_texts_are_those_of_the_standard_matcher(letters):
    made = random.Random(4)
    for _ in range(60):
        a = "".join(made.choice(letters) for _ in range(made.randrange(150, 700)))
        b = "".join(made.choice([c, c, c, c, c, c, c, "", c + "x"]) for c in a) if made.random() < 0.7 else "".join(made.choice(letters) for _ in range(400))
        blocks = SequenceMatcher(None, a, b).get_matching_blocks()
        assert sum(reasons.sizes_met(a, b)) == sum(m.size for m in blocks)
        assert reasons.unlike(a, b) == (SequenceMatcher(None, a, b).ratio() < 0.5)


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(k, "\n".join(["", f"Line {k} of  many words, read thrice.", " ", "", "é ü"] * 3)) for k in range(60)]
    spark.createDataFrame([*rows, (60, "")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_blank_lines_are_read_as_blank(spark, docs):
    assert texts.readings(spark, docs).where(F.col("line") % 5 == 0).agg(F.max(F.length("text"))).first()[0] == 0


def test_one_file_is_read_by_many_tasks(spark, docs):
    plan = texts.readings(spark, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan


def test_settled_places_are_told_as_in_python(spark):
    rows = [(k, said) for k, said in enumerate([*places(7, 600), ["", "a"], ["", ""], ["Cal. Rptr. a", "Cal. Rptr. a", "b"]])]
    got = consensus.settled(spark.createDataFrame(rows, "k long, readings array<string>")).collect()
    for r in got:
        assert (r["text"], r["status"]) == (consensus.agreed(r["readings"]) or (None, None))
