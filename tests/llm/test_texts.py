"""WARC round trips, language, decontamination, token counts and language-model scores."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafline.llm import decontaminate, exchange, kernels, language_id, lm_score, scratch, token_count, warc

SF = "/root/testdata/sf0.001"


# WARC


def test_warc_round_trip(spark):
    made = random.Random(2)
    long = "".join(made.choice("abcé<>\r\n") for _ in range(60_000)) + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    same = "x" * 999 + "é"
    rows = [(1, "u1", long), (2, None, None), (3, "u\r\nX: y", ""), (4, "u", same), (9, "u", same), (7, "u", same), (5, "u", "y" * 999), (6, "u", "y" * 999), (9, "u", same), (10, "u", "z" * 16384), (11, "u", long + "!"), (None, "u", "no id"), (None, "u", same), (None, "u", "n" * 1200), (None, "u", "n" * 1200)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch.new_path(spark, "warc-test")
    warc.write(df, path)
    got = sorted(tuple(r) for r in warc.read(spark, path).select(F.coalesce("page_id", F.lit(-1)), "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1)), "complete").collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        other = 9 if html == same and i != 9 else None
        want.append((-1 if i is None else i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", other or -1, True))
    assert got == sorted(want)
    assert warc.read(spark, path).agg(F.max("segments")).first()[0] > 3


def test_warc_empty_table(spark):
    path = scratch.new_path(spark, "warc-empty")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_broken_segments_are_told(spark, tmp_path):
    parts = list(warc.records(1, 0, "u", b"p" * 5000, hashlib.sha1(b"p" * 5000).hexdigest(), None, 1024, 512))
    assert len(parts) > 4
    for k, some in enumerate((parts, parts[:2] + parts[3:], parts + parts[2:3], parts[:-1], [p.replace(b"ppp", b"ppq", 1) for p in parts])):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "part-0.warc").write_bytes(b"".join(reversed(some)))
        row = warc.read(spark, str(tmp_path / str(k))).first()
        assert row["complete"] == (k == 0) and (row["payload_bytes"] == 5000) == (k == 0)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunked_framing(size):
    for payload in (b"", b"a", b"\r\n0\r\n\r\n" * 9):
        assert warc.unchunk(warc.chunk_frame(payload, size)) == payload
    assert warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.unchunk(b"x\r\n") is None and warc.unchunk(b"3;e=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"


# Language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where("NOT held_out"))
    got = language_id.predict(docs.where("held_out").select("doc_id", "lang", "text"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    schema = "doc_id long, lang string, text string, words string"
    rows = [(1, "en", "the cat the dog", "c"), (2, "de", "der hund der kater", "c"), (3, None, "x", "c"), (4, "en", None, "c"), (5, "en", "the the cat", "c"), (6, "de", "der der hund", "c")]
    model = language_id.fit(spark.createDataFrame(rows, schema))
    ask = spark.createDataFrame([(1, None, "The", "c"), (2, None, None, "c"), (3, None, "12 !", "c"), (4, None, "hunde", "c"), (5, None, "the der", "c"), (6, None, "hund " * 50_000, "c")], schema)
    got = {r["doc_id"]: r for r in language_id.predict(ask, model, keep=True).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 7)] == ["en", "und", "und", "de", got[5]["lang_pred"], "de"] and got[2]["score"] == 0.0
    assert got[1]["text"] == "The" and got[6]["score"] == 1.0
    nothing = language_id.fit(spark.createDataFrame([], schema))
    assert nothing.predict(["text"])[0] == ["und"] and language_id.predict(ask, nothing).count() == 6
    assert language_id.predict(ask.limit(0), model).count() == 0
    numerals = language_id.predict(spark.createDataFrame([(1, "½ ² ① Ⅷ"), (2, "_ 7")], "doc_id long, text string"), model).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0.0 for r in numerals)


def slow_model(rows, most=10**9):
    """Counts of words and marked n-grams by language in plain dictionaries."""
    counts = {}
    for lang, text in sorted(set(rows)):
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            counts.setdefault((0, w), Counter())[lang] += 1
            for n in range(1, 6):
                marked = f" {w} " if n > 1 else w
                for i in range(len(marked) - n + 1):
                    counts.setdefault((n, marked[i : i + n]), Counter())[lang] += 1
    return counts


def slow_prediction(counts, languages, text):
    sums = {(n, x): sum(c[x] for (m, _), c in counts.items() if m == n) + 0.5 * (1 + sum(m == n for m, _ in counts)) for n in range(6) for x in languages}
    log = lambda n, g, x: math.log((counts[n, g][x] + 0.5) / sums[n, x])
    total, seen = dict.fromkeys(languages, 0.0), False
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        seen = True
        if (0, w) in counts:
            for x in languages:
                total[x] += log(0, w, x)
            continue
        for n in range(5, 0, -1):
            marked = f" {w} " if n > 1 else w
            known = [g for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if (n, g) in counts]
            if known:
                for x in languages:
                    total[x] += sum(log(n, g, x) for g in known) / len(known)
                break
    if not seen:
        return "und", 0.0
    best = max(languages, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_against_a_slow_prediction(spark):
    made = random.Random(5)
    words = {x: ["".join(made.choice(a) for _ in range(made.randint(1, 8))) for _ in range(40)] for x, a in (("da", "aeorsæ"), ("en", "aeorst"), ("ru", "абвгdo"))}
    text = lambda x, n: " ".join(made.choice(words[x]) if made.random() < 0.8 else made.choice(words["en"])[::-1] for _ in range(n))
    rows = [(x, text(x, 12)) for x in words for _ in range(15)]
    rows += rows[:10]
    model = language_id.fit(spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int"))
    asked = [text(x, made.randint(1, 6)) + made.choice(["", " Zzz", " ½x", "İ é"]) for x in words for _ in range(30)] + ["", "qqq", "12"]
    names, scores = model.predict(asked)
    counts = slow_model(rows)
    want = [slow_prediction(counts, sorted(words), t) for t in asked]
    assert names == [w[0] for w in want] and scores == pytest.approx([w[1] for w in want])


def test_language_is_learned_from_texts_that_repeat(spark):
    rows = [("en", "the cat")] * 600 + [("de", f"der hund {chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"), per_language=50)
    assert model.predict(["the", "hund"])[0] == ["en", "de"]


def test_backoff_uses_the_longest_known_length():
    word = language_id.Words(["ab"])
    grams = lambda n: word.grams(np.array([0]), n)[0].view(np.int64).tolist()
    assert [len(grams(n)) for n in (1, 2, 3, 4, 5)] == [2, 3, 2, 1, 0]
    model = language_id.Model(["a", "b"], [(2, grams(2)[1], 0, 9), (2, grams(2)[1], 1, 1), (1, grams(1)[0], 0, 1), (1, grams(1)[0], 1, 9)])
    assert model.predict(["xaby", "xay", "zzz"])[0] == ["a", "b", "a"] and model.predict(["zzz"])[1].tolist() == [0.5]


def test_every_word_of_the_sample_is_learned(spark):
    """A vocabulary of more than 50,000 words a language stays whole."""
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:05d}")
    rows = [(lang, " ".join(mark + name(k) for k in range(a, a + 1000))) for lang, mark in (("en", "x"), ("de", "y")) for a in range(0, 60_000, 1000)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.tables[0].keys) == 120_000
    assert model.predict(["x" + name(59_999), "y" + name(0)])[0] == ["en", "de"]


def test_result_columns_of_languages_must_be_new(spark):
    model = language_id.Model([], [])
    for name in ("lang_pred", "score"):
        with pytest.raises(ValueError):
            language_id.predict(spark.createDataFrame([("a", 1)], f"text string, {name} int"), model)


# Decontamination


def test_few_alignments_where_many_items_share_their_words():
    """Common words make many hits; the bounds leave few stretches and lose none that scores."""
    made = np.random.default_rng(1)
    share = 1 / np.arange(1, 5001)
    words = np.array([f"w{k}" for k in range(5000)])
    text = lambda n: " ".join(words[made.choice(5000, n, p=share / share.sum())])
    items = [text(40) for _ in range(1500)]
    docs = [text(200) for _ in range(20)]
    block = decontaminate.Items(list(range(len(items))), pa.array(items), 3, 0.5)
    flat, off = decontaminate.hashed_words(*kernels.column_bytes(pa.array(docs)))
    found = decontaminate.Passages(flat, off, block, 0.5).found()
    where, which = block.hits(flat, off)
    hits = {(int(np.searchsorted(off, p, side="right")) - 1, int(i)) for p, s in zip(where, which, strict=True) for i in block.item[block.seed == s]}
    assert len(found) < len(hits) / 5
    rest = sorted(hits - {(d, i) for d, i, _, _ in found})
    for k in range(0, len(rest), 500):
        some = rest[k : k + 500]
        assert all(score < 40 for score, _, _ in decontaminate.align([(block.words(i), flat[off[d] : off[d + 1]]) for d, i in some]))


def test_hits_are_handled_in_slices(monkeypatch):
    """The stretches do not depend on how many hits are expanded at once."""
    made = random.Random(13)
    items = [" ".join(made.choice("abcdefgh") for _ in range(12)) for _ in range(30)]
    docs = [" ".join(made.choice("abcdefgh") for _ in range(90)) for _ in range(9)]
    block = decontaminate.Items(list(range(30)), pa.array(items), 3, 0.5)
    flat, off = decontaminate.hashed_words(*kernels.column_bytes(pa.array(docs)))
    want = decontaminate.Passages(flat, off, block, 0.5).found()
    monkeypatch.setattr(decontaminate, "_slices", lambda times, f=decontaminate._slices: f(times, 5))
    assert len(want) > 9 and decontaminate.Passages(flat, off, block, 0.5).found() == want


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (decontaminate.MATCH if x == y else decontaminate.MISMATCH), h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
    return max(map(max, h))


def test_alignment_scores():
    made = np.random.default_rng(3)
    pairs = [(made.integers(0, 4, made.integers(1, 12)).astype(np.uint64), made.integers(0, 4, made.integers(1, 30)).astype(np.uint64)) for _ in range(200)]
    got = decontaminate.align(pairs)
    assert [g[0] for g in got] == [smith_waterman(a.tolist(), b.tolist()) for a, b in pairs]
    assert all(0 <= s <= e <= len(b) for (_, s, e), (_, b) in zip(got, pairs, strict=True))


def test_contaminated_documents(spark):
    made = random.Random(6)
    word = lambda: "".join(made.choice("abcdefghij") for _ in range(made.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(30) for _ in range(20)] + [["tiny"]]
    edited = [w if k % 7 else word() for k, w in enumerate(items[1])]
    dropped = [w for k, w in enumerate(items[2]) if k % 6]
    docs = {1: text(50) + items[0] + text(50), 2: edited + text(80), 3: text(9) + dropped, 4: text(300), 5: items[3][:5] + text(100), 6: [" ".join(items[4]).upper().replace(" ", ", ")], 7: text(5000) + items[5], 8: items[0] + text(20) + items[6]}
    schema = "doc_id long, text string, item long, score int"
    rows = [(i, " ".join(w), 1, 1) for i, w in docs.items()] + [(9, None, 1, 1), (10, "", 1, 1), (1, " ".join(docs[1]), 1, 1)]
    bench = spark.createDataFrame([(k, " ".join(w), 0) for k, w in enumerate(items)] + [(98, None, 0), (99, "!", 0)], "item_id long, text string, doc_id int")
    for block in (20_000, 5):
        found = decontaminate.contaminated(spark.createDataFrame(rows, schema), bench, block_items=block).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 0), (1, 0), (2, 1), (3, 2), (6, 4), (7, 5), (8, 0), (8, 6)]
    exact = next(r for r in found if r["doc_id"] == 7)
    assert (exact["score"], exact["start_word"], exact["end_word"]) == (1.0, 5000, 5030)
    assert decontaminate.contaminated(spark.createDataFrame([], schema), bench).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(rows, schema), bench.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_edits_that_leave_few_seeds(spark, exact):
    made = random.Random(9)
    word = lambda: "".join(made.choice("abcdefghij") for _ in range(8))
    text = lambda n: [word() for _ in range(n)]
    items = [text(30) for _ in range(5)]
    docs = [text(40) + [word() if k % every == 0 else w for k, w in enumerate(item)] + text(40) for item, every in zip(items, (4, 5), strict=False)]
    docs += [text(40) + items[2][:15] + text(40), text(40) + items[3][15:] + text(40)]
    # three equal words, 20 inserted, and no other three equal words in a row
    tail = [x for k in range(3, 30, 2) for x in (*items[4][k : k + 2], word())]
    docs += [text(40) + items[4][:3] + text(12) + tail + text(40)]
    planted = [(k, " ".join(w)) for k, w in enumerate(docs)]
    copies = [(100 + k, " ".join(text(9) + w)) for k, w in enumerate(items)] if exact else []
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(planted + copies, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, k) for k in range(5)] + [(i, i - 100) for i, _ in copies]
    for r in found:
        words = dict(planted + copies)[r["doc_id"]].split()
        assert r["score"] == smith_waterman(items[r["item_id"]], words) / 60 >= 0.5


def test_all_pairs_at_rates_of_edits(spark):
    """Every pair of document and item, aligned whole, and what the operator finds."""
    made = random.Random(21)
    word = lambda: "".join(made.choice("abcdefghij") for _ in range(made.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]

    def edit(w, rate):
        kind = made.random()
        return [w] if made.random() >= rate else [] if kind < 0.2 else [w, word()] if kind < 0.4 else [word()]

    items = [text(40) for _ in range(50)]
    docs, rates = [], (0.1, 0.2, 0.25, 0.3, 0.33)
    for rate in rates:
        docs += [text(60) + [x for w in item for x in edit(w, rate)] + text(60) for item in items]
    h = lambda words: decontaminate.hashed_words(*kernels.column_bytes(pa.array([" ".join(words)])))[0]
    items_h, docs_h = [h(x) for x in items], [h(x) for x in docs]
    want = set()
    for d, words in enumerate(docs_h):
        want |= {(d, k) for k, got in enumerate(decontaminate.align([(i, words) for i in items_h])) if got[0] >= 40}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string"), bench).collect()}
    assert found <= want
    for k, rate in enumerate(rates):
        true = {p for p in want if p[0] // 50 == k}
        print(f"edits {rate}: {len(found & true)} of {len(true)} pairs")
        assert len(found & true) >= 0.98 * len(true)


def test_alignment_at_the_end_of_a_very_long_passage():
    passage = np.arange(10, 10 + 4_400_000, dtype=np.uint64)
    passage[200_000:200_002], passage[-3:] = [1, 2], [1, 2, 3]
    assert decontaminate.align([(np.array([1, 2, 3], dtype=np.uint64), passage)]) == [(6, 4_399_997, 4_400_000)]


# Tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_token_counts_match_the_library(spark, library):
    path, model = library
    made = random.Random(8)
    texts = ["", " ", "  a  b ", "\n\n\t", "<s> </s> <unk> <0x0A> ▁▁", "日本語 ☃ 🙂", "a" * 3000, " " * 100, "é́​", "0123456789" * 40, "ſﬁ①"]
    texts += ["".join(made.choice("abc the\n\té▁ 日<>0,.'-") for _ in range(made.randint(1, 200))) for _ in range(300)]
    bpe = token_count.HeapBpe(open(path, "rb").read(), most_kept=20)
    want = [len(x) for x in model.encode(texts)]
    assert [bpe.text(t) for t in texts] == want
    assert [bpe.unit(bpe.prefix + t.replace(" ", "▁")) if t else 0 for t in texts[:40]] == want[:40]  # as a whole, too
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(-1, None, "x")], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in token_count.count_tokens(df, path, limit=10).collect()}
    assert [got[k]["n_tokens"] for k in range(len(texts))] == want and (got[-1]["n_tokens"], got[-1]["n_bytes"]) == (0, 0)
    assert all(got[k]["over_limit"] == (n > 10) and got[k]["n_bytes"] == len(texts[k].encode()) for k, n in enumerate(want))
    assert token_count.count_tokens(df.limit(0), path).count() == 0


def test_long_and_repeated_texts_and_names_that_are_taken(spark, library):
    """A text of a million characters is counted whole, repeated rows give equal rows, other
    columns pass, and a result column that is there already is refused."""
    path, model = library
    long = "wörd and ▁ 日本\n" * 70_000
    rows = [(1, long, "x"), (2, "a b", "y"), (2, "a b", "y"), (2, "a b", "z")]
    got = sorted((r["doc_id"], r["lang"], r["n_tokens"], r["n_bytes"]) for r in token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect())
    assert got == sorted((i, x, len(model.encode(t)), len(t.encode())) for i, t, x in rows)
    for name in ("n_bytes", "n_tokens", "over_limit"):
        with pytest.raises(ValueError):
            token_count.count_tokens(spark.createDataFrame([("a", 1)], f"text string, {name} int"), path)


# Language-model scores


def test_scores_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()}
    docs |= {-1: None, -2: "", -3: "!!", -4: "once", -5: docs[min(docs)]}
    target = set(sorted(docs)[10:40])
    words = {i: re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in docs.items()}
    counts = Counter(w for ws in words.values() for w in ws)
    known = {w for w, n in counts.items() if n >= 2}
    words = {i: [w if w in known else None for w in ws] for i, ws in words.items()}
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, score int")
    wanted = spark.createDataFrame([(i,) for i in target] + [(None,), (10**9,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.score(df, wanted).collect()}
    models = []
    for some in (target, set(docs)):
        one, two = Counter(w for i in some for w in words[i]), Counter(p for i in some for p in zip(words[i], words[i][1:]))
        models.append((some, one, two, sum(one.values())))
    for i, ws in words.items():
        own, pairs, losses = Counter(ws), Counter(zip(ws, ws[1:])), []
        for some, one, two, n in models:
            mine, loss = i in some, 0.0
            for k, w in enumerate(ws):
                p = (one[w] - mine * own[w] + 0.1) / (n - mine * len(ws) + 0.1 * (len(known) + 1))
                if k and (c := one[ws[k - 1]] - mine * own[ws[k - 1]]) > 0:
                    p = 0.7 * (two[ws[k - 1], w] - mine * pairs[ws[k - 1], w]) / c + 0.3 * p
                loss -= math.log(p)
            losses.append(loss)
        r = got[i]
        assert r["n_tokens"] == len(ws) and r["loss_target"] == pytest.approx(losses[0]) and r["loss_background"] == pytest.approx(losses[1])
        assert r["score"] is None if not ws else r["score"] == pytest.approx((losses[0] - losses[1]) / len(ws))
    assert lm_score.score(df.limit(0), wanted).count() == 0
    hops = lm_score.score(df, wanted, layout=exchange.Layout(chunks=7, buckets=13, bits=48, coarse=3, group=2))
    plain = lambda r: tuple(0.0 if v is None else v for v in r)
    assert {r["doc_id"]: plain(r) for r in hops.collect()} == {k: pytest.approx(plain(r), rel=1e-9) for k, r in got.items()}
    assert lm_score.score(df, wanted.limit(0)).count() == len(docs)


def test_counts_round_trip():
    a, b = np.array([0, 254, 255, 256, 10**12]), np.array([1, 2, 3, 4, 5])
    assert (lm_score.unpack_counts(lm_score.pack_counts(a, b), 5) == np.stack([a, b])).all()


def test_columns_are_bytes_and_null_is_empty():
    from leafline.llm import kernels

    data, off = kernels.column_bytes(pa.chunked_array([pa.array(["a", None]), pa.array(["bc"])]))
    assert data.tobytes() == b"abc" and off.tolist() == [0, 1, 1, 3]
