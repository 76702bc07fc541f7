"""Phrases, hard negatives and token counts: against plain Python and the tokenizers library."""

import glob
import math
import os
import random
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textwarden.llm import collocations, negatives, prefixes, queries


def brute_phrases(rows, least, longest=4, share=80, top=2000):
    lower = {i: i + 32 for i in range(65, 91)}
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    out = {}
    for (lang, phrase), a in f.items():
        if len(phrase) == 1 or a < least:
            continue
        if any(k[0] == lang and len(k[1]) > len(phrase) and c >= least and 100 * c >= share * a
               and any(k[1][i:i + len(phrase)] == phrase for i in range(len(k[1]))) for k, c in f.items() if c >= least):
            continue
        cuts = [(2000000 * a // (f[lang, phrase[:k]] + f[lang, phrase[k:]]), k, f[lang, phrase[:k]], f[lang, phrase[k:]])
                for k in range(1, len(phrase))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
            for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def got_phrases(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["An", "of", "the", "été", "x" * 300, "b-c", "日本", "\xa0", "d\x1f", "e", "f"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"])
                     for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "de", None])) for t in texts]
    return rows + [(None, "en"), ("", None), ("  ", "fr"), (".", None)] + [rows[0]] * 5 + [("of the an e " * 4000, "en")]


def docs_of(spark, rows):
    data = [(i % 7 or None, t, lang, "k", 1) for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, key string, part int").repartition(3)


@pytest.mark.parametrize("least, share, top", [(5, 80, 2000), (30, 80, 7), (3, 30, 40)])
def test_phrases_equal_brute_force(spark, prose, least, share, top):
    got = got_phrases(collocations.phrases(docs_of(spark, prose), least, share=share, top=top))
    assert got and got == brute_phrases(prose, least, share=share, top=top)


def test_phrases_when_every_fingerprint_collides(spark, prose, monkeypatch):
    rows = prose[:20]
    words = collocations.Words(np.frombuffer(b"a b c", np.uint8), np.array([0, 5]))
    assert len(words.start) == 3
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))  # equal under any polynomial modulo 2**64
    u = t.translate(str.maketrans("ab", "ba"))
    one, two = (collocations.Words(np.frombuffer(x.encode(), np.uint8), np.array([0, 2048])) for x in (t, u))
    assert one.hash[0] == two.hash[0]
    rows = rows + [(f"x {t} y {u}", "en")] * 6 + [(f"x {u} y {u}", "en")] * 4
    got = got_phrases(collocations.phrases(docs_of(spark, rows), 3))
    assert got == brute_phrases(rows, 3) and any(t in g[2] for g in got)


def test_phrases_of_nothing(spark):
    empty = docs_of(spark, [("a", "en")]).where("false")
    assert collocations.phrases(empty).collect() == []
    assert collocations.phrases(docs_of(spark, [(None, None), ("", "en")])).collect() == []


WORDS_PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "It's 'S ''s 'll'll 'r 're 'rex x've", "İstanbul ΑΣ ǅ ſK", "é ạ̈ ́x é<|endoftext|>́",
       "x<|endoftext|>y!<|startoftext|><|endoftext|>", "<|endoftext", "日本語テキスト　です x\x1cy\x85z", "🙂👩‍👧 x\x00y", "123 4½²x9",
       "ꟋᲉa \U00010D50 \U0001138Bb", "aaaa" * 300, "ab" * 2000 + " " + "!?" * 900, "<|startoftext|>" * 3 + "'s"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("abcdeth  '\n.,!éßasE12İΣreslvdmt<|>́　") for _ in range(rng.randrange(80))) for _ in range(150)]


def text_table(spark, texts):
    rows = [(i // 2 if i % 9 else None, t, i, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, counts long, n_bytes long").repartition(3)


def test_counts_of_every_prefix(spark, odd_texts):
    library = Tokenizer.from_file(WORDS_PATH)
    specials = ("<|startoftext|>", "<|endoftext|>")

    def composed(t):
        return "".join(x if x in specials else unicodedata.normalize("NFC", x)
                       for x in re.split("(" + "|".join(map(re.escape, specials)) + ")", t))

    def library_counts(t):
        t = composed(t or "")
        return [len(e.ids) for e in library.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)]

    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.counts)
                 for r in prefixes.prefix_counts(text_table(spark, odd_texts), WORDS_PATH).collect())
    assert got == sorted((i // 2 if i % 9 else -1, len((t or "").encode()), library_counts(t)) for i, t in enumerate(odd_texts))


def test_token_counts_and_budgets(spark, odd_texts):
    library = Tokenizer.from_file(WORDS_PATH)
    docs = text_table(spark, odd_texts)
    full = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in odd_texts)
    rows = prefixes.report(docs, WORDS_PATH, limit=20).collect()
    assert sorted(r.n_tokens for r in rows) == full and all(r.over_limit == (r.n_tokens > 20) for r in rows)
    cut = prefixes.prefix_counts(docs, WORDS_PATH).select(
        "counts", prefixes.longest_prefix(F.col("counts"), 7).alias("cut"), prefixes.tokens_at(F.col("counts"), 3).alias("three")).collect()
    for r in cut:
        assert r.cut == max(i for i, c in enumerate(r.counts) if c <= 7)
        assert r.three == (r.counts[3] if len(r.counts) > 3 else None)
    assert prefixes.report(docs.where("false"), WORDS_PATH).collect() == []


def test_all_classes_and_cases_are_the_library_s():
    library, words = Tokenizer.from_file(WORDS_PATH), prefixes.vocabulary(WORDS_PATH)
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    runs = [unicodedata.normalize("NFC", t) for t in texts]
    counts, bounds = prefixes._counted(words, runs)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts[bounds[1:] - 1].tolist() == want


def brute_negatives(rows, every, positives=5, negatives=5, low=80):
    """`rows`: (vec_id, label, numbers) that take part."""
    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    def order(x):
        return -x[0], x[1] is None, x[1]

    out = []
    for i, (vec, label, numbers) in enumerate(rows):
        if vec is None or vec % every:
            continue
        scored = [(score(numbers, r[2]), r[0], r[1]) for j, r in enumerate(rows) if j != i]
        for s, p, _ in sorted((x for x in scored if x[2] == label), key=order)[:positives]:
            fits = sorted((x for x in scored if x[2] != label and low * s <= 100 * x[0] <= 100 * s), key=order)
            out += [(vec, p, rank, n, s, t) for rank, (t, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out, key=repr)


def mined(df, anchor, **how):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in names) for r in negatives.mine(negatives.quantised(df), anchor, **how).collect()), key=repr)


@pytest.mark.parametrize("wide, sizes", [(3, [10]), (0.2, [64]), (900.0, [3, 17, 0, 9])])
def test_negatives_equal_brute_force(spark, monkeypatch, wide, sizes):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2]),
             [rng.choice([0.5, -0.25, rng.uniform(-wide, wide)]) for _ in range(rng.choice(sizes))]) for _ in range(150)]
    rows += [rows[3]] * 4 + [(0, 1, rows[0][2])] * 9 + [(10, 1, None), (20, None, [1.0])]
    rows += [(5, 1, [float("nan")]), (6, 2, [float("inf"), 0.0]), (7, 0, [None, 1.0])]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows],
                               "vec_id long, label int, embedding array<double>, key string, p int").repartition(3)
    ok = [(v, lab, [math.floor(256 * x) for x in e]) for v, lab, e in rows if lab is not None and e is not None
          and all(x is not None and math.isfinite(x) for x in e)]
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 4)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    want = brute_negatives(ok, 5)
    assert want and mined(df, "vec_id % 5 = 0") == want
    assert mined(df.where("false"), "vec_id % 5 = 0") == []


def test_negatives_refuse_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, 1, [1e16] * 9), (1, 1, [1e16] * 9)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        mined(df, "vec_id = 0")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = sorted((tuple(r[order.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
