"""The stages of the corpus pipeline, one by one and together."""

import random

import pytest

import corpus_pipeline
from textwarden.llm import simhash, toxicity

SF = "/root/testdata/sf0.001"
NAMES = "_doc _key _hash score fp root key block row tie".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    said = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120)))) for i in range(40)]
    rows += [(100, None), (101, None), (None, None), (None, "only one of its kind, without an id"), (102, ""), (103, "  \n")]
    rows += [(104, said), (105, said), (105, said), (106, said + " and another end"), (106, "another text under the same id")]
    rows += [(107, "password = hunter2hunter2 " + said), (108, "é" * 3000 + " long " * 5000), (109, "x")]
    full = [(i, t, "en", "web", len(t or ""), *range(len(NAMES))) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{n} int" for n in NAMES)).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_an_empty_table(spark, docs, name):
    out = stage(name)(spark, docs.where("false"), SF)
    assert out.collect() == []
    if name != "packed":
        assert out.columns == docs.columns


def test_toxicity_stage_drops_what_it_predicts_and_nothing_else(spark, docs):
    out = stage("toxicity")(spark, docs, SF)
    scorer = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert plain(out) == sorted(repr(r) for r in docs.collect() if scorer is None or scorer.score(r.text or "") < 0.5)


def test_near_duplicates_stage_keeps_one_row_of_each_component(spark, docs):
    out = stage("near_duplicates")(spark, docs, SF)
    assert out.columns == docs.columns
    parts = {}
    texts = docs.select("text").distinct().selectExpr("xxhash64(coalesce(text, '')) AS doc_id", "text")
    for r in simhash.near_duplicates(texts).join(texts, "doc_id").collect():
        parts[r.text or ""] = r.component_id
    kept = [parts[r.text or ""] for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == set(parts.values())
    everyone = set(plain(docs))
    assert set(plain(out)) <= everyone
    assert sorted(r.doc_id for r in out.where("doc_id BETWEEN 0 AND 39").collect()) == list(range(40))


def test_repeats_stage_keeps_rows_and_columns(spark, docs):
    out = stage("repeated_passages")(spark, docs, SF)
    rows = {r.doc_id: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert out.columns == docs.columns and 104 in rows and rows[100].text is None and rows[102].text == ""
    assert 106 in rows and out.where("doc_id IS NULL").count() == 2 and rows[109].key == NAMES.index("key")
    assert rows[108].text.startswith("é") and len(rows[108].text) < 3000 + 30000


def test_secrets_stage_masks_and_keeps_all(spark, docs):
    out = stage("secret_scan")(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    before = {r for r in plain(docs) if "hunter2" not in r}
    assert before <= set(plain(out)) and not any("hunter2hunter2" in r for r in plain(out))


def test_packed_stage_places_every_piece(spark, docs):
    by_sequence = {}
    for r in stage("packed")(spark, docs, SF).collect():
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 1024


def test_run_is_its_stages_one_after_another(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert 0 < len(pieces) < len(docs) and set(pieces) <= docs
    for own in pieces.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]
