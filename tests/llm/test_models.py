"""Learned operators by held-out accuracy, and the pipeline against a plain version."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import bpe, jaccard, language, secrets, toxicity

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "the ing and ion her", "ab": "the ing ander ion ster", "ba": "que eau ment les ier", "bb": "que osa mente los ierra"}
INSULTS = ["grobian", "schuft", "canaille"]


def made(seed, n, toxic_share=0.15):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))]
        toxic = rng.random() < toxic_share
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        text = " ".join(words)
        rows.append((i, text, lang, "s", len(text)))
        if i % 2:
            labels.append((i, 1, int(toxic), "x"))
    return rows, labels


ODD = [(9001, None, None, None, None), (9002, "", "aa", "s", 0), (9003, "123 !!", "aa", "s", 6), (9004, "the ing and " * 20_000, "aa", "s", 240_000)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = made(1, 700)
    extra = [(9001, 0, None, "x"), (9002, 0, 0, "x"), (99_999, 0, 1, "x")]
    docs = spark.createDataFrame(rows + ODD + [rows[0]], SHAPE)
    return rows, labels, docs, spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int, text string")


def test_toxicity_of_held_out_rows(corpus):
    rows, labels, docs, table = corpus
    got = toxicity.judged(docs, table).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    truth = {i: t for i, _, t, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got)
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in held) <= 0.05 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (9001, 9002, 9003))


def test_toxicity_of_empty_tables(corpus):
    _, _, docs, table = corpus
    assert toxicity.judged(docs.limit(0), table).count() == 0
    none = toxicity.judged(docs, table.limit(0)).collect()
    assert len(none) == docs.count() and not any(r["predicted"] for r in none)


def test_risk_is_held_above_zero():
    rng = np.random.default_rng(0)
    p = (rng.random((200, 12)) < np.r_[[0.9] * 4, [0.3] * 8]).astype(np.float32)
    n = (rng.random((800, 12)) < np.r_[[0.05] * 4, [0.3] * 8]).astype(np.float32)
    w, b = toxicity.fit_nnpu(p[:100], np.vstack([p[100:], n]), 0.11)
    assert ((p @ w + b) > 0).mean() > 0.9 and ((n @ w + b) > 0).mean() < 0.05


def test_language_of_held_out_rows(corpus):
    rows, _, docs, _ = corpus
    got = language.predicted(docs).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] > 9000}
    assert odd[9001] == odd[9002] == odd[9003] == ("und", 0.0) and odd[9004][0] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_families_hold_close_relatives(corpus):
    model = language.train(corpus[2])
    families = {frozenset(model.languages[k] for k in f) for f in model.families}
    assert families == {frozenset(("aa", "ab")), frozenset(("ba", "bb"))}


def test_language_without_examples(corpus, spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3)], SHAPE)
    assert [(r["lang_pred"], r["score"]) for r in language.predicted(docs).collect()] == [("und", 0.0)]
    assert language.predicted(corpus[2].limit(0)).count() == 0
    one = spark.createDataFrame([(k, "abc abc", "xx", "s", 7) for k in range(20)], SHAPE)
    assert {r["lang_pred"] for r in language.predicted(one).collect()} == {"xx"}


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    import corpus_pipeline as pipeline
    import public_tokenizers

    rows, labels = made(4, 700)
    key = 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'
    clean = next(r for r in rows if not any(w in r[1] for w in INSULTS))
    copies = [(5000 + k, clean[1] + " theing" * (k % 2), "aa", "s", 1) for k in range(6)]
    rows += copies + [(6000, "the ing and " * 9 + key, "aa", "s", 1), (6001, None, None, None, None), (6002, "", None, None, 0), (6003, "42", "aa", "s", 2)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], str(tmp_path)))
        assert kept[-1].schema.simpleString() == docs.schema.simpleString()
    ids = [{r["doc_id"] for r in d.collect()} for d in kept]
    insulted = {r[0] for r in rows if any(w in (r[1] or "") for w in INSULTS)}
    assert len(insulted & ids[1]) <= 0.1 * len(insulted) and len((ids[0] - ids[1]) - insulted) <= 3
    assert ids[1] - ids[2] == {6001, 6002, 6003} & ids[1]
    text = {r[0]: r[1] for r in rows}
    sets = {i: frozenset(zip(*(text[i].split()[k:] for k in range(5)))) or frozenset([text[i]]) for i in ids[2]}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    first = {}
    for i in sorted(ids[2]):
        first[i] = min((first[j] for j in first if near(sets[i], sets[j])), default=i)
    assert ids[3] == {i for i in ids[2] if first[i] == i}
    masked = {r["doc_id"]: r for r in kept[4].collect()}
    assert masked[6000]["text"] == "the ing and " * 9 + '[secret]"' and masked[6000]["n_chars"] == len(masked[6000]["text"])
    assert all(masked[i]["text"] == text[i] for i in ids[3] if i != 6000)
    own = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    found = pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in found:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {i: len(own.encode(masked[i]["text"])) // 4 + 1 for i in ids[4]}
    assert secrets.base_spans(masked[6000]["text"]) == [] and jaccard.first_shingles(1, 80) == 1


def test_language_stage_without_languages(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "ein Text", None, "s", 8), (2, "42 !", None, "s", 4), (3, None, None, "s", None), (4, "я", None, "s", 1)], SHAPE)
    assert {r["doc_id"] for r in pipeline.languages(spark, docs, "").collect()} == {1, 4}
    unlabelled = spark.createDataFrame([(1, "ein Text", None, "s", 8), (2, "42 !", "aa", "s", 4)], SHAPE)
    assert {r["doc_id"] for r in pipeline.languages(spark, unlabelled, "").collect()} == {1}


@pytest.mark.parametrize("known", [["aa"], ["aa", "ab"], ["aa", "ab", "ba"], ["aa", "ab", "ba", "bb"]])
def test_language_stage_rejects_by_the_machines(spark, known):
    import corpus_pipeline as pipeline

    rows = [r for r in made(1, 700)[0] if r[2] in known]
    odd = ["1234 5678 !!! ### a 99 " * 5, "x = 3; y = 4; z = [1,2,3]; " * 5, "aaaaaaaaaaaa " * 20, "日本語の文章です。これは学習に含まれない言語です。" * 4]
    mixed = rows[0][1] + " " + next(r[1] for r in rows if r[2] == known[-1])
    docs = spark.createDataFrame(rows + [(9000 + k, x, None, "s", len(x)) for k, x in enumerate(odd)] + [(9100, mixed, None, "s", 1), (9101, "ion her", None, "s", 7)], SHAPE)
    assert {r["doc_id"] for r in pipeline.languages(spark, docs, "").collect()} == {r[0] for r in rows} | {9100, 9101}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
