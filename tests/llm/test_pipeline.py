"""The pipeline's stages on a small corpus, each against what it must drop and keep."""

import random
import zlib

import pytest

import corpus_pipeline
from tracewell.llm import queries
from tracewell.llm._common import fold

R = random.Random(12)
WORDS = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "pu", "sel") for b in ("nu", "ka", "so", "x", "rel", "dam", "ti", "vo")]


def prose(n):
    return " ".join(R.choice(WORDS) + R.choice([""] * 9 + ["."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    items = [(i, prose(30)) for i in range(10)]
    rows, toxic = [], set()
    for i in range(300):
        text = prose(120)
        if i % 5 == 0:
            text = "vile grot. " + text
            toxic.add(i)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    copies = [(400 + i, rows[2 + 5 * i][1], "de", "src0", 1) for i in range(8)]
    leaks = [(500 + i, prose(50) + " " + t + " " + prose(50), "en", None, 1) for i, t in items]
    odd = [(600, None, None, None, None), (601, "", "en", "src1", 0)]
    docs = spark.createDataFrame(rows + copies + leaks + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, toxic, {r[0] for r in copies}, {r[0] for r in leaks}


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_each_stage_drops_its_own_and_keeps_the_rest(spark, corpus):
    d, docs, toxic, copies, leaks = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "source_mix", "token_files"]
    everything = ids(docs)
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], (toxic, copies | {601}, leaks), strict=True):
        kept = stage(spark, docs, d)
        assert kept.columns == docs.columns
        assert everything - ids(kept) == gone, name
    kept = corpus_pipeline.mixed_sources(spark, docs, d)
    assert kept.columns == docs.columns and ids(kept) < everything


def test_run_returns_token_digests_of_what_is_kept(spark, corpus):
    d, docs, toxic, copies, leaks = corpus
    got = corpus_pipeline.run(spark, d).orderBy("start").collect()
    kept = {r.doc_id for r in got}
    assert kept and not kept & (toxic | leaks) and corpus_pipeline.ORACLE_SQL is None
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_folds_are_crc32_of_the_id_as_text(spark):
    rows = spark.range(200).select(fold("id", 3).alias("f"), "id").collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


@pytest.mark.parametrize("name,columns", [("op1_noisy_or_toxicity", "doc_id held_out score predicted"), ("op5_ppm_language", "doc_id held_out lang_pred score"), ("op3_huffman_token_files", "doc_id start n_tokens ids_crc32"), ("op8_simhash_near_dedup", "doc_id fingerprint component_id"), ("op9_personal_data", "doc_id n_email n_ip n_card n_phone base_sha256 spans")])
def test_queries_return_their_contract(spark, corpus, name, columns):
    d, docs, *_ = corpus
    got = queries.QUERIES[name](spark, d)
    assert got.columns[: len(columns.split())] == columns.split()
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())
