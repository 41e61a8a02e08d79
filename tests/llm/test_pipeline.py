import os
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import mixing, queries, quality, simhash, toxicity
from test_simhash import plain_components, plain_fingerprint

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(spark, stages):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == names for _, after in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "bpe"]


def test_classifier_stages_drop_what_the_scores_reject(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (before, after), (poor, good) = stages[:2]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(before, labels).collect()}
    assert set(ids(after)) == {d for d, s in scores.items() if s < 0.7}
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(poor, labels).collect()}
    assert set(ids(good)) == {d for d, s in scores.items() if s >= 0.3}
    assert sum(ids(good).values()) >= 0.6 * before.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    assert ids(after) == Counter(rows[k][0] for k, g in enumerate(groups) if k == g)


def test_mix_takes_what_its_plan_says(stages):
    before, after = stages[3]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sizes(before).where("size > 0").collect()}
    found = ids(after)
    assert {d: found.get(d, 0) for d in taken} == taken


def test_ids_are_the_librarys(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in random.Random(1).sample(rows, min(60, len(rows))):
        assert r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_gives_the_last_stages_rows(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == stages[-1][1].columns and ids(found) == ids(stages[-1][1])


ODD = ["`_mix_source`", "`_mix_plan`", "`_mix_copy`", "_gone", "kept", "row", "copies", "ticket", "target", "_score", "_row", "_source", "more", "_number", "_copy", "_kept", "cut"]


def test_stages_take_odd_rows_and_columns(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and columns named as the stages name their own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = " ".join(f"Some quiet words about garden number {k}." for k in range(40))
    rows = [(k, f"Document {k} tells of {k * 7} rivers, and of the light over them in the morning.", "en", f"s{k % 3}", 70) for k in range(80)]
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (200, None, "en", "s1", None), (200, "", None, "s1", 0), (201, plain * 1000, "en", "long", 1), (201, plain * 1000, "en", "long", 1)]
    rows += [(300, plain, "en", "s0", 3)] * 4 + [(None, plain, "en", "s0", 3)] * 2 + [(7, "w" * 700_000, "en", "s2", 700_000)]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *(f"{k} AS {c}" for k, c in enumerate(ODD)), "1 AS `a.b`", "2 AS `x y`")
    sizes, names = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"odd-{name}")
        sizes.append(docs.count())
        assert name == "bpe" or docs.columns == names
        if name == "simhash":
            texts = Counter(r["text"] or "" for r in docs.select("text").collect())
            assert max(texts.values()) == 1 and set(texts) <= {r[1] or "" for r in rows}
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5] > 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made = {len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert {r["n_tokens"] for r in docs.select("n_tokens").collect()} <= made


def test_an_empty_corpus_stays_empty(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_leaves_only_its_result(spark):
    from sparkloom.llm import common

    common.clear(spark)
    found = corpus_pipeline.run(spark, SF)
    assert common._tables(spark) == [found._sparkloom_path] and found.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run_whole(spark, name):
    df = queries.QUERIES[name](spark, SF)
    source = "embeddings" if name in ("op6_multi_index",) else "pages" if name.startswith("op3") else "documents"
    n = df.count()
    if name.startswith("op7"):
        assert n == 10 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count()
    elif name.startswith("op9"):
        assert n > 0
    else:
        assert n == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_simhash_stage_ignores_the_order_of_rows(spark, stages):
    before, after = stages[2]
    assert ids(simhash.keep_one(before.orderBy("text"))) == ids(after)
