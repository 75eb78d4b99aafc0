"""The corpus pipeline, stage by stage, and the driver's contract."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from compare import difference, duck
from voltide.llm.fair_mix import word_count

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, made[-1], SF)
        made.append(spark.createDataFrame(out.collect(), out.schema))
    _, good, single, apart, mix, encoded = made
    assert all(x.columns == docs.columns for x in made[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.join(labels.where("quality = 1"), "doc_id").count() > 0.95 * docs.join(labels.where("quality = 1"), "doc_id").count()
    assert single.count() == good.select("text").distinct().count() and single.subtract(good).count() == 0
    assert apart.subtract(single).count() == 0 and 0 < single.count() - apart.count() < 20
    words = apart.select(F.sum(word_count(F.col("text")))).first()[0]
    assert abs(mix.select(F.sum(word_count(F.col("text")))).first()[0] - 1.5 * words) < 25
    assert mix.where("n_chars <> length(text)").join(docs.where("n_chars = length(text)"), "doc_id").count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECES))
    assert sorted(r.ids for r in encoded.collect()) == sorted(map(library.encode, (r.text for r in mix.collect())))


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF)
        assert out.count() <= 2 * odd_docs.count(), name
        assert name == "encoding" or out.columns == odd_docs.columns
        assert stage(spark, no_docs, SF).count() == 0


@pytest.mark.parametrize("name", [n for n in contract.oracle_sql() if n.startswith("op")])
def test_matches_sql(spark, name):
    assert difference(contract.queries()[name](spark, SF).toPandas(), duck(SF).execute(contract.oracle_sql()[name]).df()) is None


def test_one_query_per_operator():
    from voltide.llm.queries import QUERIES

    assert [n.split("_")[0] for n in QUERIES if n != "pipeline"] == [f"op{k}" for k in range(1, 14)]
