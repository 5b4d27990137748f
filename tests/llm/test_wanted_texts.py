"""Texts are not shuffled to find the wanted ones."""

from pyspark.sql import functions as F

from gridlume.llm import near_dedup
from gridlume.operators.lineage import stage


def test_texts_of_wanted_documents_are_found_in_place(spark, monkeypatch):
    docs = stage(spark.range(20_000).select((F.col("id") * 7 - 9000).alias("doc_id"), F.concat_ws(" ", *[F.lit(w) for w in "abcdef"], "id").alias("text")), "texts")
    wanted = stage(docs.where("doc_id % 5 = 0").select("doc_id"), "wanted")
    for most, others in ((1 << 19, 2_500), (16, 20_000)):
        monkeypatch.setattr(near_dedup, "MOST_WORDS", most)
        found = near_dedup.sifted(docs, wanted)
        assert found.join(wanted, "doc_id").count() == wanted.count() == 4_000 <= found.count() <= 4_000 + others
    assert near_dedup.sifted(docs, wanted.limit(0)).count() == 0


def test_many_wanted_ids_do_not_shuffle_texts(spark):
    docs = stage(spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")), "texts")
    wanted = stage(docs.where("doc_id % 2 = 0").select("doc_id"), "wanted")
    plan = near_dedup.full_sets(docs, wanted)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
