import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["lexical_search_gen1", "evidence_ranks", "duplicate_rate", "lexical_study_by_type", "retrieval_metrics", "retrieval_metrics_macro", "search_pipeline"])
def test_texts_of_the_few_found_are_not_shuffled(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(60 << 10))  # above the found, below the documents and their postings
    try:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = [line for line in plan.splitlines() if "Join" in line]
    assert above and not any("SortMergeJoin" in line and "doc_id" in line for line in above)
