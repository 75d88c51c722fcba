import duckdb

from lodestone.plans import registry


def test_scores_equal_to_six_digits_are_ranked_by_recency(spark, tmp_path):
    docs = [(i, "common " + "filler " * (2000 + i % 2)) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "common ground")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.QUERIES["fulltext_match"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted((r["item_id"], r["doc_id"], r["rn"]) for r in got) == sorted(con.execute(registry.ORACLES["fulltext_match"]).fetchall())
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rn"])] == list(range(399, 369, -1))
