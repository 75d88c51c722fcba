import random

import corpus_pipeline
from lodestone.llm import decontam, mixing, queries, secret_scan, simhash


def test_stages_on_a_small_corpus(spark, docs_of, tmp_path):
    rng = random.Random(8)
    syllables = ["the", "an", "er", "on", "re", "ing", "st"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(i, prose(20)) for i in range(3)]
    rows, labels = [], []
    for i in range(150):
        t = prose(60)
        if i % 5 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 31 == 1:
            t = rows[i - 1][1] if i % 5 != 1 else t
        if i in (7, 13):
            t = t + " " + items[i % 3][1]
        if i == 23:
            t = t + " password: hunter222"
        rows.append((i, t, "en", f"s{i % 3}"))
        labels.append((i, int(i % 5 != 0), 0))
    rows.append((200, rows[23][1], "en", "s1"))
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    good = {i for i in range(150) if i % 5}
    assert 7 not in out and 13 not in out and 200 not in out and 23 in out
    assert len(good & set(out)) >= len(good) - 8 and len(set(out) - good) <= 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]
    # The same stages by hand, each on all that its predecessor kept.
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, d)
    assert kept.columns == docs.columns
    rest = secret_scan.redact(decontam.decontaminate(simhash.one_of_each(kept), spark.read.parquet(f"{d}/benchmark.parquet")))
    by_hand = {r["doc_id"]: r["taken"] for r in mixing.mix(rest).collect()}
    assert by_hand == {k: r["taken"] for k, r in out.items()}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
