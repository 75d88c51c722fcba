from lodestone.operators import path_groups as P

MATERIAL = (
    "query_id long, root_rn int, root string, members array<string>, edges array<struct<src:string,dst:string,relation:string,sources:array<string>>>, "
    "cards array<struct<p:int,ref:string,kind:string,status:string,sources:array<string>>>, sources array<string>, "
    "fragments array<struct<cited:boolean,p:int,start:long,end:long,origin:string,length:long,text:string>>"
)


def test_queries_are_packed_in_batches(spark):
    rows = [(q, rn, f"r{rn}", [f"r{rn}"], [], [(0, f"r{rn}", "fact", "active", [])], [], [(False, 0, 0, 4, f"r{rn}", 4, "text")]) for q in range(600) for rn in (2, 1)]
    out = P.pack_groups(spark.createDataFrame(rows, MATERIAL), top_k=1)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["query_id"], r["root"]): (r["rn"], r["reason"], r["n_fragments"]) for r in out.collect()}
    assert got == {(q, f"r{rn}"): (1, "packed", 1) if rn == 1 else (None, "top_k", 0) for q in range(600) for rn in (1, 2)}
