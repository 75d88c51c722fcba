import json
import random

import pytest

from lodestone.sources import json_array as J


def values(seed, n):
    rng = random.Random(seed)
    bits = ['"', "\\", "[", "]", "{", "}", ",", ":", "é", "\U0001f600", "a", " ", "\n", "\\\\", '\\"']

    def some(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind == 0:
            return "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        if kind == 1:
            return rng.choice([1, -2.5, True, None, 0])
        if kind == 2:
            return {"text": "".join(rng.choice(bits) for _ in range(rng.randrange(20)))}
        if kind < 5:
            return [some(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(bits) + str(k): some(depth - 1) for k in range(rng.randrange(3))}

    return [some(3) for _ in range(n)]


def read(path, split):
    ranges = J.cut_up(path, split)
    found = [J.summary(*J.read_range(*J.open_store(p), a, z)) for p, a, z, _ in ranges]
    return [json.loads(x) for r in J.begun(ranges, found) for x in J.elements(r, chunk=7)]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 1 << 20])
def test_every_split_gives_a_plain_parse(tmp_path, split):
    for seed in range(12 if split > 3 else 5):
        want = values(seed, 25)
        for k, text in enumerate((json.dumps(want), json.dumps(want, indent=2, ensure_ascii=False), " \n" + json.dumps(want, ensure_ascii=False) + "\n ")):
            (tmp_path / f"{seed}-{k}.json").write_text(text, encoding="utf-8")
            assert read(str(tmp_path / f"{seed}-{k}.json"), split) == want
    (tmp_path / "none.json").write_text(" [ \n ] ")
    assert read(str(tmp_path / "none.json"), split) == []


BAD = ["", "  ", "{}", '"a"', "1", "[1", "[1,", "[1,]", "[,1]", "[1,,2]", "[1] 2", "[1][2]", "[1]]", '["a', '["a]', "[1 2]", "[{]", '[{"a":1]', "[}", "[1}", "[tru]", "x[1]", "[1],", '[{"a" 1}]', "[{},]", '["\\"]', "]", "[[1]"]


@pytest.mark.parametrize("text", BAD)
@pytest.mark.parametrize("split", [1, 3, 100])
def test_what_is_no_array_is_an_error(tmp_path, text, split):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError):
        read(str(tmp_path / "x.json"), split)


def test_many_tasks_read_one_file(spark, tmp_path):
    rows = [{"id": str(i), "note": 'quote " slash \\ brackets ]}[{ , ' * (i % 5), "turns": [{"n": k, "t": "x" * k} for k in range(i % 7)]} for i in range(2000)]
    path = tmp_path / "in" / "big.json"
    path.parent.mkdir()
    path.write_text(json.dumps(rows, indent=1))
    schema = "id string, note string, turns array<struct<n:int,t:string>>"
    df = J.read_json_array(spark, str(path), schema, split=20_000)
    tasks = J.read_elements(spark, str(path), split=20_000)
    assert tasks.rdd.getNumPartitions() == -(-path.stat().st_size // 20_000) > 10
    got = sorted(df.collect(), key=lambda r: int(r["id"]))
    assert [r.asDict(recursive=True) for r in got] == rows
    # The data source by itself, over a folder of two files.
    (tmp_path / "in" / "more.json").write_text('[{"id": "x"}]')
    (tmp_path / "in" / "_hidden").write_text("no array")
    J.register(spark)
    own = spark.read.format("json_array").option("split", 5000).load(str(tmp_path / "in"))
    assert own.count() == 2001


def test_records_that_do_not_fit_their_schema(spark, tmp_path):
    for k, text in enumerate(('[{"id": 1}, 2]', '[{"id": {"a": 1}}]')):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(Exception):
            J.read_json_array(spark, str(tmp_path / f"{k}.json"), "id int").collect()
