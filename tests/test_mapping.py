import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import mapping
from millrace.sources import dataset, jsonl


def rows(spark, path, *records):
    path.write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")
    return dataset.load(spark, str(path)).df.orderBy("_pos").collect()


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ({"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do\nthis", "response": "done"}),
        ({"instruction": "do", "input": "", "output": "done"}, {"instruction": "do", "response": "done"}),
        ({"prompt": "q", "chosen": "a", "rejected": "b"}, {"instruction": "q", "chosen": "a", "rejected": "b"}),
        ({"question": "q", "answer": "a"}, {"instruction": "q", "response": "a"}),
        ({"text": "t", "domain": "d"}, {"text": "t", "domain": "d"}),
        ({"query": "q", "completion": "c"}, {"instruction": "q", "response": "c"}),
    ],
)
def test_layouts(spark, tmp_path, record, want):
    (row,) = rows(spark, tmp_path / "in.jsonl", record)
    assert {k: row[k] for k in want} == want


def test_chats(spark, tmp_path):
    (a,) = rows(spark, tmp_path / "a.jsonl", {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}, {"from": "system"}]})
    assert [(t.role, t.content) for t in a.turns] == [("user", "hi"), ("assistant", "yo"), ("system", "")]
    (b,) = rows(spark, tmp_path / "b.jsonl", {"messages": [{"role": "user", "content": "hi"}]})
    assert [(t.role, t.content) for t in b.turns] == [("user", "hi")]


def test_info_and_rest(spark, tmp_path):
    (row,) = rows(spark, tmp_path / "in.jsonl", {"question": "q", "info": {"n": 3}, "more": "x"})
    assert json.loads(row.info) == {"n": 3}
    assert json.loads(row.extra) == {"more": "x"}


def test_user_map_wins_and_disables_layout(spark):
    df = spark.createDataFrame([("a", "b", "c", 0)], "question string, answer string, mine string, _pos bigint")
    (row,) = mapping.map_columns(df, {"mine": "instruction"}).collect()
    assert (row.instruction, row.response) == ("c", "b")


def test_malformed_line_is_numbered(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('{"text": "a"}\n\n{oops\n')
    with pytest.raises(jsonl.MalformedLine, match=":3"):
        jsonl.read_jsonl(spark, str(p))


def test_export_is_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([("q", "long enough answer", 0), ("q", "short", 1), (None, "long enough answer", 2)], "instruction string, response string, _pos bigint")
    samples = mapping.map_columns(df)
    with pytest.raises(mapping.ExportError) as e:
        mapping.export(samples, "sft")
    assert e.value.total == 2 and len(e.value.messages) == 2
    out = mapping.export(samples.filter("_pos = 0"), "sft", {"response": "answer"})
    assert out.columns == ["_pos", "instruction", "answer", "system_prompt"]
    with pytest.raises(ValueError):
        mapping.export(samples, "no such layout")


def test_round_trip(spark, tmp_path):
    src, out = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    src.write_text("\n".join(json.dumps({"instruction": f"i{k}", "input": "", "output": "x" * 10}) for k in range(5)))
    assert dataset.convert(spark, str(src), str(out), "sft") == 5
    back = dataset.Dataset.from_jsonl(spark, str(out))
    assert [r.instruction for r in back] == [f"i{k}" for k in range(5)]
    assert back.validate("sft")["passed"] == 5
    assert back.inspect()["fields"]["response"] == 5


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 1), ('c,"d', 2)], "t string, n int")
    for kind in ("csv", "tsv", "parquet", "json", "orc"):
        path = str(tmp_path / f"x.{kind}")
        jsonl.write(df, path)
        assert {(r.t, int(r.n)) for r in jsonl.read(spark, path).collect()} == {("a\tb", 1), ('c,"d', 2)}
    assert jsonl.write_jsonl(df, str(tmp_path / "y.jsonl")) == 2


def test_corpus(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("one\n\n two \nthree\n")
    assert [r.text for r in jsonl.corpus(spark, str(p)).orderBy("_pos").collect()] == ["one", "two", "three"]
    assert jsonl.corpus(spark, str(p), most=2).count() == 2
    with pytest.raises(ValueError):
        jsonl.corpus(spark, str(tmp_path / "c.doc"))


def test_null_and_empty_table(spark):
    df = spark.createDataFrame([], "text string, _pos bigint")
    assert mapping.map_columns(df).count() == 0
    one = spark.createDataFrame([(None, 0)], "text string, _pos bigint")
    assert mapping.map_columns(one).select(mapping.failure("pretrain").alias("w")).first().w == "no text"
    assert mapping.project(mapping.map_columns(one), "pretrain").select(F.count("*")).first()[0] == 0
