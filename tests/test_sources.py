import json

import pytest
from pyspark.sql import functions as F

from evalscale.functions import ingest as N
from evalscale.sources import logs, raw
from evalscale.streaming import incremental


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


CANDIDATE = {
    "run_id": "r", "example_id": "e", "model": "m", "method": "x", "n": "4", "sample_index": 0, "extracted_answer": None, "token_count": "7", "latency_s": 0.5,
    "metadata": {"dataset": "d", "gold_answer": "1", "answer_type": "number", "choices": ["a"], "nested": True, "backend_metadata": {"finish_reason": "length"}},
}


def test_candidates_take_numbers_and_texts_alike(spark, tmp_path):
    write(tmp_path / "run" / "candidates.jsonl", CANDIDATE, "", CANDIDATE | {"n": 0, "token_count": None, "sample_index": 1, "dataset": "top"})
    a, b = logs.read_candidates(spark, [tmp_path / "run", tmp_path / "run"]).orderBy("ord").collect()
    assert (a.dataset, a.n, a.token_count, a.extracted_answer, a.finish_reason, a.nested, a.choices, a.ord) == ("d", 4, 7, "", "length", True, ["a"], 0)
    assert (b.dataset, b.n, b.token_count, b.ord) == ("top", 1, 0, 2)


def test_bad_lines(spark, tmp_path):
    write(tmp_path / "run" / "selections.jsonl", {"example_id": "e", "is_correct": "false"}, '{"example_id": "f", "is_corr')
    rows = logs.read_selections(spark, [tmp_path / "run"], strict=False).collect()
    assert [(r.example_id, r.is_correct, r.n) for r in rows] == [("e", False, 1)]
    with pytest.raises(Exception, match="line 2"):
        logs.read_selections(spark, [tmp_path / "run"]).collect()


def test_run_discovery(spark, tmp_path):
    for name in ("good", "_smoke", "my_smoke_1", "synthetic_e2", "_hidden", "no_manifest", "empty"):
        write(tmp_path / name / "candidates.jsonl", *([] if name == "empty" else [{}]))
        if name != "no_manifest":
            write(tmp_path / name / "manifest.json", {})
    assert [p.name for p in logs.find_runs(tmp_path)] == ["good"]
    assert [p.name for p in logs.find_runs(tmp_path, need_manifest=False, hidden=True)] == ["_hidden", "good", "no_manifest"]
    assert logs.find_runs(tmp_path / "nowhere") == [] and logs.find_runs(tmp_path, need_selections=True) == [] and logs.find_runs(tmp_path, exclude=["good"]) == []
    there = f"file://{tmp_path}"
    assert [e.name for e in logs.find_runs(there)] == ["good"] and [e.name for e in logs.find_runs(there, need_manifest=False, hidden=True)] == ["_hidden", "good", "no_manifest"]
    assert logs.find_runs(f"{there}/nowhere") == [] and logs.find_runs(there, need_selections=True) == []
    by_uri, by_path = (sorted(map(str, logs.read_candidates(spark, logs.find_runs(x)).collect())) for x in (there, tmp_path))
    assert by_uri == by_path == sorted(map(str, logs.read_candidates(spark, [f"{there}/good/", f"{there}/good", f"{there}/none"]).collect()))


def test_examples(spark, tmp_path):
    path = write(tmp_path / "afrimgsm" / "test.jsonl", {"question": " a? ", "answer_type": "number", "gold_answer": " 1 "}, {"id": "x", "question": "b?", "choices": ["p", "q"], "task": "t", "source_dataset": "s"}, {"question": "c?"})
    a, b = logs.read_examples(spark, path, dataset="ds", limit=2).orderBy("row_number").collect()
    assert (a.id, a.task, a.question, a.gold_answer, a.choices, a.source_dataset) == ("ds_test_000001", "math", "a?", "1", None, "ds")
    assert (b.id, b.task, b.choices, b.answer_type, b.source_dataset) == ("x", "t", ["p", "q"], "text", "s")
    assert logs.read_examples(spark, path).first().source_dataset == "afrimgsm"
    with pytest.raises(Exception, match="no question"):
        logs.read_examples(spark, write(tmp_path / "bad.jsonl", {"question": " "})).collect()
    with pytest.raises(Exception, match="answer_type"):
        logs.read_examples(spark, write(tmp_path / "bad2.jsonl", {"question": "q", "answer_type": "odd"})).collect()


def test_csv_and_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", ["x", "y"], None, True), ('q"', [], 1.5, False)], "name string, runs array<string>, rate double, ok boolean")
    logs.write_csv(rows, tmp_path / "m.csv")
    assert (tmp_path / "m.csv").read_text() == 'name,runs,rate,ok\n"a,b",x;y,,true\n"q""",,1.5,false\n'
    logs.write_csv(rows.limit(0), tmp_path / "none.csv")
    assert (tmp_path / "none.csv").read_text() == ""
    logs.write_jsonl(rows.limit(1), str(tmp_path / "out"))
    line = next((tmp_path / "out").glob("part-*")).read_text().strip()
    assert line == '{"name":"a,b","ok":true,"rate":null,"runs":["x","y"]}'
    logs.write_json({"b": 1, "a": "ọ"}, tmp_path / "r" / "x.json")
    assert (tmp_path / "r" / "x.json").read_text() == '{\n  "a": "ọ",\n  "b": 1\n}\n'
    logs.write_splits(rows, str(tmp_path / "split"), "ok")
    assert spark.read.json(str(tmp_path / "split")).count() == 2 and (tmp_path / "split" / "ok=true").is_dir()


def test_metrics_report(spark, tmp_path):
    row = {"dataset": "d", "model": "m", "method": "x", "n": 4, "total_examples": 10, "select_correct": 5, "accuracy": 0.9}
    for found in ([row], {"conditions": [row]}):
        (tmp_path / "m.json").write_text(json.dumps(found))
        r = logs.read_metrics(spark, str(tmp_path / "m.json")).first()
        assert (r.n, r.total_examples, r.select_correct, r.total_tokens) == (4, 10, 5, 0)


def test_raw_formats(spark, tmp_path):
    tsv, csv, jsonl = tmp_path / "a.tsv", tmp_path / "a.csv", tmp_path / "a.json"
    tsv.write_text("﻿question\tanswer_number\tanswer\nq1\t5\tx\nq2\t\t7\nq3\t0\t\n", encoding="utf-8")
    csv.write_text('story,question,options_A,option_B,Answer\n"one\ntwo",q,yes,no,0\n', encoding="utf-8")
    jsonl.write_text('{"question": "q", "answers": "[\'a\', \'b\']", "id": 3}\n', encoding="utf-8")
    items = raw.normalize(raw.read_raw(spark, str(tsv)), raw.SOURCES["afrimgsm"], "test")
    assert [(r.question, r.gold_answer, r.answer_type) for r in raw.retained(items).orderBy("question").collect()] == [("q1", "5", "number"), ("q2", "7", "number")]
    assert raw.split_counts(items).first() == ("test", 3, 2, 1)
    assert raw.compact(items).columns == ["answer_type", "choices", "gold_answer", "question"]
    r = raw.retained(raw.normalize(raw.read_raw(spark, str(csv)), raw.SOURCES["naijarc"], "dev")).first()
    assert (r.choices, r.gold_answer, r.task) == (["A. yes", "B. no"], "A", "reading_comprehension") and "one\ntwo" in r.question
    r = raw.retained(raw.normalize(raw.read_raw(spark, str(jsonl)), raw.SOURCES["afriqa"], "train")).first()
    assert (r.id, r.gold_answer) == ("afriqa_train_3", "a")
    with pytest.raises(ValueError):
        raw.read_raw(spark, "x.xml")
    with pytest.raises(ValueError):
        raw.source("afriqa", ["dev"])
    with pytest.raises(ValueError):
        raw.source("nothing")


def test_generic_records(spark):
    generic = raw.Source("own", "generic", "g", ("test",))
    rows = raw.records(spark, [{"query": "q", "target": "t", "options": "a || b", "lang": "yo", "extra": 1}, {"query": "q2", "target": "t", "options": None, "lang": "en", "extra": None}])
    items = raw.normalize(rows, generic, "test").orderBy("question").collect()
    assert (items[0].question, items[0].gold_answer, items[0].choices, items[0].error, items[0].metadata.rest) == ("q", "t", ["a", "b"], None, {"extra": "1", "lang": "yo"})
    assert items[1].error == "language" and items[0].id != items[1].id and items[0].id.startswith("own_")


@pytest.mark.parametrize("text, want", [("['a', \"b\"]", ["a", "b"]), ("[1, None]", ["1", "None"]), ("[broken", ["[broken"]), ("[bro]", ["[bro]"]), (" x || ||y ", ["x", "y"]), ("", None), (None, None), ("[__import__('os')]", ["[__import__('os')]"]), ("[]", []), ("[ 'a' , ]", ["a"]), (r"['it\'s', 1.50, True]", ["it's", "1.5", "True"]), ("['a' 'b', [1]]", ["ab", "[1]"]), ("[01]", ["[01]"]), ("['a', -7, \"\"]", ["a", "-7", ""]), ("[" + "'x'," * 3000 + "]", ["x"] * 3000)])
def test_choices(spark, text, want):
    rows = N.with_list(spark.createDataFrame([(text,)], "c string"), "listed", F.col("c"))
    assert rows.columns == ["c", "listed"] and rows.select(N.coerce_choices(F.col("c"), F.col("listed")).alias("x")).first().x == want


def test_only_odd_lists_go_through_python(spark):
    texts = F.array(*[F.lit(t) for t in ("['a']", "b", "['\\t']")])
    rows = N.with_list(spark.range(3).select(F.get(texts, F.col("id").cast("int")).alias("c")), "listed", F.col("c"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Filter" in plan[plan.index("ArrowEvalPython") :]
    assert [tuple(r) for r in rows.orderBy("c").collect()] == [("['\\t']", ["\t"]), ("['a']", ["a"]), ("b", None)]


@pytest.mark.parametrize("text, want", [("0", "A"), ("3", "D"), ("4", "4"), ("b", "B"), (" Yes ", "Yes"), (None, "")])
def test_answer_labels(spark, text, want):
    rows = spark.createDataFrame([(text,)], "c string")
    assert rows.select(N.answer_label(F.col("c")).alias("x")).first().x == want


def test_incremental_append(spark, tmp_path):
    schema = "key string, ord long, v string, dataset string, model string, method string, is_correct boolean"
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))

    def arrive(*rows):
        spark.createDataFrame([(*r, "d", "m", "x", r[1] % 2 == 0) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)

    arrive(("a", 1, "old"), ("a", 2, "mid"), ("b", 3, "b"))
    rows = incremental.stream_rows(spark, source, spark.read.parquet(source).schema)
    incremental.append_units(rows, ["key"], target, marks).awaitTermination()
    arrive(("a", 4, "new"))
    incremental.append_units(rows, ["key"], target, marks).awaitTermination()
    got = {r.key: r.v for r in incremental.latest(spark, target, ["key"]).collect()}
    assert got == {"a": "new", "b": "b"}
    assert spark.read.parquet(target).count() == 3  # one row per key and batch
    query = incremental.running_accuracy(rows).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("running").first()[3:] == (4, 2)
