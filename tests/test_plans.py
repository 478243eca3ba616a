import json

import pytest
from pyspark.sql import functions as F

from evalscale.functions import prompts as P
from evalscale.functions import text as X
from evalscale.plans import config as C
from evalscale.plans import sweep as S

SWEEP = {"name": "bon", "prompt_style": "english_cot", "selection": "majority_vote", "n_values": [1, 4, 8], "temperature": 0.7, "top_p": 0.9, "nested_n": True}


def test_sweep_expansion():
    one, four, eight = C.expand_methods([SWEEP])
    assert [m.name for m in (one, four, eight)] == ["bon_n1", "bon_n4", "bon_n8"]
    assert (one.temperature, one.top_p, one.selection, one.is_greedy_arm, one.group, one.group_max_n) == (0.0, None, "first", True, "bon", 8)
    assert (four.temperature, four.selection, four.is_greedy_arm, eight.reasoning_language) == (0.7, "majority_vote", False, "en")
    keep = C.expand_methods([SWEEP | {"greedy_n1": False, "temperature_n1": 0.3}])[0]
    assert (keep.temperature, keep.selection, keep.is_greedy_arm, keep.top_p) == (0.3, "majority_vote", False, 0.9)
    alone = C.expand_methods([{"name": "x", "prompt_style": "yoruba_cot"}])[0]
    assert (alone.name, alone.n, alone.group, alone.reasoning_language) == ("x", 1, None, "yo")


@pytest.mark.parametrize("bad", [{"prompt_style": "none"}, {"selection": "judge"}, {"n": 0}, {"n_values": 4}])
def test_faulty_methods(bad):
    with pytest.raises(C.ConfigError):
        C.expand_methods([{"name": "x", "prompt_style": "english_cot"} | bad])


def test_run_config(tmp_path):
    row = {"datasets": [{"name": "d", "path": "p", "limit": "3"}], "models": [{"name": "m"}], "methods": [SWEEP], "seed": 5}
    path = tmp_path / "run.json"
    path.write_text(json.dumps(row))
    found = C.load_run_config(path)
    assert (found.datasets[0].limit, found.models[0].backend, len(found.methods), found.seed, found.max_concurrent) == (3, "transformers", 3, 5, 1)
    for bad in ({"datasets": []}, {"models": []}, {"methods": []}, {"max_concurrent": 0}):
        with pytest.raises(C.ConfigError):
            C.run_config(row | bad)
    assert [m.name for m in C.named(found.methods, ["bon_n4"])] == ["bon_n4"] and len(C.named(found.methods, None)) == 3
    with pytest.raises(C.ConfigError, match="nope"):
        C.named(found.methods, ["nope"])
    assert C.name_set(" a, b,,") == {"a", "b"} and C.name_set(" ") is None


def test_comparison_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"small_model": "s", "large_model": "l", "small_method": "x", "datasets": ["a"]}))
    c = C.comparison_config(path, large_n=2, small_method="")
    assert (c.small_model, c.large_n, c.small_method, c.datasets) == ("s", 2, "", ("a",))
    assert C.comparison_config(tmp_path / "missing.json").large_n == 1


def test_groups_and_pool():
    alone, groups = C.partition_methods(C.expand_methods([SWEEP, {"name": "x", "prompt_style": "english_cot"}]))
    assert [m.name for m in alone] == ["x"] and [m.n for m in groups["bon"]] == [1, 4, 8]
    greedy, rest = C.split_group(groups["bon"])
    pool = C.pool_method(rest, 8)
    assert ([m.n for m in greedy], pool.n, pool.name) == ([1], 8, "bon_pool_n8")
    with pytest.raises(C.ConfigError):
        C.pool_method([], 8)


def test_seeds(spark):
    values = {S.sample_seed(20260708, f"e{i}", 0) for i in range(20)}
    assert len(values) == 20 and all(0 <= v < 1 << 31 for v in values) and S.sample_seed(None, "e", 0) is None
    assert S.sample_seed(1, "e", 0) != S.sample_seed(1, "e", 1) == S.sample_seed(1, "e", 1)
    rows = spark.createDataFrame([("e1", 0), ("e2", 3)], "id string, k int")
    assert [r.s for r in rows.select(S.seeds(9, F.col("id"), F.col("k")).alias("s")).collect()] == [S.sample_seed(9, "e1", 0), S.sample_seed(9, "e2", 3)]
    assert rows.select(S.seeds(None, F.col("id"), F.col("k")).alias("s")).first().s is None


def prompts(spark):
    prompt = P.render("english_cot", {}, F.lit("math"), F.lit("own"), F.col("q"), F.lit(None).cast("array<string>"), F.lit("number"))
    return spark.createDataFrame([("e1", "1+1?"), ("e2", "2+2?")], "example_id string, q string").withColumn("prompt", prompt)


def test_nested_run(spark):
    """n = 1, 4, 8 with a greedy arm: nine generations, thirteen stored rows, and n = 4 is a prefix of n = 8."""
    methods = C.expand_methods([SWEEP])
    greedy, rest = C.split_group(methods)
    pool = S.generate(prompts(spark), S.EchoBackend, 8, C.pool_method(rest, 8), 1, 0.5).cache()
    arm = S.generate(prompts(spark), S.EchoBackend, 1, greedy[0], 1, 0.5).cache()
    assert pool.count() + arm.count() == 2 * 9
    rows = S.nested_slices(pool, rest, "bon", 8).unionByName(S.nested_slices(arm, greedy, "bon", 8)).cache()
    assert rows.count() == 2 * 13
    four, eight = ({(r.example_id, r.sample_index): r.response for r in rows.where(F.col("n") == n).collect()} for n in (4, 8))
    assert four.items() <= eight.items() and len(four) == 8
    assert rows.select("nested_pool_n").distinct().first()[0] == 8 and pool.first().estimated_cost == pool.first().token_count / 2000
    with pytest.raises(C.ConfigError):
        S.nested_slices(pool, rest, "bon", 4)


def test_failures_are_raised_or_recorded(spark):
    class Failing:
        def generate(self, *args):
            raise RuntimeError("no")

    method = C.method({"name": "x", "prompt_style": "english_cot"})
    rows = S.generate(prompts(spark), Failing, 2, method, None, continue_on_error=True).collect()
    assert {(r.response, r.token_count, r.error) for r in rows} == {("", 0, "no")} and len(rows) == 4
    with pytest.raises(Exception, match="no"):
        S.generate(prompts(spark), Failing, 1, method, None).collect()


def test_units(spark):
    examples = spark.createDataFrame([("d", "1"), ("d", "2")], "dataset string, example_id string")
    models = spark.createDataFrame([("m",)], "model string")
    units = S.plan_units(examples, models, S.method_table(spark, C.expand_methods([SWEEP, {"name": "x", "prompt_style": "english_cot"}])))
    assert {r.key for r in units.collect()} == {f"{k}\td\tm\t{g}\t{e}" for k, g in (("nested", "bon"), ("standalone", "x")) for e in "12"}
    done = spark.createDataFrame([("nested\td\tm\tbon\t1",), ("nested\td\tm\tbon\t1",)], "key string")
    assert S.pending(units, done).count() == 3


EXEMPLARS = {"math": [P.Exemplar("ibeere", "in English", "ni Yoruba", "4", "question", ("one", "B. two"))], "math_en": [P.Exemplar("asked", "because", "-", "5", "-")]}


def render(spark, style, task="math", source="afrimgsm", kind="number", choices=None):
    rows = spark.createDataFrame([("Q?", choices)], "q string, c array<string>")
    return rows.select(P.as_text(P.render(style, EXEMPLARS, F.lit(task), F.lit(source), F.col("q"), F.col("c"), F.lit(kind))).alias("p")).first().p


def test_prompts(spark):
    english, yoruba, pivot = (render(spark, s) for s in ("english_cot", "yoruba_cot", "translate_pivot"))
    assert "in English" in english and "ni Yoruba" not in english and "Reason step by step in English." in english
    assert "ni Yoruba" in yoruba and "Reason step by step in Yoruba." in yoruba
    assert "English translation:\nquestion" in pivot and "Translate the Yoruba question" in pivot and "First identify" not in pivot
    assert render(spark, "best_of_n_cot") == english
    assert "Choices:\nA. one\nB. two" in english and "Question (Yoruba):\nQ?" in english and "Final answer: <number>" in english
    translated = render(spark, "english_cot", source="afrimgsm_translate")
    assert "asked" in translated and "ibeere" not in translated and "Question:\nQ?" in translated and "Yoruba" not in translated
    assert "Examples:" not in render(spark, "english_cot", task="qa")
    assert "Choices:\nA. x\nB. y" in render(spark, "english_cot", kind="choice", choices=["x", "B. y"])
    with pytest.raises(ValueError):
        render(spark, "other")


def test_exemplars_from_json(tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"qa": [{"question": "q", "reasoning_en": "e", "reasoning_yo": "y", "answer": "a", "translated_question": "t", "choices": ["u"]}]}))
    assert P.load_exemplars(path)["qa"][0].choices == ("u",)
    assert X.TOLERANCE == 1e-6
