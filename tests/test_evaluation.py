import pytest
from pyspark.sql import functions as F

from evalscale.operators import compare, dedupe, metrics, reselect, resume, select
from evalscale.schemas import CONDITION, EXAMPLE

CAND = (
    "run_id string, dataset string, model string, method string, n int, example_id string, sample_index int, extracted_answer string, gold_answer string, answer_type string, token_count long, "
    "latency_s double, estimated_cost double, model_size_label string, prompt_style string, reasoning_language string, selection string, ord long, nested boolean, nested_group_id string"
)
SEL = (
    "run_id string, dataset string, model string, method string, n int, example_id string, is_correct boolean, model_size_label string, prompt_style string, reasoning_language string, "
    "selection string, ord long, nested boolean, nested_group_id string"
)


def cand(spark, rows, **tags):
    """rows: (example, sample, answer, gold, tokens)"""
    base = {"run": "r", "dataset": "d", "model": "m", "method": "x", "n": 4, "nested": None, "group": None} | tags
    data = [
        (base["run"], base["dataset"], base["model"], base["method"], base["n"], e, i, a, g, "number", t, 0.5, 0.01, "8B", "english_cot", "en", "majority_vote", k, base["nested"], base["group"])
        for k, (e, i, a, g, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, CAND)


def sel(spark, rows, **tags):
    base = {"run": "r", "dataset": "d", "model": "m", "method": "x", "n": 4, "nested": None, "group": None} | tags
    data = [(base["run"], base["dataset"], base["model"], base["method"], base["n"], e, ok, "8B", "english_cot", "en", "majority_vote", k, base["nested"], base["group"]) for k, (e, ok) in enumerate(rows)]
    return spark.createDataFrame(data, SEL)


VOTES = [("a", 0, "10", "11", 10), ("a", 1, "11", "11", 11), ("a", 2, "11", "11", 12), ("a", 3, "12", "11", 13), *[("b", i, "5", "7", 5) for i in range(4)]]


def test_majority_and_first(spark):
    rows = dedupe.positions(cand(spark, VOTES), EXAMPLE)
    majority = {r.example_id: (r.selected_answer, r.selected_sample_index, r.vote_counts) for r in select.select(rows, EXAMPLE, "majority_vote").collect()}
    assert majority["a"] == ("11", 1, {"num:10": 1, "num:11": 2, "num:12": 1})
    first = {r.example_id: (r.selected_answer, r.selected_sample_index, r.vote_counts) for r in select.select(rows, EXAMPLE, "first").collect()}
    assert first == {"a": ("10", 0, {"10": 1}), "b": ("5", 0, {"5": 1})}
    with pytest.raises(ValueError, match="unsupported"):
        select.select(rows, EXAMPLE, "llm_judge")


@pytest.mark.parametrize("answers, best", [(["11.0", "11", "12"], ("11.0", 0)), (["", "", "7"], ("", 0)), (["3", "4", "4", "3"], ("3", 0)), (["", "2", "2"], ("2", 1))])
def test_vote_ties_and_empty_answers(spark, answers, best):
    rows = dedupe.positions(cand(spark, [("a", i, a, "1", 1) for i, a in enumerate(answers)]), EXAMPLE)
    r = select.select(rows, EXAMPLE, "majority_vote").first()
    assert (r.selected_answer, r.selected_sample_index) == best


def test_condition_metrics(spark):
    m = metrics.with_efficiency(metrics.with_rates(metrics.conditions(cand(spark, VOTES), sel(spark, [("a", True), ("b", False)])))).first()
    assert (m.total_examples, m.accuracy, m.pass_at_n_rate, m.total_tokens, m.mean_tokens_per_example, m.tokens_per_correct) == (2, 0.5, 0.5, 66, 33.0, 66.0)
    assert (m.total_candidates, m.run_ids, m.model_size_label) == (8, ["r"], "8B")


def test_repeated_candidates_count_once_and_empty_logs_give_nothing(spark):
    twice = cand(spark, [VOTES[0], VOTES[0]])
    m = metrics.with_rates(metrics.conditions(twice, sel(spark, []))).first()
    assert (m.total_candidates, m.total_tokens, m.total_examples, m.select_correct, m.accuracy, m.tokens_per_correct) == (1, 10, 1, 0, 0.0, None)
    assert metrics.conditions(cand(spark, []), sel(spark, [])).count() == 0


def test_keep_last_keeps_first_position_and_last_values(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("j", 2, "x"), ("k", 3, "new")], "key string, ord long, v string")
    got = {r.key: (r.first_ord, r.ord, r.v) for r in dedupe.keep_last_at_first(rows, ["key"]).collect()}
    assert got == {"k": (1, 3, "new"), "j": (2, 2, "x")}
    assert {r.v for r in dedupe.keep_last(rows, ["key"]).collect()} == {"new", "x"}
    assert dedupe.duplicates_dropped(rows, ["key"]).first().dropped == 1


def test_reselection_report(spark):
    rows = {r.strategy: r for r in reselect.reselection_report(cand(spark, VOTES)).collect()}
    assert {k: (r.total, r.pass_at_n_rate, r.select_rate, r.gap) for k, r in rows.items()} == {"first": (2, 0.5, 0.0, 0.5), "majority_vote": (2, 0.5, 0.5, 0.0)}


def items(spark, rows):
    """rows: (run, examples, correct, tokens)"""
    data = [("d", "m", "x", 4, run, n, ok, t, "8B", i) for i, (run, n, ok, t) in enumerate(rows)]
    return spark.createDataFrame(data, "dataset string, model string, method string, n int, run_id string, total_examples long, select_correct long, total_tokens long, model_size_label string, ord long")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("a", 10, 4, 100), ("b", 20, 10, 200)], (30, 14, 300, ["a", "b"])),
        ([("a", 10, 4, 100), ("a", 10, 4, 100)], (10, 4, 100, ["a"])),
        ([("a", 5, 1, 10), ("a", 50, 2, 20)], (50, 2, 20, ["a"])),
        ([("a", 5, 1, 10), ("b", 7, 1, 10), ("a", 50, 2, 20), ("b", 70, 2, 20)], (12, 2, 20, ["a", "b"])),
        ([(None, 1, 1, 1), (None, 2, 1, 1)], (3, 2, 2, [])),
    ],
)
def test_merge_runs(spark, rows, want):
    r = metrics.merge_runs(items(spark, rows)).first()
    assert (r.total_examples, r.select_correct, r.total_tokens, r.run_ids) == want
    assert r.model_size_label == "8B"


def e4(spark, rows):
    data = [(d, m, x, n, 10, ok, 10, 100 * n, float(n), 1.0, i) for i, (d, m, x, n, ok) in enumerate(rows)]
    schema = "dataset string, model string, method string, n int, total_examples long, select_correct long, pass_at_n_correct long, total_tokens long, total_latency_s double, total_estimated_cost double, ord long"
    return metrics.with_rates(spark.createDataFrame(data, schema))


SMALL = [("d", "s", "ttc_n1", 1, 3), ("d", "s", "ttc_n4", 4, 6), ("d", "s", "ttc_n16", 16, 8)]


def test_small_against_large(spark):
    m = e4(spark, [*SMALL, ("d", "l", "greedy", 1, 7), ("e", "s", "ttc_n1", 1, 3)])
    c = compare.Comparison("s", "l", include_models=("s", "none"))
    assert {r.dataset: (r.has_large, r.min_n) for r in compare.per_dataset(m, c).collect()} == {"d": (True, 16), "e": (False, None)}
    table = {(r.dataset, r.small_n): r for r in compare.paper_table(m, c).collect()}
    assert round(table["d", 16].accuracy_delta, 9) == 0.1 and table["d", 16].matches_or_beats_large and table["d", 4].token_ratio_vs_large == 4.0
    assert table["e", 1].accuracy_delta is None and table["e", 1].matches_or_beats_large is None
    h = compare.headline(m, c).first()
    assert (h.datasets_matched, h.datasets_unmatched, h.datasets_missing_large_baseline, h.median_min_n_to_match) == ([("d", 16)], [], ["e"], 16.0)
    assert [(r.dataset, r.model) for r in compare.ladder(m, c).orderBy("dataset").collect()] == [("d", "s"), ("e", "s")]
    assert compare.per_dataset(m, compare.Comparison("s", "l", datasets=("e",))).count() == 1


def test_median_of_two(spark):
    m = e4(spark, [("d", "s", "x", 1, 9), ("d", "l", "x", 1, 7), ("e", "s", "x", 1, 3), ("e", "s", "x", 4, 9), ("e", "l", "x", 1, 7)])
    assert compare.headline(m, compare.Comparison("s", "l")).first().median_min_n_to_match == 2.5


@pytest.mark.parametrize(
    "method, wanted, ok",
    [("a", None, True), ("a", "", True), ("a", "*", True), ("abc", "ab*", True), ("abc", "ab", False), ("ab_c", "ab", True), ("ab-c", "ab", True), ("ab", "ab", True), ("b", "ab", False)],
)
def test_method_filter(spark, method, wanted, ok):
    assert spark.range(1).select(compare.method_matches(F.lit(method), wanted).alias("x")).first().x is ok


def test_resume(spark):
    nested = {"nested": True, "group": "g"}
    c = cand(spark, [("a", 0, "1", "1", 1), ("a", 0, "2", "1", 1), ("b", 0, "1", "1", 1)], method="alone").unionByName(cand(spark, [("a", 0, "1", "1", 1), ("b", 0, "1", "1", 1)], method="g_n1", **nested))
    s = sel(spark, [("a", True)], method="alone").unionByName(sel(spark, [("a", True), ("b", True)], method="g_n1", **nested)).unionByName(sel(spark, [("a", True)], method="g_n4", **nested))
    log = spark.createDataFrame(
        [("nested\td\tm\tg\tb", None, None, None, None, None, None), (None, "standalone", "d", "m", "alone", None, "z"), (None, "standalone", "d", None, "alone", None, "y")],
        "key string, unit_type string, dataset string, model string, method string, group_id string, example_id string",
    )
    got = resume.recover(c, s, {"g": ["g_n1", "g_n4"]}, log)
    keys = lambda df: {r.key for r in df.select("key").collect()}
    assert keys(got.incomplete) == {"standalone\td\tm\talone\tb", "nested\td\tm\tg\tb"}
    # a broken unit is done again even if the checkpoint has it
    assert keys(got.completed) == {"standalone\td\tm\talone\ta", "nested\td\tm\tg\ta", "standalone\td\tm\talone\tz"}
    assert sorted((r.method, r.example_id, r.extracted_answer) for r in got.candidates.collect()) == [("alone", "a", "2"), ("g_n1", "a", "1")]
    assert keys(got.selections) == {"standalone\td\tm\talone\ta", "nested\td\tm\tg\ta"}


def test_first_gold_of_a_group(spark):
    rows = dedupe.positions(cand(spark, [("a", 0, "1", "2", 1), ("a", 1, "2", "9", 1)]), EXAMPLE)
    assert metrics.pass_per_group(rows).first().passed and not metrics.pass_per_example(rows).first().passed
    assert metrics.method_accuracy(sel(spark, [("a", True), ("a", False)]), dedupe=True).first().correct == 0
    assert metrics.method_accuracy(sel(spark, [("a", True), ("a", False)])).first().total == 2
    assert CONDITION == ["dataset", "model", "method", "n"]
