import json

import pytest
from pyspark.sql import functions as F

from evalscale import cli
from evalscale.plans import config as C
from evalscale.plans import run as runs
from evalscale.plans import sweep as S
from evalscale.sources import folders, reports, unitlog


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


@pytest.fixture
def config(tmp_path):
    write(tmp_path / "math" / "test.jsonl", *[{"question": f"{i}+{i}?", "gold_answer": str(2 * i), "answer_type": "number"} for i in range(3)])
    row = {
        "run_id": "r1", "output_dir": str(tmp_path / "runs"), "seed": 3, "datasets": [{"name": "d", "path": str(tmp_path / "math" / "test.jsonl")}], "models": [{"name": "m", "size_label": "8B", "cost_per_1k_tokens": 1.0}],
        "methods": [{"name": "bon", "prompt_style": "english_cot", "selection": "majority_vote", "n_values": [1, 4, 8], "temperature": 0.7, "nested_n": True}, {"name": "yo", "prompt_style": "yoruba_cot"}],
    }
    (tmp_path / "run.json").write_text(json.dumps(row))
    return C.load_run_config(tmp_path / "run.json")


def test_run_resume_and_overwrite(spark, config, tmp_path):
    backend = lambda model: S.EchoBackend
    base = tmp_path / "runs" / "r1"
    first = runs.run(spark, config, backend, limit=2)
    assert (first["units_completed"], first["units_skipped"]) == (4, 0)
    candidates, selections = runs.read_run(spark, base)
    assert (candidates.count(), selections.count()) == (2 * 13 + 2, 2 * 4)
    again = runs.run(spark, config, backend)
    assert (again["units_completed"], again["units_skipped"]) == (2, 4)
    candidates, selections = runs.read_run(spark, base)
    assert (candidates.count(), selections.count()) == (3 * 13 + 3, 3 * 4) and candidates.where("nested").select("nested_group_id").distinct().first()[0] == "bon"
    assert runs.run(spark, config, backend)["units_completed"] == 0
    assert runs.run(spark, config, backend, methods=["yo"], overwrite=True)["units_completed"] == 3
    assert runs.read_run(spark, base)[0].count() == 3
    assert json.loads((base / "manifest.json").read_text())["run_id"] == "r1"


def broken_after(calls):
    def make():
        class Broken(S.EchoBackend):  # defined here, so that it travels by value
            made = 0

            def generate(self, *args):
                Broken.made += 1
                if Broken.made > calls:
                    raise RuntimeError("killed")
                return super().generate(*args)

        return Broken()

    return make


def test_what_a_lost_job_finished_is_kept(spark, config, tmp_path, monkeypatch):
    write(tmp_path / "math" / "test.jsonl", *[{"question": f"{i}+{i}?", "gold_answer": str(2 * i), "answer_type": "number"} for i in range(30)])
    base = str(tmp_path / "runs" / "r1")
    with pytest.raises(Exception, match="killed"):
        runs.run(spark, config, lambda model: broken_after(5), methods=["yo"], segment_units=1)
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, base)
    (log,) = [e.path for e in folders.listing(spark, f"{base}/log")]
    kept = unitlog.logged_keys(spark, log).count()
    asked, append = [], unitlog.append
    monkeypatch.setattr(unitlog, "append", lambda rows, *args, **options: asked.append(rows.count()) or append(rows, *args, **options))
    done = runs.run(spark, config, lambda model: S.EchoBackend, methods=["yo"])
    assert (done["units_completed"], done["generations"], done["candidate_rows"], done["selection_rows"]) == (30, 30, 30, 30)
    assert kept > 0 and asked == [30 - kept]
    assert runs.read_run(spark, base)[0].count() == 30 and not folders.listing(spark, f"{base}/log")


def test_a_torn_attempt_is_not_read_and_not_sampled_again(spark, config, tmp_path, monkeypatch):
    base = str(tmp_path / "runs" / "r1")
    runs.run(spark, config, lambda model: S.EchoBackend, limit=1)
    before = [t.count() for t in runs.read_run(spark, base)]

    def torn(*args, **options):
        raise RuntimeError("lost while selecting")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(runs, "reselect", torn)
        runs.run(spark, config, lambda model: S.EchoBackend, methods=["yo"])
    assert [t.count() for t in runs.read_run(spark, base)] == before
    assert len(list((tmp_path / "runs" / "r1" / "candidates").iterdir())) == len(runs.attempts(spark, base)) + 1
    done = runs.run(spark, config, lambda model: broken_after(0), methods=["yo"])  # all is in the log
    assert (done["units_completed"], done["units_skipped"], done["generations"]) == (2, 1, 2)
    candidates, selections = runs.read_run(spark, base)
    assert candidates.where("method = 'yo'").count() == selections.where("method = 'yo'").count() == 3


def test_a_sweep_with_more_methods_replaces_its_units(spark, config, tmp_path):
    base = str(tmp_path / "runs" / "r1")
    few = ["bon_n1", "bon_n4"]
    assert runs.run(spark, config, lambda model: S.EchoBackend, methods=few)["generations"] == 3 * 5
    done = runs.run(spark, config, lambda model: S.EchoBackend, methods=[*few, "bon_n8"])
    assert (done["units_completed"], done["generations"]) == (3, 3 * 9)
    candidates, selections = runs.read_run(spark, base)
    assert (candidates.count(), selections.count()) == (3 * 13, 3 * 3) and candidates.select("nested_pool_n").where("n = 4").distinct().first()[0] == 8
    assert runs.run(spark, config, lambda model: S.EchoBackend, methods=few)["units_completed"] == 0  # fewer are among those made


def test_runs_are_found_by_uri(spark, config, tmp_path):
    from dataclasses import replace

    there = replace(config, output_dir=f"file://{tmp_path}/elsewhere")
    assert runs.run(spark, there, lambda model: S.EchoBackend, methods=["yo"])["units_completed"] == 3
    assert runs.run(spark, there, lambda model: S.EchoBackend, methods=["yo"])["units_skipped"] == 3
    assert json.loads(folders.read_text(spark, f"file://{tmp_path}/elsewhere/r1/manifest.json"))["units_skipped"] == 3
    assert [e.name for e in folders.matching(spark, f"file://{tmp_path}/elsewhere/*/manifest.json")] == ["manifest.json"]


def log(folder, run, model, n, answers):
    meta = {"dataset": "d", "gold_answer": "1", "answer_type": "number", "backend_metadata": {"finish_reason": "length"}}
    rows = [
        {"run_id": run, "example_id": f"{run}{e}", "model": model, "method": f"ttc_n{n}", "n": n, "sample_index": i, "extracted_answer": a, "token_count": 10, "latency_s": 1.0, "metadata": meta}
        for e, own in enumerate(answers)
        for i, a in enumerate(own)
    ]
    write(folder / run / "candidates.jsonl", *rows)
    write(folder / run / "selections.jsonl", *[{"run_id": run, "example_id": f"{run}{e}", "dataset": "d", "model": model, "method": f"ttc_n{n}", "n": n, "is_correct": own[0] == "1"} for e, own in enumerate(answers)])
    write(folder / run / "manifest.json", {"run_id": run})


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "runs"
    log(folder, "a", "s", 2, [["1", "1"], ["2", "1"]])
    log(folder, "b", "s", 2, [["1", "1"]])
    log(folder, "c", "l", 1, [["1"], ["2"]])
    at = ["--runs", str(folder)]
    cli.main(["aggregate", *at, "--out", str(tmp_path / "agg")])
    table = (tmp_path / "agg" / "metrics.csv").read_text().splitlines()
    assert len(table) == 3 and any("a;b" in line for line in table)
    found = json.loads((tmp_path / "agg" / "metrics.json").read_text())["conditions"]
    assert {(r["model"], r["total_examples"], round(r["accuracy"], 6), r["total_tokens"]) for r in found} == {("s", 3, 0.666667, 60), ("l", 2, 0.5, 20)}
    cli.main(["evaluate", *at, "--run", "a"])
    one = json.loads((folder / "a" / "evaluation.json").read_text())
    assert one["accuracy"] == 0.5 and one["pass_at_n_rate"] == 1.0 and len(one["conditions"]) == 1
    cli.main(["accuracy", *at, "--run", "a"])
    assert "ttc_n2" in capsys.readouterr().out
    cli.main(["truncated", *at, "--methods", "ttc_n1", "--out", str(tmp_path / "cut")])
    assert spark.read.json(str(tmp_path / "cut")).count() == 2
    cli.main(["truncated", *at, "--out", str(tmp_path / "all")])  # of all methods
    assert spark.read.json(str(tmp_path / "all")).count() == 8
    cli.main(["reselect", *at, "--out", str(tmp_path / "every"), "--limit", "2"])
    assert {r["run"] for r in json.loads((tmp_path / "every" / "summary.json").read_text())["rows"]} == {"a", "b"} and (tmp_path / "every" / "b" / "report.json").exists()
    cli.main(["reselect", *at, "--run", "a", "--out", str(tmp_path / "re")])
    rows = json.loads((tmp_path / "re" / "report.json").read_text())["rows"]
    assert {(r["strategy"], r["select_rate"], r["pass_at_n_rate"]) for r in rows} == {("first", 0.5, 1.0), ("majority_vote", 0.5, 1.0)}
    for source in (at, ["--metrics", str(tmp_path / "agg" / "metrics.json")]):
        cli.main(["compare", *source, "--small-model", "s", "--large-model", "l", "--out", str(tmp_path / "cmp")])
        report = json.loads((tmp_path / "cmp" / "comparison.json").read_text())
        assert report["headline"]["datasets_matched"] == [{"dataset": "d", "min_n": 2}] and len((tmp_path / "cmp" / "paper_table.csv").read_text().splitlines()) == 2


def test_ingest_and_prompts(spark, config, tmp_path):
    (tmp_path / "raw").mkdir()
    for split in ("train", "test"):
        (tmp_path / "raw" / f"{split}.tsv").write_text("question\tanswer_number\nq1\t5\nq2\t\n")
    cli.main(["ingest", "--dataset", "afrimgsm", "--files", str(tmp_path / "raw"), "--out", str(tmp_path / "data")])
    rows = spark.read.json(str(tmp_path / "data" / "math-reasoning" / "afrimgsm"))
    counts = json.loads((tmp_path / "data" / "math-reasoning" / "afrimgsm.manifest.json").read_text())
    assert counts["all"] == 2 and counts["splits"] == [{"split": s, "raw": 2, "retained": 1, "skipped": 1} for s in ("test", "train")]
    assert rows.count() == 2 and {r.split for r in rows.select("split").distinct().collect()} == {"train", "test"}
    cli.main(["prompts", "--config", str(tmp_path / "run.json"), "--out", str(tmp_path / "prompts"), "--limit", "1"])
    assert (tmp_path / "prompts" / "task=math" / "prompt_style=yoruba_cot").is_dir()


def test_tables_and_plots(tmp_path):
    assert reports.text_table([{"a": 0.5, "b": None}, {"a": "x" * 40, "b": 1}], ["a", "b"], 6) == "a       b\n0.5000  N/A\nxxxxx…  1"
    assert reports.plot([], ("d",), "n", "y", tmp_path / "x.png") is None
    assert F.lit(1) is not None
