"""The command lines end to end, on small files."""

import json

import pytest

from paritas import cli
from paritas.plans import simulations


def score(values):
    return [float(len(v) % 17) for v in values]


def answer(text):
    return json.dumps({"poverty": len(text) % 7 / 7, "refugee": len(text) % 5 / 5, "major_illness": 0.5, "academic_career": None})


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "c.jsonl"
    rows = []
    for i in range(48):
        stratum = {"race": ("White", "Black", "Asian", "Other")[i % 4], "gender": ("Female", "Male")[i // 4 % 2], "school_tier": ("top_20", "mid_tier", "lower_tier")[i % 3]}
        rows.append({"applicant_id": f"PS{i:04d}", "seed_key": f"s{i % 2}", "stratum": stratum, "instance": 1, "text": f"She was caring, {'x' * (i * 7 % 40)}.", "expected_question_truth": {}})
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def report(path):
    return json.loads(path.read_text())


def test_audits_of_a_corpus(spark, corpus, tmp_path):
    out = tmp_path / "a"
    out.mkdir()
    assert cli.main(["mitigator", "--corpus", corpus, "--pipeline", "test_cli:score", "--out-dir", str(out), "--bootstrap-reps", "5", "--n-permutations", "5"]) == 0
    got = report(out / "audit_1.json")
    assert len(got["axes"]) == 6 and len(got["effect"]) == 3 and got["paired_gender"][0]["n_perms_run"] == 5
    assert cli.main(["questions", "--corpus", corpus, "--extractor", "test_cli:answer", "--out-dir", str(out), "--bootstrap-reps", "5"]) == 0
    got = report(out / "audit_2.json")
    assert len(got["results_per_score_col"]) == 15 and len(got["heatmap"]) == 5
    assert cli.main(["rebootstrap", "--scores", str(out / "scores"), "--out", str(out / "r.json"), "--score-cols", "poverty", "gone", "--bootstrap-reps", "5", "--n-permutations", "1"]) == 0
    assert {r["score_col"] for r in report(out / "r.json")["results_per_score_col"]} == {"poverty"}
    args = ["decomposition", "--corpus", corpus, "--original-scores", str(out / "scores"), "--stripped-scores", str(out / "scores"), "--out-dir", str(out), "--bootstrap-reps", "5", "--n-permutations", "20"]
    assert cli.main(args) == 0 and all(r["delta_di"] in (0, None) for r in report(out / "decomposition.json")["cells"])


def test_simulations(spark, tmp_path):
    assert cli.main(["simulate", "--out", str(tmp_path / "s.json"), "--anchoring", "x:0.1:0.7", "--n", "400", "--reps", "4", "--model", "linear_score"]) == 0
    assert len(report(tmp_path / "s.json")["metrics"]) == 7
    assert cli.main(["counterfactual", "--out", str(tmp_path / "c.json"), "--anchoring", "x:0.1:0.7", "--n", "600", "--reps", "4", "--models", "linear_score", "cubic_aggregation"]) == 0
    got = {(r["model"], r["stage"]): r["point"] for r in report(tmp_path / "c.json")["stages"] if r["metric"] == "disparate_impact"}
    assert got["linear_score", "baseline"] < 0.5 < got["linear_score", "counterfactual"]
    assert cli.main(["disclosure", "--anchoring", "x:0.18:0.78", "--out", str(tmp_path / "d.json"), "--n", "600", "--reps", "4", "--rates", "0", "1", "--model", "linear_score"]) == 0
    points = {r["rate"]: r["point"] for r in report(tmp_path / "d.json")["rates"] if r["metric"] == "disparate_impact"}
    assert points[0.0] < points[1.0]
    assert cli.main(["disclosure", "--anchoring", "x:0.18", "--out", "none"]) == 2


def test_fitted_simulation(spark):
    got = simulations.counterfactual(spark, [("x", 0.1, 0.7)], n=400, reps=1, model="logistic_regression").collect()
    assert len(got) == 6


def test_parameter_sweep(spark):
    got = simulations.parameter_sweep(spark, [{"a": 1}, {"a": 2}], replicate, 4, 10, "a int").orderBy("a").collect()
    assert [(r["a"], r["metric"], r["n_reps"], r["mean"]) for r in got] == [(1, "m", 4, 11.5), (2, "m", 4, 23.0)]


def replicate(parameters, seed):
    return {"m": parameters["a"] * seed}


def test_corpus_size(spark, capsys):
    assert cli.main(["corpus", "--out", "none", "--dry-run"]) == 0 and capsys.readouterr().out.strip() == "192"
