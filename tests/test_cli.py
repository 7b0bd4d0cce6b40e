import json

import pytest

from pairloom import __version__, cli


@pytest.fixture
def cases(spark, tmp_path):
    at = tmp_path / "cases.jsonl"
    at.write_text("".join(json.dumps({"id": f"c{k}", "category": "x" if k % 2 else "y", "turns": [f"turn {k}", "more"]}) + "\n" for k in range(9)), encoding="utf-8")
    return at


def results(folder):
    return sorted(folder.glob("results_*.json"))


def test_run_and_compare(spark, tmp_path, cases, capsys):
    args = ["run", "--dataset", str(cases), "--models", "simulated/one,Simulated/two", "--judge", "simulated_judge/j", "--output", str(tmp_path / "out"), "--formats", "json,jsonl,md", "--max-items", "7"]
    assert cli.main(args) == 0
    told = capsys.readouterr().out
    assert "winner:" in told and "json:" in told
    doc = json.loads(results(tmp_path / "out")[0].read_text())
    assert doc["summary"]["total_test_cases"] == 7 and doc["config"]["domain"] == "dining_room"
    assert cli.main(["compare", str(results(tmp_path / "out")[0]), "--format", "json", "--output", str(tmp_path / "c.json")]) == 0
    assert json.loads((tmp_path / "c.json").read_text())["benchmarks"][0]["winner"] == doc["summary"]["overall_winner"]
    for form in ("table", "markdown"):
        assert cli.main(["compare", str(results(tmp_path / "out")[0]), "--format", form]) == 0
        assert "one" in capsys.readouterr().out


def test_generate(spark, tmp_path):
    assert cli.main(["generate", "--num", "20", "--seed", "3", "--output", str(tmp_path / "g"), "--single"]) == 0
    lines = [json.loads(x) for p in (tmp_path / "g").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 20 and all(len(x["turns"]) >= 3 for x in lines) and len(list((tmp_path / "g").glob("*.json"))) == 1


def test_listings(capsys):
    for command, said in (("domains", "dining_room"), ("capabilities", "chat_completion"), ("version", __version__)):
        assert cli.main([command]) == 0 and said in capsys.readouterr().out


def test_what_is_wrong_is_said(spark, tmp_path, cases, capsys):
    for more in (["--models", "simulated/one"], ["--models", "nobody/one,simulated/two"], ["--config", str(tmp_path / "none.yaml")], ["--models", "simulated/a,simulated/b", "--capabilities", "smell"]):
        assert cli.main(["run", "--dataset", str(cases), *more]) == 1
        assert "error:" in capsys.readouterr().err
    assert cli.main(["compare", str(tmp_path / "none.json")]) == 1
