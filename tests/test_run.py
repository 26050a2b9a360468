"""Runs from arguments to a report and an exit code."""

import json

import pytest

from lexilake.plans import config, run

FLAGGED = "As an AI language model, I cannot say. I hope this helps!\n"


def test_arguments():
    flags, a = run.arguments(["docs", "-t", "40", "--only", "ai_vocabulary, rule_of_three", "--rule", "0:tool_artifacts", "--exclude", "x/**", "-q", "*.md", "--max-hits", "2"])
    assert a.paths == ["docs", "*.md"] and (flags.threshold, flags.max_hits, flags.max_warnings, flags.mask_code) == (40, 2, None, None)
    assert flags.only == ["ai_vocabulary", "rule_of_three"] and flags.rules == {"tool_artifacts": "0"} and flags.exclude == ["x/**"] and flags.quiet
    for wrong in (["--nope"], ["-t"], ["-t", "many"], ["-t", "inf"], ["--rule", "loud:tool_artifacts"], ["--rule", "warn"]):
        assert run.main(wrong)[1] == config.EXIT_USAGE


def test_wanted():
    assert run.wanted(["*.md", "./docs/", "."], ["**/*.md", "*.txt"]) == ["*.md", "docs", "docs/**/*.md", "docs/*.txt", "docs/**/*.txt", "**/*.md", "*.txt", "**/*.txt"]


def test_words_without_texts(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    shown, code = run.main(["rules"])
    assert code == 0 and shown.splitlines()[-1] == "20 rules, 95 patterns."
    assert run.main(["init"]) == ("wrote .lexilakerc.json", 0) and run.main(["init"])[1] == config.EXIT_USAGE
    assert run.main(["--no-config", "--format", "xml"])[1] == run.main(["--config", "none.json"])[1] == config.EXIT_USAGE


@pytest.mark.parametrize("quiet", [False, True])
def test_a_folder(spark, tmp_path, monkeypatch, quiet):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text(FLAGGED)
    (tmp_path / "docs" / "b.txt").write_text("Plain words.\n")
    (tmp_path / "c.md").write_text(FLAGGED)
    shown, code = run.main(["docs", "--root", str(tmp_path), "--no-config", "--format", "json", *["-q"] * quiet], spark)
    out = json.loads(shown)
    assert code == config.EXIT_LINT and [r["filePath"] for r in out["results"]] == ["docs/a.md", "docs/b.txt"] and out["summary"]["errors"] > 0
    assert not quiet or out["summary"]["warnings"] == 0
    if not quiet:
        assert run.main(["--stdin", "--no-config"], spark, "Plain words.\n")[1] == config.EXIT_CLEAN
        assert run.main(["*.rst", "--root", str(tmp_path), "--no-config"], spark)[1] == config.EXIT_USAGE
