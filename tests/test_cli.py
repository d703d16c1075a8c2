"""Every command of the command line, one after another, over one small store."""

import json

import pytest

from oremill import cli
from oremill.errors import ConfigError


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "v.yaml").write_text("verticals:\n  ops: {name: Operations, queries: [imports]}\n")
    results = [
        {"url": f"https://a{i}.test/x", "title": t, "content": c, "engines": ["e"], "score": 1.0}
        for i, (t, c) in enumerate([("How do I stop manual imports?", "Every week I copy-paste rows by hand. It takes forever."), ("Best tool for exports", "Pricing is $20 per month, compared to others.")])
    ]
    (tmp_path / "p.json").write_text(json.dumps({"query": "imports", "source": "searxng", "results": results}) + "\n")

    def go(*argv, now="2024-05-01 10:00:00"):
        cli.main(["--root", str(tmp_path / "t"), "--verticals", str(tmp_path / "v.yaml"), "--now", now, *argv], spark)
        return capsys.readouterr().out

    assert json.loads(go("doctor"))["tables"]["evidence_event"] == 0
    assert "searxng" in go("policy") and go("policy", "--lint").strip() == "source\tproblem"
    assert go("verticals").strip() == "ops\tOperations\t1"
    with pytest.raises(ConfigError):
        go("collect", "--payloads", str(tmp_path / "p.json"))
    for _ in range(2):  # a second replay of the same payloads adds no evidence
        assert "searxng" in go("collect", "--payloads", str(tmp_path / "p.json"), "--vertical", "ops")
    got = json.loads(go("pipeline", "--all"))
    assert got["failed"] == {} and (got["results"]["ops"]["originals"], got["results"]["ops"]["ideas"]) == (2, 3)
    assert "ops.md" in go("report", "--all") and "## Ideas" in (tmp_path / "reports" / "ops.md").read_text()
    idea = go("ideas", "--vertical", "ops").splitlines()[1].split("\t")[0]
    hyp = go("review").splitlines()[1].split("\t")[0]
    assert json.loads(go("review", "--id", hyp))["id"] == hyp
    assert go("review", "--id", hyp, "--set", "buyer=office managers", now="2024-05-02 00:00:00").count("\n") == 4
    exp = go("experiments", "list").splitlines()[1].split("\t")[0]
    assert "no price" in go("experiments", "start", "--id", exp)
    assert "\trunning\t25.0\treviewed:operator 2024-05-01" in go("experiments", "start", "--id", exp, "--price", "25")
    assert "illegal transition" in go("experiments", "start", "--id", exp)
    assert "accepted\t1" in go("outcomes", "record", "--id", exp, "--kind", "deposit_paid")
    assert "unknown kind\t1" in go("outcomes", "record", "--id", exp, "--kind", "rumour")
    assert "deposit_paid" in go("outcomes", "list")
    go("outcomes", "export", "--path", str(tmp_path / "csv"))
    assert "stopped" in go("experiments", "decide", "--id", exp, "--decision", "advance", "--reason", "paid")
    assert "advance\t" in go("calibration", "--sprint-log", str(tmp_path / "log"))
    assert json.loads((tmp_path / "log").read_text()) == {"draft": 2, "stopped": 1}
    assert go("bootstrap", "--id", idea).count(".md") == 9
    assert "a.html" in go("landing", "--id", idea)
    assert "do_nothing" in go("competitors", "--vertical", "ops") and "imports" in go("queries", "--vertical", "ops")
    assert "searxng\t2" in go("deletions", now="2025-05-01 00:00:00")
    assert json.loads(go("doctor"))["tables"]["evidence_event"] == 0
