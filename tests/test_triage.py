"""The whole triage on the synthetic corpus, its model and the command line."""

import json

import pytest

from sievewright.__main__ import main
from sievewright.operators import boosting, policy, triage
from sievewright.sources import corpus


@pytest.fixture(scope="module")
def model(spark):
    return triage.trained(corpus.corpus(spark, 4))


def test_verdicts_families_and_documents(spark, model):
    files = corpus.corpus(spark, 2).unionByName(spark.createDataFrame([("bad.exe", "?", 0, 2, bytearray(b"MZ"))], "path string, family string, label int, length long, content binary"))
    out = triage.triaged(files.select("path", "content"), model)
    rows = {r["path"]: r for r in out.collect()}
    assert len(rows) == 19 and rows["bad.exe"]["error"] and rows["bad.exe"]["verdict"] is None
    for path, r in rows.items():
        family = path.split("/")[0]
        if path == "bad.exe":
            continue
        assert (r["verdict"] == "BENIGN") == (family == "benign") and r["family"] == (None if family == "benign" else family)
        assert r["packed"] == (family == "dense") and r["route"] == (r["packed"] or r["verdict"] == "SUSPICIOUS")
        assert len(r["contributions"]) <= 5 and (any("packed:" in n for n in r["notes"]) == r["packed"])
    doc = json.loads(policy.as_json(out.filter("path = 'bad.exe'"), "path").first()["document"])
    assert doc["verdict"] is None and doc["error"]


def test_models_are_json_and_refuse_other_features(model):
    again = triage.LinearModel.from_json(model.to_json())
    assert again == model and len(model.columns) == 91 and set(model.thresholds) == {"fpr_1pct", "fpr_0.1pct"}
    other = json.loads(model.to_json()) | {"columns": model.columns[::-1]}
    with pytest.raises(ValueError, match="other features"):
        triage.LinearModel.from_json(json.dumps(other))
    with pytest.raises(ValueError, match="not a model"):
        triage.LinearModel.from_json("{}")


def test_a_boosted_model_is_recognised(spark):
    files_ = corpus.corpus(spark, 4).filter("content IS NOT NULL")
    m = triage.boosted(files_, boosting.Params(rounds=4, leaves=4, bins=16, least_rows=2))
    again = triage.load_model(m.to_json())
    assert isinstance(again, boosting.Boosted) and again.thresholds == m.thresholds
    rows = triage.triaged(files_.select("path", "content"), again).filter("error IS NULL").collect()
    label = {r["path"]: r["label"] for r in files_.select("path", "label").collect()}
    assert rows and {r["family"] for r in rows} <= {None} and all((r["score"] > 0.5) == (label[r["path"]] == 1) for r in rows if r["verdict"] != "SUSPICIOUS")
    with pytest.raises(ValueError, match="other features"):
        triage.load_model(json.dumps(json.loads(m.to_json()) | {"columns": m.columns[::-1]}))


def test_command_line(spark, model, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.exe").write_bytes(corpus.sample("benign", 0))
    (tmp_path / "in/b.exe").write_bytes(corpus.sample("t1105", 0))
    (tmp_path / "in/c.exe").write_bytes(b"MZ")
    (tmp_path / "m.json").write_text(model.to_json())
    assert main(["scan", f"{tmp_path}/in", "--model", f"{tmp_path}/m.json"]) == 0
    said = capsys.readouterr()
    assert [line.split("\t")[1] for line in said.out.splitlines()] == ["BENIGN", "MALICIOUS", "ERROR"] and "MALICIOUS 1" in said.err
    assert main(["analyze", f"{tmp_path}/in/b.exe", "--model", f"{tmp_path}/m.json", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["family"] == "t1105"
    assert main(["analyze", f"{tmp_path}/in/c.exe", "--model", f"{tmp_path}/m.json"]) == 2
    assert main(["analyze", f"{tmp_path}/none.exe"]) == 2
    assert main(["gen-corpus", f"{tmp_path}/corpus", "-n", "1"]) == 0 and spark.read.parquet(f"{tmp_path}/corpus").count() == 9


def test_the_corpus_is_read_once(spark):
    """Queries over the corpus start from its written reports, and kernels take few files at a time."""
    import pyarrow as pa

    from sievewright.plans import mining
    from sievewright.sources.tables import sliced

    plan = mining._triaged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
    assert [b.num_rows for b in sliced([pa.record_batch({"x": range(600)}), pa.record_batch({"x": pa.array([], pa.int64())})], 256)] == [256, 256, 88]
