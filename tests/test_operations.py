"""Operators that no query shows: ranks in slices, saved models, clusters, documents, archives, registered functions, sinks."""

import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import density, evaluation, models, policy, ranking, robustness, rules
from sievewright.sources import corpus, files


def test_running_sums_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(900))]), k, rng.randrange(9)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "g string, x double, id long, n long")
    got = {r["id"]: (r["below_n"], r["all_n"]) for r in ranking.below(df, "x", ["n"], ["g"], [F.col("x"), F.col("id")]).collect()}
    place = lambda r: (r[1] is not None, r[1] != r[1] if r[1] is not None else False, 0 if r[1] is None or r[1] != r[1] else r[1], r[2])
    for g in ("a", "b", None):
        mine, total = sorted((r for r in rows if r[0] == g), key=place), 0
        for r in mine:
            assert got[r[2]] == (total, sum(x[3] for x in mine))
            total += r[3]
    places = sorted(r["place"] for r in ranking.numbered(df.filter("g = 'a'"), "x", [], [F.col("x"), F.col("id")]).collect())
    assert places == list(range(1, len(places) + 1))
    assert ranking.below(df.limit(0), "x", ["n"]).count() == 0


def test_exact_tails_equal_sums_of_binomials(spark):
    from math import comb

    cases = [(k, n) for n in (0, 1, 5, 40) for k in range(n + 1)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", evaluation.exact_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    for r in got:
        k = min(r["k"], r["n"] - r["k"])
        want = min(1.0, 2 * sum(comb(r["n"], i) for i in range(k + 1)) / 2 ** r["n"]) if r["n"] else 1.0
        assert abs(r["p"] - want) < 1e-12


def test_saved_models_refuse_other_features(spark, tmp_path):
    df = models.assembled(spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(200)], "a double, b double, label double"), ["a", "b"])
    m = models.fit_boosted(df, "label", rounds=3, depth=2)
    models.save_boosted(m, ["a", "b"], f"{tmp_path}/m", {"fpr_1pct": 0.25})
    again, thresholds = models.load_boosted(f"{tmp_path}/m", ["a", "b"])
    assert thresholds == {"fpr_1pct": 0.25}
    score = lambda m: [r["score"] for r in models.boosted_score(df, m).collect()]
    assert score(again) == score(m)
    with pytest.raises(ValueError, match="other features"):
        models.load_boosted(f"{tmp_path}/m", ["b", "a"])
    c = models.boosted_contributions(df, m)
    sizes = models.mean_sizes(c, "contributions", ["a", "b"]).collect()
    brute = np.abs(np.array([r["contributions"] for r in c.collect()])).mean(axis=0)
    assert [r["feature"] for r in sizes] == ["a", "b"] and np.allclose([r["mean_size"] for r in sizes], brute)
    assert models.without(["a", "b"], ["a"]) == ["b"]


def test_density_clusters_and_noise(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[20.0, 20.0], [-20.0, 3.0]]])
    df = spark.createDataFrame([(i, p.tolist(), int(i >= 40)) for i, p in enumerate(points)], "id long, v array<double>, label int")
    got = density.density_clusters(df, "id", "v", 1.0).collect()
    by = {r["id"]: r["cluster"] for r in got}
    assert {by[i] for i in range(40)} != {by[i] for i in range(40, 80)} and len({by[i] for i in range(40)}) == len({by[i] for i in range(40, 80)}) == 1
    assert by[80] == by[81] == -1
    c = spark.createDataFrame(list(by.items()), "id long, cluster long").join(df, "id")
    assert abs(models.noise_share(c, "cluster").first()["noise"] - 2 / 82) < 1e-12
    assert models.with_noise(c, "id", "cluster", True).select("cluster").distinct().count() == 4 and models.with_noise(c, "id", "cluster", False).select("cluster").distinct().count() == 3


def test_string_rules(spark):
    group = [(k, ["marker one", "marker two", "GetProcThing", "rare" + "x" * k, "short", "shared text", "in header"], "xx in header yy") for k in range(5)]
    g = spark.createDataFrame(group, "sample long, strings array<string>, header string")
    benign = spark.createDataFrame([("some shared text here",), (None,)], "text string")
    names = spark.createDataFrame([("GetProcThing",)], "name string")
    got = rules.candidate_strings(g, benign, names)
    assert [(r["s"], r["support"], r["place"]) for r in got.orderBy("place").collect()] == [("marker one", 5, 1), ("marker two", 5, 2)]
    only = rules.candidate_strings(g.withColumn("strings", F.array(F.lit("GetProcThing"))), benign, names)
    assert [r["s"] for r in only.collect()] == ["GetProcThing"]
    assert rules.synthesized(got).first()["threshold"] == 1 and rules.synthesized(got.limit(0)).count() == 0
    left = spark.createDataFrame([("f", ["a"], 1)], "family string, atoms array<string>, threshold int")
    more = spark.createDataFrame([("f", ["b"], 1), ("g", ["c"], 1)], left.schema)
    assert sorted((r["family"], r["atoms"][0]) for r in rules.without_abstention(left, more).collect()) == [("f", "a"), ("g", "c")]


def test_documents_are_strict_json(spark):
    df = spark.createDataFrame([("s", "BENIGN", float("nan"), 0.5)], "sha256 string, verdict string, score double, other double")
    assert json.loads(policy.as_json(df, "sha256").first()["document"]) == {"sha256": "s", "verdict": "BENIGN", "score": None, "other": 0.5}


def test_archives_and_benign_files(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("in/a.exe", corpus.sample("benign", 1))
        z.writestr("b.dll", b"no program")
        z.writestr("c.txt", b"MZ")
    df = spark.createDataFrame([("x.whl", bytearray(b.getvalue())), ("y.whl", bytearray(b"broken")), ("z.whl", None)], "path string, content binary")
    assert [(r["path"], r["member"]) for r in files.archive_members(df).collect()] == [("x.whl", "in/a.exe")]
    for n in ("a.exe", "b.sys", "c.scr"):
        (tmp_path / n).write_bytes(corpus.sample("benign", 2))
    names = lambda d: sorted(r["path"].rsplit("/", 1)[1] for r in d.collect())
    assert names(files.benign_files(spark, str(tmp_path), limit=2)) == ["a.exe", "b.sys"] and names(files.benign_files(spark, str(tmp_path), limit=0)) == ["a.exe", "b.sys", "c.scr"]
    assert names(files.benign_programs(spark, str(tmp_path))) == ["a.exe", "b.sys"]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("p", "MALICIOUS", 0.9, True, True, [{"attack_id": "T1"}], None, "fam", ["T1"], ["odd"])], "path string, verdict string, score double, packed boolean, route boolean, capabilities array<struct<attack_id:string>>, error string, family string, techniques array<string>, notes array<string>")
    assert files.write_scan(t, f"{tmp_path}/scan").collect()[0]["n"] == 1
    assert spark.read.json(f"{tmp_path}/scan").first()["capabilities"] == ["T1"]
    assert "MALICIOUS 0.9000 fam" in files.analysis_text(t).first()["report"]
    files.write_rules(spark.createDataFrame([("rule a {}",)], "text string"), f"{tmp_path}/rules")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/rules").collect()) == ['import "pe"', "rule a {}"]
    x = spark.createDataFrame([("d", "train", 1.0), ("d", "test", 2.0)], "dataset string, split string, x double")
    files.write_features(x.drop("dataset"), f"{tmp_path}/f")
    x.write.partitionBy("dataset", "split").parquet(f"{tmp_path}/two")
    assert [r["x"] for r in files.features_of(spark, f"{tmp_path}/two", "d", "test").collect()] == [2.0]
    files.write_corpus(spark.createDataFrame([("f", 1, bytearray(b"MZ"))], "family string, number int, content binary"), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").first()["family"] == "f"
    files.write_result(spark.createDataFrame([(float("inf"), 1)], "a double, b int"), f"{tmp_path}/r", "run")
    got = json.loads(spark.read.text(f"{tmp_path}/r").first()["value"])
    assert got["a"] is None and got["b"] == 1 and got["provenance"]["command"] == "run"


def test_registered_functions(spark):
    from sievewright.functions import registered

    registered.register(spark)
    assert spark.sql("SELECT murmur3_signed('hello') AS h").first()["h"] == 0x248BFA47
    assert sum(spark.sql("SELECT byte_entropy_hist(encode('abc', 'UTF-8')) AS h").first()["h"]) == 3
    spark.createDataFrame([(bytearray(corpus.sample("benign", 0)),), (bytearray(b"no"),)], "content binary").createOrReplaceTempView("programs")
    assert [r["name"] for r in spark.sql("SELECT s.name FROM programs, LATERAL pe_sections(content) s ORDER BY virtual_address").collect()] == [".text", ".rdata"]


def test_donors_are_fixed(spark):
    t, d = spark.createDataFrame([(k,) for k in range(50)], "k long"), spark.createDataFrame([(k, k * 2) for k in range(7)], "k long, v long")
    pick = lambda: {r["k"]: r["donor"]["v"] for r in robustness.with_donors(t, d, "k", 1).collect()}
    assert len(pick()) == 50 and pick() == pick() and len(set(pick().values())) > 3


def test_streams_by_digest_and_by_folder(spark, tmp_path):
    from sievewright.streaming import monitor

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.exe").write_bytes(corpus.sample("benign", 3))
    (tmp_path / "in/b.exe").write_bytes(b"MZ")
    got = []
    q = monitor.watch(spark, f"{tmp_path}/in", lambda df, _: got.extend(df.select(F.col("report").isNull().alias("bad")).collect()), f"{tmp_path}/state")
    q.awaitTermination()
    assert sorted(r["bad"] for r in got) == [False, True]
    spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 02:00:00")], "sha256 string, t string").selectExpr("sha256", "CAST(t AS TIMESTAMP) AS seen_at").write.parquet(f"{tmp_path}/seen")
    stream = spark.readStream.schema("sha256 string, seen_at timestamp").parquet(f"{tmp_path}/seen")
    first = []
    monitor.first_seen(stream).writeStream.foreachBatch(lambda df, _: first.extend(r["sha256"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/seenstate").trigger(availableNow=True).start().awaitTermination()
    assert sorted(first) == ["x", "y"]


def test_small_operators(spark):
    from sievewright.functions import rule_text
    from sievewright.operators import drift
    from sievewright.sources import pe, records

    df = spark.createDataFrame([(k, k >= 8) for k in range(10)], "k int, extreme boolean")
    assert evaluation.monte_carlo_p(df, F.col("extreme")).first()["p"] == pytest.approx(3 / 11)
    r = lambda names: spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, rank int")
    assert [x["feature"] for x in drift.top_overlap([r("abc"), r("bca"), r("bac")], 2).collect()] == ["b"]
    atoms = spark.createDataFrame([([("imp", "k.dll", "F"), ("sec", "x", None), ("hash", "ab", None)],)], "atoms array<struct<kind:string,a:string,b:string>>")
    text = atoms.select(rule_text.structural(F.lit("a b"), F.col("atoms"), F.lit("2")).alias("t")).first()["t"]
    assert text.startswith("rule a_b\n") and "2 of (" in text and 'pe.imports("k.dll", "F")' in text and 'pe.imphash() == "ab"' in text
    rec = records.from_reports(pe.dissected(corpus.corpus(spark, 1))).select(records.reduced(F.col("record")).alias("r")).schema["r"].dataType
    assert "histogram" not in rec.names and "printabledist" not in rec["strings"].dataType.names
    with pytest.raises(Exception, match="no strings"):
        rule_text.parsed(spark, {"none": "rule none {\n condition: all of them\n}"}).collect()
    many = 'rule m {\n strings:\n $a = "one"\n' + " " * 9_000 + '$b = "long line"\n $c = "t\\"wo" nocase\n condition: any of them\n}'
    assert rule_text.parsed(spark, {"m": many}).first()[1:] == (1, ["one", 't"wo'])


def test_statistical_aggregates_keep_no_percentile_by_part(spark):
    """A distinct count in the same grouping would keep a percentile for each flag and part."""
    from sievewright.plans import catalog

    plan = catalog.QUERIES["statistical_aggregates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("percentile" in line and "l_partkey" in line for line in plan.splitlines() if "Aggregate" in line)


def test_hashed_tokens_take_bounded_pieces(spark, monkeypatch):
    """Pieces of a batch hold about as many tokens as allowed, and all rows come through whole."""
    import pyarrow as pa

    from sievewright.functions import hashing

    lists = [["a"] * 7, None, [], ["b"] * 30, ["c", None, "d"], ["e"] * 9]
    pieces = list(hashing._pieces(pa.RecordBatch.from_pydict({"x": lists}), "x", 10))
    assert [r for p in pieces for r in p.column("x").to_pylist()] == lists
    assert all(p.num_rows == 1 or sum(len(r or ()) for r in p.column("x").to_pylist()) <= 10 for p in pieces)


def test_only_supported_atoms_of_the_others_are_kept(spark, monkeypatch):
    """The others' atoms are counted only where the group has them often enough; all of these are, samples in several rows once."""
    from sievewright.plans import mining

    words = [(1, "fr", "dans pour seul"), (2, "fr", "dans pour"), (3, "fr", "dans avec"), (4, "fr", "dans"), (5, "en", "with house dans"), (5, "de", "dans haus"), (6, "en", "other house"), (7, "en", None)]
    docs = spark.createDataFrame(words, "doc_id long, lang string, text string")
    monkeypatch.setattr(mining, "table", lambda *_: docs)
    benign = mining._mined(spark, "")[2]
    assert sorted(map(tuple, benign.select("sample", "atom").distinct().collect())) == [(5, "dans")]
    group, others = (docs.filter(c).select(F.col("doc_id").alias("sample"), F.explode(F.split("text", " ")).alias("atom")) for c in ("lang = 'fr'", "lang <> 'fr'"))
    got = rules.mined(group, others, 4, 4, support=0.5, rate=0.5)
    assert [tuple(r) for r in got.orderBy("place").collect()] == [("pour", 2, 0, 1), ("dans", 4, 1, 2)]
