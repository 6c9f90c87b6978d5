"""The pipeline against a brute-force version, stage by stage."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_operators import WORD, brute_components  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    clean = lambda k: ". ".join(" ".join(f"word{(k * 31 + i * j) % 211}" for j in range(1, 9)) for i in range(1, 11)) + "."
    rows = [(k, clean(k), "en", ["a", "b", None][k % 3], 1) for k in range(40)]
    rows += [(100 + k, rows[k][1].replace(" ", "\n"), "en", "a", 1) for k in range(5)]
    rows += [(200 + k, rows[k][1] + " final words", "en", "b", 1) for k in range(5, 10)]
    rows += [(300, "too short", "en", "a", 1), (301, None, None, None, None), (302, "### junk *** " * 40, "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(302, 0, 0), (300, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r["doc_id"] for r in docs.collect()})
    rules, exact, near, _ = seen
    assert set(range(40)) <= rules and not rules & {300, 301, 302}
    assert exact == {i for i in rules if not 100 <= i < 105}
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["doc_id"] in exact]
    assert near == {i for i, _, c, kept in brute_components(data, 5) if kept}
    words = lambda df: sum(len(WORD.findall(r["text"])) for r in df.collect())
    before = sum(len(WORD.findall(t)) for i, t in data if i in near)
    assert abs(words(docs) - 1.5 * before) <= 3
    encoded = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert encoded.count() == docs.count() and {"doc_id", "ids", "n_tokens"} <= set(encoded.columns)
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, ran.select("doc_id", "ids_sha256").collect())) == sorted(map(str, encoded.select("doc_id", "ids_sha256").collect()))


def test_truncated_copies_are_prefixes(spark, folder):
    from sievewright.llm import mixing

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixing.mix_stage(docs).collect():
        assert whole[r["doc_id"]].startswith(r["text"]) and re.search(r"\S", r["text"])


def test_null_and_repeated_ids_lose_no_other_text(spark, tmp_path):
    """Each stage decides by row: a copy, near copy or junk row takes none of its namesakes with it, and copies go whatever their ids."""
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(60))
    stages = dict(corpus_pipeline.STAGES)
    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(labels)

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
        return sorted(((r["doc_id"], r["text"], r["source"]) for r in stages[stage](spark, docs, str(tmp_path)).collect()), key=str)

    clean = [(None, text(1), "a"), (None, text(2), "a"), (7, text(3), "a")]
    assert left("quality rules", [*clean, (None, "junk", "a"), (7, "too short", "a"), (None, None, "a")]) == sorted(clean, key=str)
    copies = [(None, text(4), "a"), (7, text(4), "a"), (None, text(5).replace(" ", "\n"), "b"), (8, text(6), "b")]
    rows = [*clean, (4, text(4), "a"), *copies, (None, text(5), "a"), (8, text(6), "a"), (8, text(6), "a")]
    assert left("exact dedup", rows) == sorted([*clean, (4, text(4), "a"), (None, text(5).replace(" ", "\n"), "b"), (8, text(6), "a")], key=str)
    near = [(4, text(4), "a"), (7, text(4) + " end", "a"), (None, text(4) + " other", "a"), (9, text(5), "a"), (9, text(5) + " end", "a")]
    got = left("near dedup", [*clean, *near])
    assert len(got) == 5 and set(got) > {*clean, near[0]} and {r for r in got if r[0] == 9} < set(near)


def test_mix_gives_whole_documents_near_the_targets(spark):
    from sievewright.llm import mixing

    size = lambda k: 40 + k * 7 % 60
    rows = [(None if k % 9 == 0 else k % 70, " ".join(f"m{k}x{i}" for i in range(size(k))), "abc"[k % 3], size(k)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = [tuple(r) for r in mixing.mix_stage(docs).collect()]
    assert set(got) <= set(rows)
    for r in mixing.mixed(mixing.measured(docs)).select("source", "target").distinct().collect():
        assert abs(sum(n for *_, s, n in got if s == r["source"]) - r["target"]) <= 50.5
    low = [(k, " ".join(f"l{k}x{i}" for i in range(size(k))), s, size(k)) for k, s in enumerate("a" * 10 + "b" * 10 + "c" * 100)]
    got = [tuple(r) for r in mixing.mix_stage(spark.createDataFrame(low, docs.schema)).collect()]
    assert set(got) <= set(low) and len(got) > 100


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names that helpers might use, names with dots and marks, nested types: all come through, from every stage, with and without rows."""
    text = lambda k: " ".join(f"c{k}x{i}" for i in range(60))
    names = ["_word", "_p", "_maybe", "_bits", "_id", "_key", "_row", "_text", "p_id", "p_size", "p_copy", "row", "key", "num", "copy", "copies", "planned", "rid", "part", "sha", "a.b", "tick`s", "size", "token", "kept"]
    rows = [(k, t, "en", s, len(t or ""), [k], *([k] * len(names))) for k, (t, s) in enumerate([(text(1), "a"), (text(1), "a"), (text(2), "b"), (text(2) + " end", None), (text(3), "a"), ("short", "a"), ("", "b"), (None, None), (" ".join(f"l{i % 4099}" for i in range(40_000)), "b")])]
    rows += [rows[4], (None, text(4), "en", "a", 9, None, *([0] * len(names)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, nested array<long>, " + ", ".join("`" + n.replace("`", "``") + "` long" for n in names)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(k, k % 2, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        got = stage(spark, docs, str(tmp_path))
        assert none.count() == 0 and none.columns == got.columns, name
        if name != "byte-level BPE":
            assert got.schema == docs.schema, name
            out = [tuple(r) for r in got.collect()]
            assert out and all(r in rows for r in out), name
            ids = {r[0] for r in out}
            assert {"quality rules": ids.isdisjoint({5, 6, 7}), "exact dedup": ids == {None, 0, 2, 3, 4, 5, 6, 8} and len(out) == 8, "near dedup": ids == {None, 0, 2, 4, 5, 6, 7, 8}, "source mixing": None in ids and 6 not in ids}[name], (name, ids)
        else:
            assert got.count() == len(rows)


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from sievewright.llm import common

    far = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(sparkContext=far, conf=SimpleNamespace(get=lambda *_: None)))
