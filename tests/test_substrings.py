"""Strings that no text contains, against looking for each in every text."""

import random

from sievewright.operators import substrings


def test_equals_looking_everywhere(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 3)
    r = random.Random(2)
    letters = "ab cdé日😀"
    texts = ["".join(r.choices(letters, k=r.randint(0, 80))) for _ in range(150)]
    texts += [None, "", "short", "the same text of copies"] + ["the same text of copies"] * 40
    strings = {"".join(r.choices(letters, k=r.randint(4, 9))) for _ in range(400)}
    for t in texts:
        if t and len(t) > 12:
            k = r.randrange(len(t) - 11)
            strings |= {t[k : k + r.randint(5, 12)], t[k : k + 8] + "z"}
    df = spark.createDataFrame([(t, 1, 2) for t in texts], "text string, digest int, gram int").repartition(4)
    s = spark.createDataFrame([(x, "k") for x in [*strings, None]], "s string, gram string")
    got = {x["s"] for x in substrings.absent_strings(s, df, "text").collect()}
    assert got == {x for x in strings if len(x) >= 6 and not any(t and x in t for t in texts)}
    assert {x["s"] for x in substrings.held_strings(s, df, "text").collect()} == {x for x in strings if len(x) >= 6} - got


def test_no_texts_and_no_strings(spark):
    s, t = spark.createDataFrame([("abcdefg",)], "s string"), spark.createDataFrame([("xx abcdefg",)], "text string")
    assert [x["s"] for x in substrings.absent_strings(s, t.limit(0), "text").collect()] == ["abcdefg"]
    assert substrings.absent_strings(s.limit(0), t, "text").collect() == [] == substrings.absent_strings(s, t, "text").collect()


def test_few_texts_are_held_at_a_time():
    """Spark's batches have up to 10,000 texts; what is found in them leaves after ``TEXTS`` of them."""
    import hashlib
    from types import SimpleNamespace

    import pyarrow as pa

    kernels = []
    texts = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: kernels.append(run)))
    substrings._held(texts, "text", SimpleNamespace(value=b"\xff" * (substrings.BITS // 8)))
    lines = [f"text number {i}" for i in range(1000)] + [None, "short"]
    out = list(kernels[0]([pa.RecordBatch.from_arrays([pa.array(lines)], ["text"])]))
    assert max(len(set(b.column("digest").to_pylist())) for b in out) <= 256
    got = sorted(x for b in out for x in zip(b.column("digest").to_pylist(), b.column("gram").to_pylist()))
    assert got == sorted((hashlib.md5(t.encode()).digest(), int(g)) for t in lines[:1000] for g in set(substrings.grams(t).tolist()))
