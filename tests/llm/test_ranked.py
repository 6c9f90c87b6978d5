"""Ranked search against a plain scoring of every document, with ties, repeats, nulls, small blocks and several slices of items."""

import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from sievewright.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=10):
    """Rows of every item by scoring every document."""
    texts = [(i, words(t)) for i, t in docs]
    texts = [(i, w, Counter(w)) for i, w in texts if w]
    n, length = len(texts), sum(len(w) for _, w, _ in texts)
    df = Counter(t for _, _, c in texts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = Counter(words(text)), []
        for i, w, c in texts:
            m = 25 + 75 * len(w) * n // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(5)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(500)]
    docs += [(i + 1000, docs[7][1]) for i in range(40)] + [docs[3], docs[3], (None, docs[9][1]), (None, docs[9][1]), (2000, None), (2001, " ,;\n"), (2002, "Été DÉJÀ w1\x00w2-W3 " * 500)]
    items = [(k, " ".join(r.choices(vocabulary, k=12))) for k in range(30)] + [(90, docs[7][1]), (90, docs[7][1]), (90, "été w3"), (91, None), (92, ""), (None, "w1 w1 W1"), (93, "nowhere at all")]
    return docs, items


def frames(spark, docs, items, parts=4):
    return spark.createDataFrame([(*d, "a", 1, 2) for d in docs], "doc_id long, text string, item string, score int, rank int").repartition(parts), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("sizes", [{}, {"words": 300, "most": 40}, {"most": 7}, {"size": 200, "words": 2000}])
def test_equals_scoring_every_document(spark, tables, sizes):
    docs, items = tables
    got = [tuple(r) for r in ranked.search(*frames(spark, docs, items), **sizes).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == plain(docs, items)


def test_sql_agrees(tables):
    docs, items = tables
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert sorted(con.execute(ranked.OP13_SQL).fetchall(), key=str) == plain(docs, items)


def test_nothing(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert ranked.search(*frames(spark, [], items)).collect() == []
    assert ranked.search(*frames(spark, docs, [])).collect() == []
    assert [tuple(r) for r in ranked.search(*frames(spark, docs, items)).collect()] == plain(docs, items)
