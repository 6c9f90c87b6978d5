"""The language network's predictions against reading byte by byte, odd rows included."""

import numpy as np
import pytest

from sievewright.llm import language_id
from sievewright.llm.language_id import CONTEXT, WINDOW, ByteGru


def plain(net, d):
    """Mean probabilities over all bytes of a text, one byte and one state at a time."""
    n, total = net.units, np.zeros(len(net.languages))

    def step(h, byte, side):
        e, u = net.p["e" + side][:, byte].astype(float), net.p["u" + side].astype(float)
        q = np.stack([h @ u[k] for k in range(3)])
        z, r = np.clip(e[:2] + 0.5 + q[:2], 0, 1)
        c = np.tanh(e[2] + r * q[2])
        return h + z * (c - h)

    for first in range(0, len(d), WINDOW):
        window = [d[k] if 0 <= k < len(d) else 32 for k in range(first - CONTEXT, first + WINDOW + CONTEXT)]
        states = {}
        for side, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h = np.zeros(n)
            for k in order:
                h = step(h, window[k], side)
                states[side, k] = h
        for k in range(CONTEXT, CONTEXT + min(WINDOW, len(d) - first)):
            a = states["f", k] @ net.p["w"][:n] + states["b", k] @ net.p["w"][n:] + net.p["c"]
            a = np.exp(a - a.max())
            total += a / a.sum()
    return total / len(d)


TEXTS = ["The ship came in.", "Größe und Maß " * 20, "é", "日本語のテキスト", "x" * 500, "a " * 97, "l'été est là " * 8, " \n\t!?", "", None, "12345", "The ship came in."]


@pytest.fixture(scope="module")
def net():
    net = ByteGru(["de", "en", "fr"], seed=3)
    rng = np.random.default_rng(1)
    net.p["c"] = rng.normal(size=3).astype(np.float32)
    return net


def test_documents_equal_reading_byte_by_byte(net):
    raw = [t.encode() for t in TEXTS if t]
    assert np.allclose(net.documents(raw), [plain(net, d) for d in raw], atol=1e-5)
    assert np.allclose(net.documents([b""]), 1 / 3)


def test_query_equals_reading_byte_by_byte(spark, net):
    df = spark.createDataFrame([(i, t, None, "s", 1, 0.5) for i, t in enumerate(TEXTS)] + [(None, "ohne Namen", "de", None, None, None)], "doc_id long, text string, lang string, source string, held_out int, score double").repartition(3)
    for r in language_id.identify(df, net).collect():
        text = "ohne Namen" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            p = plain(net, text.encode())
            assert r["lang_pred"] == net.languages[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=1e-5)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(df, None).collect()} == {("und", 0.0)}
