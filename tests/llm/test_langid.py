"""Language ID: held-out accuracy and rows without a language."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loanlag.llm import hyper_langid, queries
from tests.conftest import SF001
from tests.llm.helpers import EDGE, docs_of


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op8_hyper_langid(spark, SF001).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)


def test_edge_rows(spark):
    got = hyper_langid.identify(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    texts = {}
    for d, t, *_ in EDGE:
        texts.setdefault(d, []).append(t)
    for r in got:
        wordless = [not any(c.isalpha() for c in t or "") for t in texts[r.doc_id]]
        assert r.lang_pred in (("und",) if all(wordless) else ("en", "de", "und") if any(wordless) else ("en", "de"))
    assert all(not r.held_out for r in got if r.doc_id is None)


def test_nothing_to_learn_from(spark):
    assert hyper_langid.identify(docs_of(spark, [])).count() == 0
    rows = hyper_langid.identify(docs_of(spark, [(1, "some text", None), (2, None, "en")])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2


def test_learning_uses_no_held_out_rows_and_is_bounded(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "xyz zyx " * 3, "held") for i in ids] + [(i, f"abc{i} cab", "seen") for i in range(400) if i not in ids]
    assert set(hyper_langid.learn(docs_of(spark, rows).where(~hyper_langid.held_out("doc_id")))) == {"seen"}
    df = docs_of(spark, rows)
    assert {r.lang_pred for r in hyper_langid.identify(df).collect()} == {"seen"}
    few = hyper_langid.learn(df, per_language=1)
    assert set(few) == {"held", "seen"}


def test_predictions_are_the_same_on_every_run(spark):
    once, again = (sorted(map(tuple, queries.op8_hyper_langid(spark, SF001).collect())) for _ in range(2))
    assert once == again


def bundle(text, letter, dimensions):
    """A text's sum of rotated and multiplied letter vectors, number by number; None without letters."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    if not low.strip():
        return None
    padded = " " + " ".join(low.split()) + " "
    total = [0] * dimensions
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        x, y, z = letter(a), letter(b), letter(c)
        for i in range(dimensions):
            total[i] += x[i - 2] * y[i - 1] * z[i]
    return total


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))


def test_predictions_equal_plain_python(spark):
    dimensions, known = 256, {}

    def letter(c):
        if c not in known:
            signs = np.random.default_rng([hyper_langid.SEED, ord(c)]).integers(0, 2, dimensions, dtype=np.int8)
            known[c] = [1 if s else -1 for s in signs.tolist()]
        return known[c]

    texts = [("the cat sat on the mat, and THE dog ran", "en"), ("with this and that; the other thing", "en"), ("der Hund und die Katze laufen", "de"),
             ("und dann ist das Ende da 12", "de"), ("le chat et le chien", "fr"), ("l'\u00e9t\u00e9 est fini", "fr"), ("aaaa", "fr")]
    asked = ["the dog and the cat", "die Katze und das Ende", "le chien est fini", "x", "1234 !", "", None, "\u65e5\u672c\u8a9e the", "aaaa aaaa"]
    sums = defaultdict(lambda: [0] * dimensions)
    for text, lang in texts:
        v = bundle(text, letter, dimensions)
        norm = math.sqrt(sum(a * a for a in v))
        sums[lang] = [a + b / norm for a, b in zip(sums[lang], v)]
    learned = hyper_langid.learn(docs_of(spark, [(i, t, lang) for i, (t, lang) in enumerate(texts)]), dimensions=dimensions)
    assert set(learned) == set(sums)
    assert all(cosine(learned[x].tolist(), sums[x]) > 1 - 1e-6 for x in sums)
    got = {r.doc_id: r for r in hyper_langid.predict(docs_of(spark, list(enumerate(asked))), learned, keep=["doc_id"]).collect()}
    for i, text in enumerate(asked):
        v = bundle(text or "", letter, dimensions)
        score, lang = (0.0, "und") if v is None else max((cosine(v, sums[x]), x) for x in sums)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(max(score, 0.0), abs=3e-6)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(hyper_langid, "MAX_LANGUAGES", 2)
    rows = [(i, f"some text {i}", lang) for i, lang in enumerate(["a", "b", "c"])]
    assert set(hyper_langid.learn(docs_of(spark, rows[:2]))) == {"a", "b"}
    with pytest.raises(ValueError, match="lang"):
        hyper_langid.learn(docs_of(spark, rows))
