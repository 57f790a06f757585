import zlib

import numpy as np
from helpers import ODD_TEXTS, empty, odd

from rasterbrook.llm import langid


def test_held_out_accuracy_on_the_whole_table(spark, sf_dir):
    rows = langid.query(spark, sf_dir).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not langid.has_letter(lang[r.doc_id][1])) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    hits = [r.lang_pred == lang[r.doc_id][0] for r in held]
    assert np.mean(hits) > 0.95
    assert abs(np.mean(hits) - np.mean([r.score for r in held])) < 0.05  # calibrated


def test_features_are_counts_of_all_ngrams():
    places, counts = langid.features("Aa, b")
    # " a", "aa", ... of " aa b "
    text = " aa b "
    assert counts.sum() == sum(len(text) - n + 1 for n in (1, 2, 3))
    assert len(places) <= counts.sum() and (np.diff(places) > 0).all()


def test_bands_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    for text in ["", "a", "  !", "Some words, and  others 12 ñandú", "".join(rng.choice(list("ab  ,ñ漢Z"), 500))]:
        want = langid.features(text)
        for band in (1, 2, 3, 7):
            monkeypatch.setattr(langid, "BAND", band)
            got = langid.features(text)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        monkeypatch.undo()


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_WEIGHTS", 1 << 12)
    rows = [(i, f"{'abcdefghij'[i % 10] * 4} {'klmnopqrst'[i // 10 % 10] * 4}", f"l{i % 300}") for i in range(900)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300 and model.weights.size <= (1 << 12) + 300
    assert model.predict("aaaa kkkk")[0] in model.langs


def test_invalid_utf8(spark):
    model = langid.Model(["a"], np.ones(4))
    docs = spark.sql("SELECT 1 AS doc_id, cast(unhex('FF20C3') AS string) AS text UNION ALL SELECT 2, cast(unhex('FF6162') AS string)")
    assert sorted(r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), model).collect()) == ["a", "und"]


def test_learns_by_the_stated_steps():
    """One step of follow-the-regularised-leader against the formula, coordinate by coordinate."""
    model = langid.Model(["a", "b"], np.ones(4))
    model.fit([(np.array([1]), np.array([3]), 0)], epochs=1)
    g = np.array([-0.5, 0.5])
    z = g
    w = -(z - np.sign(z) * langid.L1) / ((langid.BETA + np.abs(g)) / langid.ALPHA + langid.L2)
    assert np.allclose(model.weights[1], w) and np.allclose(model.weights[-1], w) and not model.weights[0].any()


def test_temperature_minimises_the_loss():
    model = langid.Model(["a", "b"], np.ones(2))
    sure = [(np.array([8.0, 0.0]), i % 4 == 0 and 1 or 0) for i in range(400)]
    model._calibrate(sure)
    assert abs(1 / (1 + np.exp(-8 / model.temperature)) - 0.75) < 0.03


def test_odd_rows(spark):
    docs = odd(spark)
    model = langid.train(spark.createDataFrame([(i, t, x) for i in range(30) for t, x in (("the cat and the dog", "en"), ("der hund und die katze", "de"))] + [(1, None, "en"), (None, "le chat", "fr"), (3, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    out = langid.identify(docs, model).collect()
    assert len(out) == 2 * len(ODD_TEXTS) + 1
    for r in out:
        assert (r.lang_pred == "und") == (not langid.has_letter(r.row.text)) and 0 <= r.score <= 1
    assert model.predict("the dog and the cat")[0] == "en" and model.predict("die katze und der hund")[0] == "de"
    kept = langid.known_language(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(langid.has_letter(t) for t in ODD_TEXTS) * 2 + 1


def test_empty(spark):
    model = langid.trained_on(empty(spark))
    assert langid.identify(empty(spark), model).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.identify(odd(spark), model).collect()} == {("und", 0.0)}
