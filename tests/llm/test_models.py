import random
import zlib

import numpy as np
import pytest

from nearfield.llm import language, quality, toxicity
from tests.llm.common import ODD, empty, odd


def fold_of(i, n):
    return zlib.crc32(str(i).encode()) % n


def made_up(seed, n=900):
    """Texts of two made-up languages; toxic ones hold an insult, or in the second language a stem; bad ones repeat."""
    rng = random.Random(seed)
    syllables = {"xx": ["ba", "do", "ki", "lu", "men", "tor"], "yy": ["zsa", "vék", "ő", "gya", "nyu", "pel"]}
    rows, labels = [], []
    for k in range(n):
        lang = "xx" if k % 2 else "yy"
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() > 0.3)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scуm", "m0ron"]) if lang == "xx" else "rossz" + rng.choice(syllables["yy"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), lang))
        labels.append((k, good, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = made_up(1)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), rows, labels


def accuracy(got, labels, column, held):
    truth = {i: (q, t)[column] for i, q, t in labels}
    rows = [r for r in got if r.held_out == held]
    assert rows and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    return np.mean([r.predicted == truth[r.doc_id] for r in rows])


def test_toxicity_held_out(tables):
    docs, labels, rows, truth = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(r.held_out == (fold_of(r.doc_id, 5) == 0) for r in got)
    assert accuracy(got, truth, 1, True) > 0.97


def test_toxicity_learns_stems_and_ignores_held_out_labels(spark, tables):
    docs, labels, _, truth = tables
    lexicon = toxicity.learn_lexicon(docs, labels)
    assert any(t.startswith("rossz") and t.endswith("*") for t in lexicon.weights)
    flipped = [(i, q, 1 - t if fold_of(i, 5) == 0 else t) for i, q, t in truth]
    again = toxicity.learn_lexicon(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert again == lexicon


def test_folding():
    f = toxicity.skeleton
    assert f("IDIOT") == f("1d10t") == f("іdіot") == f("id​iot") == f("ｉｄｉｏｔ") == "idiot"
    assert f("$tup1d") == "stupid" and f("l0ser") == f("1oser") == "ioser"
    assert f("idiot!! a$$$ 2048 été") == "idiot!! a$$$ 2048 été"


def test_matches_by_brute_force():
    lexicon = toxicity.Lexicon({"scum": 2.0, "idio*": 3.0, "idiot": 4.0}, {"pond scum"})
    automaton = lexicon.automaton()
    rng = random.Random(3)
    for _ in range(200):
        text = toxicity.skeleton(" ".join(rng.choice(["scum", "pond", "idiots", "idiot", "scumx", "xscum", "scum."]) for _ in range(12)))
        found = sorted((s, e, w) for s, e, _, w in toxicity.matches(text, automaton))
        want, at = [], 0
        words = text.split(" ")
        for k, word in enumerate(words):
            bare = word.rstrip(".")
            if bare == "scum" and not (k and words[k - 1] == "pond" and words[k] in ("scum", "scum.")):
                want.append((at, at + 4, 2.0))
            elif bare == "idiot":
                want.append((at, at + 5, 4.0))
            elif bare.startswith("idio"):
                want.append((at, at + 4, 3.0))
            at += len(word) + 1
        assert found == want


def test_quality_held_out(tables):
    docs, labels, rows, truth = tables
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(r.held_out == (fold_of(r.doc_id, 3) == 1) for r in got)
    assert accuracy(got, truth, 0, True) > 0.97


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel.fit(x[:3000], y[:3000], np.ones(3000))
    assert {0, 1} == set(model.pairs[0][:2]) or any({i, j} == {0, 1} for i, j, _ in model.pairs)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    total = np.full(1000, model.intercept)  # scored one by one from the tables
    for n, row in enumerate(x[3000:]):
        total[n] += sum(t[np.searchsorted(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total[n] += sum(t[np.searchsorted(model.pair_edges[i], row[i]), np.searchsorted(model.pair_edges[j], row[j])] for i, j, t in model.pairs)
    assert np.allclose(model.score(x[3000:]), 1 / (1 + np.exp(-total)))


def test_features_do_not_depend_on_windows(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["one", "Two,", "three!!", "4", "five.\nsix"]) for _ in range(3000))
    want = quality.features(text)
    assert "".join(quality.windows(text, 100)) == text
    cut = quality.windows
    monkeypatch.setattr(quality, "windows", lambda t: cut(t, 97))
    got = quality.features(text)
    for name, a, b in zip(quality.FEATURES, want, got, strict=True):
        assert a == pytest.approx(b, abs=0.02), name


def test_language_held_out(tables):
    docs, _, rows, _ = tables
    got = language.language_id(docs).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(got) == len(rows) and all(r.held_out == (fold_of(r.doc_id, 3) == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.98


def test_ngrams_by_brute_force():
    texts = ["Ab c1d", "", "  x", "été à"]
    hashes, owners = language.ngrams(texts)
    for k, text in enumerate(texts):
        plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in plain:
            plain = plain.replace("  ", " ")
        want = sum(max(0, len(plain) - n + 1) for n in language.ORDERS)
        assert (owners == k).sum() == want
    one = language.ngrams(["Ab c1d"])[0]
    assert set(one) == set(hashes[owners == 0])


def test_filters_answer_for_all_languages():
    rng = np.random.default_rng(6)
    profiles = {f"l{k}": rng.integers(0, 2**63, 500).astype(np.uint64) for k in range(70)}
    filters = language.Filters.build(profiles, 1 << 16)
    total, found = filters.counts(profiles["l69"], np.zeros(500, np.int64), 1)
    assert total[0] == 500 and found[0, filters.languages.index("l69")] == 500
    assert found[0].sum() - 500 < 69 * 500 * filters.false_rate().max() * 2 + 20


def test_long_texts_lose_no_ngram():
    text = "abc dé fgh " * 500
    whole = np.sort(language.ngrams([text])[0])
    parts = np.concatenate([language.ngrams(p)[0] for _, p in language.blocks([text], 300)])
    assert set(whole) <= set(parts)


def test_odd_rows(spark, tables):
    docs, labels, _, _ = tables
    lexicon, model, filters = toxicity.learn_lexicon(docs, labels), quality.learn_quality(docs, labels), language.learn_filters(docs)
    ids = sorted((i for i, _, _ in ODD), key=repr)
    for got in (toxicity.score_toxicity(odd(spark), lexicon), toxicity.score_toxicity(odd(spark), lexicon, spans=True), quality.score_quality(odd(spark), model), quality.score_quality(odd(spark), None), language.identify(odd(spark), filters)):
        rows = got.collect()
        assert sorted((r.doc_id for r in rows), key=repr) == ids and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in language.identify(odd(spark), filters).collect()}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (3, 4, 5, 12))
    assert next(r for r in toxicity.score_toxicity(odd(spark), lexicon).collect() if r.doc_id == 15).predicted == 1
    kept = quality.keep_good(odd(spark), model)
    assert kept.columns == odd(spark).columns
    assert quality.keep_good(odd(spark), None).count() == len(ODD)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd(spark), none).count() == len(ODD)
    assert {r.score for r in quality.quality(odd(spark), none).collect()} == {0.5}
    assert language.language_id(empty(spark)).count() == 0
    assert {r.lang_pred for r in language.identify(odd(spark), language.Filters.build({})).collect()} == {"und"}
    assert toxicity.toxicity(empty(spark), none).count() == quality.quality(empty(spark), none).count() == 0


def test_a_language_with_one_or_two_texts_is_learned(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % language.FOLDS != language.HELD_OUT]
    texts = [*[("en", "the weather is fine and the river runs high")] * 5, ("fi", "sää on kaunis ja joki virtaa"), ("cs", "dnes prší"), ("cs", "zítra bude hezky")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in zip(ids, texts)], "doc_id long, text string, lang string")
    filters = language.learn_filters(docs)
    assert filters.languages == ["cs", "en", "fi"]
    got = language.identify(spark.createDataFrame([(1, "kaunis joki"), (2, "the river"), (3, "zítra prší")], "doc_id long, text string"), filters).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "fi", 2: "en", 3: "cs"}
