import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _learn, language_mixture, quality_fm, toxicity_counterfactual
from corpusloom.llm._learn import held_out
from tests.llm.helpers import LONG, SF, documents, empty, odd

BIG = "/root/testdata/sf0.01"


def labels(spark, sf=BIG):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("module, target, threshold, least", [(quality_fm, "quality", 0.3, 0.97), (toxicity_counterfactual, "toxic", 0.5, 0.95)])
def test_held_out_accuracy(spark, module, target, threshold, least):
    docs = documents(spark, BIG)
    model = module.train(docs, labels(spark))
    rows = module.predict(docs.select("doc_id", "text"), model).join(labels(spark), "doc_id").filter(held_out(F.col("doc_id"))).select(target, "score", "predicted").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    assert np.mean([r["predicted"] == r[target] for r in rows]) >= least


@pytest.mark.parametrize("module", [quality_fm, toxicity_counterfactual])
def test_odd_rows(spark, module):
    model = module.train(documents(spark), labels(spark, SF))
    clash = odd(spark).withColumn("score", F.lit("old")).withColumn("y", F.lit(1))
    rows = module.predict(clash, model).collect()
    assert len(rows) == odd(spark).count()
    score = {}
    for r in rows:
        assert isinstance(r["score"], float)
        assert score.setdefault(r["text"] or "", r["score"]) == r["score"]  # equal texts, null as empty
    assert module.predict(empty(spark), model).count() == 0


@pytest.mark.parametrize("module, predicted", [(quality_fm, 1), (toxicity_counterfactual, 0)])
def test_nothing_to_learn(spark, module, predicted):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = module.predict(odd(spark), module.train(odd(spark), none)).collect()
    assert {r["predicted"] for r in rows} == {predicted}


def test_sum_of_squares():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(2)
    size = quality_fm.BUCKETS + 11 * quality_fm.BINS
    model = quality_fm.Model(rng.normal(0, 1, (11, quality_fm.BINS - 1)).cumsum(axis=1), 0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, quality_fm.RANK)))
    bucket, value, stats = np.array([3, 70, 900]), np.array([0.5, 0.2, 0.7]), rng.normal(0, 1, (1, 11))
    ids = np.concatenate([bucket, quality_fm._binned(stats, model.edges)[0]])
    x = np.concatenate([value, np.full(11, 0.5)])
    z = model.w0 + model.w[ids] @ x + sum(model.v[ids[a]] @ model.v[ids[b]] * x[a] * x[b] for a in range(len(ids)) for b in range(a))
    got = quality_fm.scores(model, bucket, value, np.array([0, 3]), stats)[0]
    assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_accepted_keeps_columns(spark):
    docs = documents(spark).withColumn("predicted", F.lit("mine"))
    kept = quality_fm.accepted(docs, quality_fm.train(docs, labels(spark, SF)))
    assert kept.columns == docs.columns and kept.filter("predicted = 'mine'").count() == kept.count() > 0


def test_counterfactual_penalty():
    """A group's name that stands in many toxic sentences scores a neutral mention far less with the penalty."""
    from corpusloom.llm._text import utf8
    import pyarrow as pa

    rng = np.random.default_rng(4)
    filler = [f"word{k}" for k in range(50)]
    said = lambda *extra: " ".join([*rng.choice(filler, 8), *extra])
    insults = [a + b for a in ("scum", "vile", "filth") for b in ("ox", "ik", "uz", "em")]
    texts = [(said("muslim", insults[k % 12]), 1) for k in range(60)] + [(said(insults[k % 12]), 1) for k in range(6)] + [(said(), 0) for _ in range(70)] + [(said("christian"), 0) for _ in range(5)]
    swap = toxicity_counterfactual.swapper()

    def features(t):
        return toxicity_counterfactual.features(*utf8(pa.array([t])))[0]

    rows = [(features(t), None if swap(t) is None else features(swap(t)), y) for t, y in texts]
    neutral = features("a muslim family lives here")
    score = lambda m: toxicity_counterfactual.scores(m, neutral, np.array([0, len(neutral)]))[0]
    plain, fair = (toxicity_counterfactual.fit(rows, penalty) for penalty in (0.0, 50.0))
    assert score(plain) > 0.5 > score(fair)
    insult = features("you scumox")
    assert toxicity_counterfactual.scores(fair, insult, np.array([0, len(insult)]))[0] > 0.5


def test_swapper():
    swap = toxicity_counterfactual.swapper((("women", "men"),))
    assert swap("Women and men, womens") == "men and women, womens"
    assert swap("nobody") is None


def test_language_held_out(spark):
    docs = documents(spark, BIG)
    model = language_mixture.train(docs)
    rows = language_mixture.predict(docs, model).filter(held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97


def test_language_odd_rows(spark):
    model = language_mixture.train(documents(spark))
    rows = language_mixture.predict(odd(spark).withColumn("langs", F.lit(0)), model).collect()
    by_text = {r["text"]: r for r in rows}
    assert all(by_text[t]["lang_pred"] == "und" and by_text[t]["score"] == 0 for t in (None, "", " \n\t ", "1234 5678 !!"))
    assert by_text[LONG]["lang_pred"] == "de"
    assert language_mixture.predict(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in language_mixture.predict(odd(spark), language_mixture.train(empty(spark))).collect()} == {"und"}
    kept = language_mixture.accepted(odd(spark).withColumn("score", F.lit("s")), model)
    assert kept.columns == [*odd(spark).columns, "score"] and kept.filter("text is null").count() == 0


def test_language_mixture_proportions(spark):
    """A text of two languages has both in its set, in about their shares."""
    model = language_mixture.train(documents(spark, BIG))
    part = {r["lang"]: r["text"] for r in documents(spark, BIG).filter("n_chars > 1500 and lang in ('en', 'de')").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = " ".join(part["en"].split()[:150] + part["de"].split()[:75])
    r = language_mixture.predict(spark.createDataFrame([(1, mixed)], "doc_id int, text string"), model).first()
    assert r["langs"] == ["de", "en"] and r["lang_pred"] == "en" and 0.55 < r["score"] < 0.78


# samples and sizes


def test_sample_of_huge_classes(spark):
    """The share of a class that is kept follows its size, however large that is said to be."""
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    got = {r["lang"]: r["count"] for r in _learn.thinned(rows, "lang", 1500, {"a": 100_000, "b": 10}).groupBy("lang").count().collect()}
    assert 1300 < got["a"] < 1700 and got["b"] == 100_000
    # 2e9 rows of which 0.75 in a million are wanted: the threshold isn't 0, and rises with what is wanted
    few, many = (_learn.thinned(rows, "lang", most, {"a": 2_000_000_000}).count() for most in (1500, 200_000_000))
    assert few <= 5 and 9_000 < many < 11_000
    assert (1500 << 64) // 2_000_000_000 > 0


def test_labelled_bounds_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "w"), (1, None), (2, "y"), (3, "z")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0), (None, 1), (4, 0)] * 4000, "doc_id long, quality int")
    got = sorted(map(tuple, _learn.labelled(docs, labels, "quality", 10).collect()))
    assert got == [r for r in [(1, "w", 1), (2, "y", 0)] if not spark.range(1).select(held_out(F.lit(r[0]))).first()[0]]


def test_three_hundred_languages(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    words = {f"l{k:03d}": [word() for _ in range(4)] for k in range(300)}
    rows = [(k * 10 + j, " ".join(w * 3), lang) for k, (lang, w) in enumerate(words.items()) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mixture.train(docs)
    assert len(model.languages) == 300
    got = language_mixture.predict(docs, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_language_mixture_of_four(spark):
    """A text that is a quarter of each of four languages has all four in its set."""
    model = language_mixture.train(documents(spark, BIG))
    part = {r["lang"]: r["text"] for r in documents(spark, BIG).filter("n_chars > 1500").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    assert len(part) == 4
    mixed = " ".join(w for t in part.values() for w in t.split()[:120])
    r = language_mixture.predict(spark.createDataFrame([(1, mixed)], "doc_id int, text string"), model).first()
    assert r["langs"] == sorted(part) and r["score"] < 0.4


def test_language_mixture_by_brute_force(spark):
    """Proportions and set, word by word with dictionaries."""
    import math

    model = language_mixture.train(documents(spark))
    langs = model.languages


    def brute(text):
        words = re.findall("[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if not words:
            return "und", 0.0
        # a word's first trigrams reach over the space to what stands before: two spaces, or a space after a letter
        logs, before = [], ""
        plain = re.sub("[^a-z\u0080-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).encode()
        raw = b"  " + plain
        open_ = False
        for k in range(2, len(raw)):
            if raw[k] == 0x20:
                open_ = False
                continue
            code = raw[k - 2] << 16 | raw[k - 1] << 8 | raw[k]
            p = model.log_p[((code * 2654435761) & 0xFFFFFFFF) >> 16]
            if open_:
                logs[-1] = [x + float(y) for x, y in zip(logs[-1], p)]
            else:
                logs.append([float(y) for y in p])
            open_ = True

        def em(mix):
            for _ in range(language_mixture.STEPS):
                new = [0.0] * len(langs)
                for word in logs:
                    part = [m * math.exp(x - max(word)) for m, x in zip(mix, word)]
                    new = [n + x / max(sum(part), 1e-300) for n, x in zip(new, part)]
                mix = [n / len(logs) for n in new]
            return mix

        total = [sum(w[k] for w in logs) for k in range(len(langs))]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        share, score = [float(k == best) for k in range(len(langs))], total[best]
        full = em([1 / len(langs)] * len(langs))
        order = sorted(range(len(langs)), key=lambda k: (-full[k], k))
        for size in range(2, len(langs) + 1):
            mix = [max(full[k], 1e-6) if k in order[:size] else 0.0 for k in range(len(langs))]
            mix = em([m / sum(mix) for m in mix])
            fit = sum(max(w) + math.log(max(sum(m * math.exp(x - max(w)) for m, x in zip(mix, w)), 1e-300)) for w in logs)
            worth = fit - language_mixture.PENALTY * math.log(max(len(logs), 2)) / 2 * (size - 1)
            if worth <= score:
                break
            share, score = mix, worth
        top = max(range(len(langs)), key=lambda k: (share[k], -k))
        return langs[top], share[top]

    rows = language_mixture.predict(documents(spark).select("doc_id", "text"), model).collect()
    for r in rows:
        lang, share = brute(r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(share, abs=1e-4)


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_language_of_a_long_text_in_slices(size):
    rng = np.random.default_rng(1)
    model = language_mixture.Model(list("abcdef"), np.log(rng.random((language_mixture.BUCKETS, 6))).astype(np.float32))
    text = " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(800)) + " " + "x" * 3000 + " 1 2"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = language_mixture._Batch(*language_mixture._words(model, data, np.array([0, len(data)])))
    cut = language_mixture._Long(lambda: language_mixture._slices(model, data, size), 6)
    assert cut.words[0] == whole.words[0]
    assert np.allclose(language_mixture._mixtures(cut), language_mixture._mixtures(whole))


@pytest.mark.parametrize("module, threshold", [(quality_fm, 0.3), (toxicity_counterfactual, 0.5)])
def test_score_equal_to_the_threshold(spark, module, threshold):
    model = module.train(documents(spark), labels(spark, SF))
    scored = module.predict(documents(spark), model).collect()
    tie = scored[0]["score"]
    again = module.predict(documents(spark), model, tie).collect()
    assert all(r["predicted"] == int(r["score"] >= tie) for r in again) and again[0]["predicted"] == 1
