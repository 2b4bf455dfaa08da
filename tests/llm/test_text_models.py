"""Trained operators: held-out results, whole texts, odd rows."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinalis.llm import langid, lm_score, pii, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(900001, None), (900002, ""), (900003, " \n\t"), (None, "of the and"), (900004, "x" * 60_000), (900005, "of the and"), (900005, "of the and")]


def rows(sql):
    return duckdb.sql(sql).fetchall()


def odd_frame(spark):
    return spark.createDataFrame([(i, t, "en", 1, 2.0, True) for i, t in ODD], "doc_id long, text string, lang string, toxic int, score double, kept boolean")


def test_toxicity_held_out():
    found = rows(f"SELECT doc_id, text, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id)")
    fold = [r for r in found if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    learn = [r for r in found if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = toxicity.train([r[1] for r in learn], [r[2] for r in learn])
    scorer = toxicity.Scorer(*model.bucket_scores())
    p = scorer.score([r[1] for r in fold])
    y = np.array([r[2] for r in fold])
    # Clean texts joined to long ones stay clean: length alone makes no text toxic.
    clean = [r[1] for r, q in zip(fold, p, strict=True) if r[2] == 0 and q < 0.3]
    rng, joined = random.Random(4), {}
    for words in (5_000, 20_000, 60_000):
        long = [" ".join(" ".join(rng.choices(clean, k=words // 20)).split()[:words]) for _ in range(8)]
        assert all(len(t.split()) == words for t in long)
        joined[words] = scorer.score(long)
    assert scorer.score(["", None]).max() < 0.3
    assert joined[60_000].mean() < joined[5_000].mean() + 0.05 < 0.3 and all((q >= 0.3).mean() <= 0.25 for q in joined.values())
    # Some 300 toxic texts to learn from; with 1,600 both shares are above 0.99.
    assert (p[y == 1] >= 0.3).mean() > 0.6 and (p[y == 0] < 0.3).mean() > 0.95


def test_toxicity_misspelling_and_place():
    texts = ["it was then said that a stupid clown came"] * 40 + ["it was then said that a nice day came"] * 40
    scorer = toxicity.Scorer(*toxicity.train(texts, [1] * 40 + [0] * 40, buckets=1 << 12, epochs=40).bucket_scores())
    quiet = "it was then said that a day came " * 300
    p = scorer.score(["stupidd clownn", quiet, quiet + "stupid clown", ""])
    assert p[0] > 0.5 and p[1] < 0.5 < p[2]
    assert ((p >= 0) & (p <= 1)).all()


def test_toxicity_parts_do_not_matter(monkeypatch):
    """Gradients summed over small parts give the model of one part; scores equal the softmax written out."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeinst", k=rng.randrange(1, 7)))
    texts = [" ".join([word() for _ in range(rng.randrange(60))] + (["idiot"] if i % 3 == 0 else [])) for i in range(180)]
    labels = [int(i % 3 == 0) for i in range(180)]
    fit = lambda: toxicity.train(texts, labels, buckets=1 << 10, epochs=8)
    whole = fit()
    monkeypatch.setattr(toxicity, "PART_WORDS", 100)
    parts = fit()
    assert np.abs(whole.vectors - parts.vectors).max() < 1e-3 and np.abs(whole.text - parts.text).max() < 1e-2
    got = toxicity.Scorer(*whole.bucket_scores()).score(texts)
    for text, score in zip(texts, got, strict=True):
        if not text.split():
            assert score == whole.empty
            continue
        words, best = toxicity.tokens(text), []
        for i in range(0, max(len(words), 1), toxicity.BAG_WORDS):
            grams = [toxicity.word_table([w], 1 << 10)[0] for w in words[i:i + toxicity.BAG_WORDS]]
            mean = np.mean(whole.vectors[np.concatenate(grams)], 0) if grams else np.zeros(4)
            logits = toxicity.SCALE * mean @ whole.weights + whole.bias
            best.append(logits[1] - logits[0])
        z = whole.text[0] + whole.text[1] * max(best) + whole.text[2] * np.log(len(best))
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-3


def test_text_odds():
    rng = np.random.default_rng(0)
    y = (rng.random(900) < 0.15).astype(float)
    bags = np.exp(rng.normal(2, 1, 900))
    top = np.where(y > 0, rng.normal(2, 2, 900), rng.normal(-6, 2, 900) + np.log(bags))
    fit = toxicity.text_odds(top, np.log(bags), y, np.ones(900), 0.15)
    assert fit[1] > 0 and fit[2] < 0 and np.isfinite(fit).all()
    assert toxicity.text_odds(top + 5 * np.where(y > 0, np.log(bags), 0), np.log(bags), y, np.ones(900), 0.15)[2] <= 0
    assert toxicity.text_odds(top, np.log(bags), np.zeros(900), np.ones(900), 0.1).tolist() == [0.0, 1.0, 0.0]


def test_toxicity_sample_is_bounded_and_keeps_the_share(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit(1).alias("k"), F.lit(2).alias("of"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    sample, share = toxicity.labelled_sample(docs, labels, 50)
    assert sum(y for _, y in sample) == 50 and len(sample) == 150 and abs(share - 0.1) < 0.01
    few, share = toxicity.labelled_sample(docs.limit(0), labels.limit(0), 50)
    assert few == [] and share == 0


def test_toxicity_odd_rows(spark):
    docs = odd_frame(spark)
    labels = spark.createDataFrame([(900005, 1, None), (900004, 0, "x"), (None, 1, None), (900001, None, None)], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got}[None] is False
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(ODD)


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver neither fetches the sampled texts nor trains on them, and the task's model is that of the sample."""
    texts = [f"it was then said that a {'stupid clown' if i % 2 else 'nice day'} came {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample, share = toxicity.labelled_sample(docs, labels, 100)
    wanted = toxicity.Scorer(*toxicity.train([t for t, _ in sample], [y for _, y in sample], toxic_share=share).bucket_scores()).score(texts)

    real, driver = toxicity.train, os.getpid()

    def train(*args, **named):
        assert os.getpid() != driver, "trained on the driver"
        return real(*args, **named)

    monkeypatch.setattr(toxicity, "train", train)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert np.abs(np.array([got[i] for i in range(60)]) - wanted).max() < 1e-3
    assert toxicity.drop_toxic(docs, labels).count() == (wanted < 0.3).sum()


def test_language_held_out():
    found = rows(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'")
    fold = [r for r in found if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    learn = [r for r in found if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    net = langid.train([r[1][:600] for r in learn], [r[2] for r in learn], steps=250)
    names, scores = langid.predict(langid.Reader(net), [r[1] for r in fold])
    assert np.mean([a == r[2] for a, r in zip(names, fold, strict=True)]) > 0.97
    assert all(0 <= s <= 1 for s in scores)


def test_language_tables_equal_network():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b"], rng.normal(0, 1, (256, 6)), [rng.normal(0, 1, (w, 6, 8)) for w in langid.WIDTHS], rng.normal(0, 1, 32), rng.normal(0, 1, (32, 2)), np.zeros(2))
    x = langid.windows_of(bytes(rng.integers(0, 256, 1000, dtype=np.uint8)))
    e = net.embed[x]
    top = [sum(e[:, j:langid.WINDOW - w + 1 + j] @ f[j] for j in range(w)).max(1) for w, f in zip(langid.WIDTHS, net.filters, strict=True)]
    want = langid.softmax(np.maximum(np.concatenate(top, 1) + net.shift, 0) @ net.out + net.bias)
    assert np.abs(langid.Reader(net)(x) - want).max() < 1e-4


def test_language_odd_rows(spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd_frame(spark), per_language=20).collect()}
    assert {(900001, "und"), (900002, "und"), (900003, "und")} <= got and (900004, "en") in got
    assert langid.identify(odd_frame(spark).limit(0)).count() == 0


def test_lm_score_prefers_target(spark):
    docs = spark.createDataFrame([(i, "good clean words here " * 5) for i in range(10)] + [(i, "bad noisy junk there " * 5) for i in range(10, 40)] + ODD[:4], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs, spark.range(5).toDF("doc_id"), vocabulary=16).collect()}
    assert got[7]["difference"] < got[20]["difference"] and got[7]["n_tokens"] == 20
    assert got[900001]["n_tokens"] == 0 and got[900001]["target_loss"] is None and got[900002]["difference"] is None
    assert lm_score.lm_scores(docs.limit(0), spark.range(5).toDF("doc_id")).count() == 0


def test_lm_score_knows_rare_words(spark):
    """More words than any fixed vocabulary: words seen in few texts tell them apart."""
    common = " ".join(f"w{k:04d}" for k in range(1500)) + " "
    texts = {0: "alpha beta alpha beta", 1: "gamma delta gamma delta", 2: "alpha beta alpha beta", 3: "gamma delta gamma delta", 4: common * 4, 5: common * 4}
    docs = spark.createDataFrame([*texts.items(), *ODD[:4], (2, texts[2])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs, spark.createDataFrame([(0,)], "doc_id long"), None).collect()}
    assert docs.count() == lm_score.lm_scores(docs, spark.range(1).toDF("doc_id"), None).count()
    assert got[2]["difference"] < got[3]["difference"] - 0.5
    assert got[900001]["n_tokens"] == 0 and got[900001]["target_loss"] is None and got[900002]["difference"] is None
    assert lm_score.lm_scores(docs.limit(0), spark.range(1).toDF("doc_id"), None).count() == 0
    cut = {r["doc_id"]: r for r in lm_score.lm_scores(docs, spark.createDataFrame([(0,)], "doc_id long")).collect()}
    assert cut[2]["difference"] == cut[3]["difference"]  # what a vocabulary of 1,024 makes of them


def plain_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: list(re.finditer(p, x))
    return {"email": [m.span() for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
            "ip": [m.span() for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))],
            "card": [m.span() for m in find(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
            "phone": [m.span() for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m[0])) <= 15]}


def test_patterns_equal_plain_ones():
    rng = random.Random(3)
    made = ["".join(rng.choice("a1.@-+ 5(0") for _ in range(40)) for _ in range(20_000)]
    for x in made + [r[0] for r in rows(f"SELECT text FROM '{SF}/documents.parquet'")]:
        assert pii.base_spans(x) == plain_spans(x)


@pytest.fixture(scope="module")
def field():
    return pii.train(["the one of and on with this are 12 and 4", "call +1 (555) 123-4567 or mail a.b@c.example.com"])


@pytest.mark.parametrize("text,want", [
    ("then call (555) 123-4567 for it", [("phone", "(555) 123-4567")]),
    ("pay by 4242.4242.4242.4242 today", [("card", "4242.4242.4242.4242")]),
    ("reach bob at host dot org soon", [("email", "bob at host dot org")]),
    ("on 2020-01-02 at 10:30 it cost 1,234", []),
    ("they met at noon and left", []),
])
def test_field_adds_spans(field, text, want):
    assert [(k, text[a:b]) for k, a, b in field.spans(text, pii.base_spans(text))] == want


def test_field_leaves_base_spans_alone(field):
    text = "mail a.b@c.example.com, card 4242424242424242, ip 10.0.0.1"
    base = pii.base_spans(text)
    assert all(b <= s or e <= a for _, a, b in field.spans(text, base) for spans in base.values() for s, e in spans)


def test_best_segmentation_is_the_best(field):
    text = "call (555) 123-4567 or 10.2.3.4"
    tokens, segments = field.lattice(text, (0, len(text)))
    s = field.scores(segments)

    def best(t):
        return 0.0 if t == 0 else max([best(t - 1), *[best(i) + s[k].max() for k, (i, j, _) in enumerate(segments) if j == t]])

    assert sum(s[k, y] for k, y in field.best(len(tokens), segments, s)) == pytest.approx(best(len(tokens)))


def test_pii_odd_rows(spark):
    got = {r["doc_id"]: r for r in pii.find_pii(odd_frame(spark)).collect()}
    assert got[900001]["spans"] == "" and got[900001]["n_email"] == 0 and got[900004]["n_card"] == 0
    assert pii.find_pii(odd_frame(spark).limit(0)).count() == 0
