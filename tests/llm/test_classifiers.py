import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm.langid import Scorer, fit_language_model, predict_language, quotas, stratified_sample, word_grams
from skyledger.llm.queries import QUERIES
from skyledger.llm.toxicity import SEED, fit_toxicity, label_model, score_toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score int, predicted int"


def test_language_model_and_edge_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en", 0, 0), (2, "der hund und die katze", "de", 0, 0), (3, None, "fr", 0, 0), (None, "le chat et le chien", "fr", 0, 0), (5, "x", None, 0, 0)], SCHEMA)
    model = fit_language_model(train)
    assert model.langs == ("de", "en", "fr")
    got = predict_language(spark.createDataFrame([(1, "the dog", "fr", 0, 0), (2, "hunde katzen", None, 0, 0), (3, None, "en", 0, 0), (4, "123 ... ²", "en", 0, 0), (None, "le " * 50000, "", 0, 0), (1, "the dog", "fr", 0, 0)], SCHEMA), model).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "fr", "en"]
    assert all(0 <= r.score <= 1 for r in got) and got[2].score == 0
    assert predict_language(train.limit(0), model).collect() == []
    nothing = fit_language_model(train.limit(0))
    assert predict_language(train, nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_backoff_takes_the_longest_known_gram():
    from skyledger.llm.langid import LanguageModel

    grams = {"^": np.array([0.0, -1]), "^a": np.array([-2.0, 0]), "b": np.array([0.0, -3])}
    s = Scorer(LanguageModel(("x", "y"), {"known": np.array([0.0, -5])}, grams))
    raw = np.array([-2.0, 0]) * 2 / 4 + np.array([0.0, -3]) / 4
    assert np.allclose(s.vector("ab"), raw - raw.max()) and np.allclose(s.vector("known"), [0, -5])
    assert set(word_grams("ab")) == {"^", "^a", "^ab", "^ab$", "a", "ab", "ab$", "b", "b$", "$"}


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.zeros((4000, 5))
    for j, (acc, speaks) in enumerate([(0.95, 0.8), (0.9, 0.7), (0.8, 0.9), (0.7, 0.5)]):
        right = rng.random(4000) < acc
        votes[:, j] = np.where(rng.random(4000) < speaks, np.where(right, 1, -1) * np.where(y, 1, -1), 0)
    votes[:, 4] = votes[:, 3]  # a repeat
    q, accuracy, corr = label_model(votes, 0.3)
    assert np.allclose(accuracy[:4], [0.95, 0.9, 0.8, 0.7], atol=0.05) and corr[3, 4] > 0.95
    assert ((q > 0.5) == y).mean() > 0.93
    assert len(label_model(np.zeros((0, 3)), 0.5)[0]) == 0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and a moron" if i % 2 else "a calm and friendly text", "en", 0, 0) for i in range(40)] + [(None, None, None, 0, 0), (0, "", "", 0, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 42 and all(r.predicted == (r.doc_id or 0) % 2 for r in got) and all(0 <= r.score <= 1 for r in got)
    bare = fit_toxicity(docs, labels.limit(0))
    assert {r.predicted for r in score_toxicity(docs.where("doc_id % 2 = 1"), bare).collect()} == {1}
    assert score_toxicity(docs.limit(0), model).collect() == [] and "idiot" in SEED


@pytest.mark.parametrize("name,column,label,least", [("op5_language_id", "lang_pred", "lang", 0.97), ("op1_toxicity", "predicted", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, column, label, least):
    got = QUERIES[name](spark, SF).where("held_out")
    truth = spark.read.parquet(f"{SF}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label)
    rows = got.join(truth, "doc_id").collect()
    assert rows and np.mean([r[column] == r[label] for r in rows]) >= least


def test_sample_keeps_rare_languages_and_counts_copies_once(spark):
    rows = [(i, f"the cat number w{chr(97 + i % 26)}{chr(97 + i // 26)} sat", "en", 0, 0) for i in range(500)]
    rows += [(1000 + i, "one text that was copied", "en", 0, 0) for i in range(300)] + [(2000 + i, f"der hund {x}", "de", 0, 0) for i, x in enumerate(("lief", "sprang", "kam"))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in stratified_sample(docs.select("lang", "text"), 40).collect()]
    assert len(got) == len(set(got)) == 40 and sum(lang == "de" for lang, _ in got) == 3
    assert sorted(got) == sorted(tuple(r) for r in stratified_sample(docs.select("lang", "text").repartition(3), 40).collect())
    assert stratified_sample(docs.select("lang", "text"), 5000).count() == 504
    assert fit_language_model(docs, max_rows=40).langs == ("de", "en")
    assert quotas({"a": 1, "b": 100, "c": 100}, 21) == {"a": 1, "b": 10, "c": 10} and quotas({"a": 5, "b": 5}, 1) == {"a": 1, "b": 1}


@pytest.mark.parametrize("text,known", [("½cup", True), ("½ ² 3", False), ("हिन्दी में", True), ("\u0301", False), ("_a_", True)])
def test_any_letter_makes_a_language(spark, text, known):
    model = fit_language_model(spark.createDataFrame([(1, "a cup of tea", "en", 0, 0), (2, "हिन्दी में लिखा हुआ", "hi", 0, 0)], SCHEMA))
    assert (Scorer(model).score(text)[0] != "und") == known
    if "में" in text:
        assert "हिन्दी" in model.words and Scorer(model).score(text)[0] == "hi"


def test_a_kept_word_keeps_its_counts_in_all_languages(spark):
    rows = [(1, "shared shared shared alpha beta gamma", "en", 0, 0), (2, "shared eins zwei drei vier fuenf sechs sieben acht neun", "de", 0, 0)]
    model = fit_language_model(spark.createDataFrame(rows, SCHEMA), max_words=1)
    # 3 of 6 words in en, 1 of 10 in de: the word cut for de would score as never seen there
    assert list(model.words) == ["shared"] and np.allclose(model.words["shared"], [np.log((1.5 / 10.5) / (3.5 / 6.5)), 0])


def test_repeated_ids_do_not_exceed_the_bound(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, max_rows=2)
    assert model.rows == 2 and all(0 <= r.score <= 1 for r in score_toxicity(docs.limit(5), model).collect())


@pytest.mark.parametrize("only", ["", "2024 12 !!", "東" * 70, "a" * 100_000])
def test_a_language_whose_only_text_is_odd(spark, only):
    rows = [(i, f"the cat sat on mat {chr(97 + i)}", "en", 0, 0) for i in range(20)] + [(99, only, "zz", 0, 0)]
    model = fit_language_model(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert model.langs == (("en", "zz") if any(c.isalpha() for c in only) else ("en",))
    if only.startswith("東"):
        assert Scorer(model).score("東" * 9)[0] == "zz" and only in model.words
    assert Scorer(model).score("the cat")[0] == "en"


def plain_language_scores(model, text):
    """By the letter of the method, gram by gram and word by word."""
    total = np.zeros(len(model.langs))
    found = re.findall(r"[^\W\d_]+", text.lower())
    for word in found:
        if word in model.words:
            total += model.words[word]
            continue
        w, raw = f"^{word}$", np.zeros(len(model.langs))
        for i in range(len(w)):
            gram = next((w[i : i + n] for n in (4, 3, 2, 1) if len(w) >= i + n and w[i : i + n] in model.grams), None)
            if gram:
                raw += model.grams[gram] * len(gram) / 4
        total += np.maximum((raw - raw.max()) / max(1, len(w) / 4), -6)
    share = np.exp(total / np.sqrt(len(found)))
    return share / share.sum()


def test_language_scores_by_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = fit_language_model(docs.where("doc_id % 2 = 0"), max_words=400, max_grams=2000)
    got = predict_language(docs, model, keep=("doc_id", "text")).collect()
    assert len(got) == 300
    for r in got:
        want = plain_language_scores(model, r.text)
        assert r.lang_pred == model.langs[int(want.argmax())] and abs(r.score - want.max()) < 1e-9


def plain_toxicity_score(model, text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    present = {f for w in words for f in (w, "^" + w[:4] if len(w) >= 4 else w, "^" + w[:5] if len(w) >= 5 else w, "^" + w[:6] if len(w) >= 6 else w)}
    z = sum(model.weights[i] for f, i in model.features.items() if f in present) + model.bias
    return 1 / (1 + np.exp(-(model.scale * z + model.shift)))


def test_toxicity_scores_by_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = score_toxicity(docs, model, keep=("doc_id", "text")).collect()
    assert all(abs(r.score - plain_toxicity_score(model, r.text)) < 1e-9 and r.predicted == (r.score >= 0.3) for r in rows)
    long = "insult" + "x" * 60
    docs = spark.createDataFrame([(i, f"{long} text" if i % 2 else "calm text", "en", 0, 0) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    assert long in fit_toxicity(docs, labels).features
