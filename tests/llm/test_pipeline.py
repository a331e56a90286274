import numpy as np
import pytest

import corpus_pipeline as P
from skyledger.llm.queries import QUERIES, toxicity_model
from tests.llm.test_classifiers import plain_toxicity_score
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from tests.llm.test_packing import check as packed_whole

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, predicted string, _k string"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        after = P.cut(stage(spark, docs, SF))
        assert after.columns == docs.columns
        kept = {r.doc_id: r for r in after.collect()}
        assert all(before[k] == r for k, r in kept.items())
        if name == "near_duplicates":
            want = {k for k, _, c in components([(k, r.text) for k, r in before.items()]) if k == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {k for k, r in before.items() if not contaminated(r.text, items, 10)[4]}
        elif name == "language_id":
            want = set(before)  # all have letters
        else:
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            known = [k for k in before if k in toxic]
            assert np.mean([(k in kept) == (not toxic[k]) for k in known]) > 0.85 and len(kept) > 0.8 * len(before)
            model = toxicity_model(docs, spark, SF)  # a text goes if the plain version of the scorer rejects it
            want = {k for k, r in before.items() if plain_toxicity_score(model, r.text) < 0.3}
        assert set(kept) == want, name
        docs, before = after, kept
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    packed_whole(rows, {k: r.text for k, r in before.items()}, 2048, 2048)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_edge_rows(spark, name):
    stage = dict(P.STAGES)[name]
    long_text = "the quick brown fox jumps over the lazy dog again and again " * 50
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "?? 123", "en", "s", 6), (4, long_text, "en", None, 1), (4, long_text, "en", None, 1), (None, long_text, "en", "x", 1), (None, None, None, None, None), (5, long_text + "tail", None, "s", 2), (4, "same id but quite another text", "en", "s", 3)]
    df = spark.createDataFrame([(*r, 7, "p", "k") for r in rows], SCHEMA)
    out = stage(spark, df, SF)
    if name == "packing":
        assert sum(r.length for r in out.collect() if r.doc_id is None) > 1
        return
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    texts = [(r[0], r[1]) for r in rows]
    want = {"toxicity": texts, "decontamination": texts, "language_id": [t for t in texts if t[1] and "?" not in t[1]], "near_duplicates": [t for i, t in enumerate(texts) if i not in (4, 5, 7)]}[name]
    assert got == sorted(want, key=str)
    assert stage(spark, df.limit(0), SF).collect() == []


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is P.run and {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in QUERIES if n.startswith("op")}


def test_near_duplicates_of_five_words_at_eighty_percent(spark):
    two = [f"v{i}" for i in range(94)]
    rows = [(1, two), (2, [*two[:30], "y", *two[31:60], "z", *two[61:]]), (3, [f"w{i}" for i in range(94)])]  # 80 of 100 shared; of four-word shingles 83 of 99
    df = spark.createDataFrame([(k, " ".join(w), "en", "s", 1, 7, "p", "k") for k, w in rows], SCHEMA)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, df, SF).collect()) == [1, 3]


def test_unknown_languages_go_and_held_out_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = spark.range(10**6, 10**6 + 100).where(P.crc_bucket(P.F.col("id"), 5) == 0).limit(3).collect()  # held out, so not learned
    strange = ["Це текст українською мовою про погоду й море", "η γρήγορη καφέ αλεπού πηδά πάνω από το σκυλί", "nopea ruskea kettu hyppää laiskan koiran yli"]
    more = spark.createDataFrame([(r.id, t, "en", "s", 1) for r, t in zip(ids, strange, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.language_id(spark, docs.select(more.columns).unionByName(more), SF).collect()}
    held_out = {r.doc_id for r in docs.where(P.crc_bucket(P.F.col("doc_id"), 5) == 0).collect()}
    assert held_out and held_out <= kept and not kept & {r.id for r in ids}
