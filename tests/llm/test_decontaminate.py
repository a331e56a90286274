import re

import skyledger.llm.decontaminate as D
from skyledger.llm.common import WORD_CLASS

DOCS = "doc_id long, text string, item_id int, items string"
ITEMS = "item_id long, text string, doc_id int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def word_list(text):
    return re.findall(WORD_CLASS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    ws, hit, names = word_list(text), set(), set()
    for k, t in items:
        p = word_list(t)
        if k is None or not p:
            continue
        for i in range(max(1, len(p) - window + 1)):
            w = p[i : i + window]
            for s in range(len(ws) - len(w) + 1):
                if ws[s : s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    names.add(str(k))
    return len(ws), len(hit), len(names), sorted(names), bool(hit)


def run(spark, docs, items, window=10):
    got = D.decontaminate(spark.createDataFrame([(k, t, 0, "") for k, t in docs], DOCS), spark.createDataFrame([(k, t, 0) for k, t in items], ITEMS), window=window).collect()
    assert len(got) == len(docs)
    want = sorted(((k, *brute(t, items, window)) for k, t in docs), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_against_brute_force(spark, monkeypatch):
    items = [(1, PASSAGE), (2, PASSAGE + " thirteen"), (10, "short item here"), (11, "Tiny."), (12, None), (13, "?!"), (None, "no id"), (2, "two words"), (14, "a a a a a a a a a a a a")]
    docs = [(1, f"x {PASSAGE.upper()} y"), (1, f"x {PASSAGE.upper()} y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "tiny Short item, here two words"), (6, "a " * 30), (None, "no id tiny"), (7, f"{PASSAGE} thirteen {PASSAGE}"), (8, "filler " * 20000 + PASSAGE)]
    run(spark, docs, items)
    run(spark, docs[:7], items, window=4)
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 3)  # a shuffle join
    run(spark, docs[:6], items)


def test_empty_tables(spark):
    run(spark, [], [(1, PASSAGE)])
    run(spark, [(1, PASSAGE), (2, None)], [])
    run(spark, [(1, "nothing shared")], [(1, PASSAGE)])
