import re

import skyledger.llm.licenses as L
from skyledger.llm.common import WORD_CLASS
from skyledger.llm.licenses import BASE, NOTICES, scan_licenses, template_words

SCHEMA = "doc_id long, text string, label string, start int, spans int"


def brute(text):
    ws = re.findall(WORD_CLASS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for t in BASE:
        p = template_words(t.text)
        found = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        starts += found
        labels |= {t.label} if found else set()
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def same(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_base_places_on_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = scan_licenses(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    same(rows, texts)
    hit = {r.doc_id for r in rows if "mit" in r.labels.split(",")}
    assert hit == {k for k, t in texts.items() if "released under the mit license" in t.lower()}


def test_edges(spark):
    texts = {
        0: None, 1: "", 2: "CC-BY cc by cc cc by", 3: "All rights reserved. ALL RIGHTS RESERVED! all rights", 4: "gnu general public license " * 3, 5: "éCC by", 6: "x " * 40000 + "all rights reserved",
        7: NOTICES[1].text.replace("free of charge", "entirely free of any charge").replace("person", "person or body"), 8: "released under some other license", 9: "cc", 10: "all rights all rights reserved reserved", 11: "Licensed under CC BY-NC 4.0.", 12: "licensed under the apache license, version 3.0",
    }
    rows = [(k, t, "clash", 1, 2) for k, t in texts.items()] + [(2, texts[2], "again", 0, 0), (None, "cc by", None, None, None)]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    same([r for r in got if r.doc_id is not None], texts)
    by = {r.doc_id: r for r in got}
    assert by[None].n_base == 1 and by[7].labels == "mit" and by[8].labels == "" and by[11].labels == "cc-by,cc-by-nc-4.0" and by[12].labels == "" and by[7].spans[0].start == 0
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stray_votes_near_a_notice_do_not_hide_it(spark, monkeypatch):
    notice = "released under the mit license"
    texts = ["under the " * 5 + notice, notice + " under the" * 4, f"{notice} under the {notice}", "under the " * 9, "x " * 7 + notice]
    for bound in (200_000, 3):  # broadcast, and a shuffle join
        monkeypatch.setattr(L, "BROADCAST_GRAMS", bound)
        got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t, "", 0, 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
        assert [got[i].labels for i in range(5)] == ["mit", "mit", "mit", "", "mit"]
        assert [[(s.start, s.stop) for s in got[i].spans] for i in range(5)] == [[(10, 15)], [(0, 5)], [(0, 5), (7, 12)], [], [(7, 12)]]
