import re

import numpy as np

from skyledger.llm.queries import BASE_RULES, EXTRA_RULES
from skyledger.llm.urls import Automaton, Rule, judge_urls, split_url

SCHEMA = "page_id long, url string, html string, host int, verdict int"


def as_regex(glob):
    return re.compile("".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*|.", glob, re.S)), re.S)


def test_automaton_against_regexes():
    rng = np.random.default_rng(1)
    globs = ["**", "*", "a*b", "*a?b**", "?", "", "/**/x", "**ab**ba", *["".join(rng.choice(list("ab/*?"), rng.integers(1, 12))) for _ in range(60)]]
    texts = ["", "é", *["".join(rng.choice(list("ab/é"), rng.integers(0, 14))) for _ in range(400)]]
    got = Automaton([Rule(g, "block", g) for g in globs]).run(texts)
    for j, g in enumerate(globs):
        assert [bool(as_regex(g).fullmatch(t)) for t in texts] == got[:, j].tolist(), g


def test_rules(spark):
    cases = {
        "http://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"), "http://A.EXAMPLE.com/en/77?q#f": ("a.example.com", "/en/77", "example.com/en/7", "allow"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "https://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "https://example.net/de/7": ("example.net", "/de/7", "net/de/", "allow"), "x://h.org?u=/es/": ("h.org", "", None, "allow"), "a://b.org/x.com/en/": ("b.org", "/x.com/en/", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "h://spam-farm.info": ("spam-farm.info", "", None, "block"),
        "h://ÄB.Com/en/é": ("Äb.com", "/en/é", "com/en/", "block"), "h://x.dev/" + "y" * 20000 + ".exe": ("x.dev", "/" + "y" * 20000 + ".exe", None, "block"),
    }
    rows = [(i, u, "", 1, 2) for i, u in enumerate(cases)] + [(0, "http://x.com/en/1", "", 1, 2), (None, "h://x.org/es/", None, None, None)]
    got = judge_urls(spark.createDataFrame(rows, SCHEMA), BASE_RULES, EXTRA_RULES).collect()
    assert len(got) == len(rows)
    want = list(cases.values())
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == (want[r.page_id] if r.page_id is not None else ("x.org", "/es/", "org/es/", "block"))


def test_empty_and_split(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA), BASE_RULES).collect() == []
    assert split_url("a://b://c/d") == ("b:", "//c/d") and split_url("http://H#x?y") == ("h", "")
