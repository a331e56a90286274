"""Drafts against plain list edits, and their inverses."""

import hashlib
import json

from skyledger.operators import drafts as D


def plain(key, category, n, variant, value):
    alike = lambda s: s.translate(str.maketrans(D.PLAIN, D.ALIKE))
    block = lambda i, v: f"[item {i}]\nname = {v}\nsize = {i % 7}\n\n"
    if category == "unicode-fix":
        old, new = alike(value), value
    else:
        stem = alike(value) if variant == "unicode" else value
        old, new = stem + "-old", stem + "-new"
    a, b = key * 7919 % n, key * 104729 % (n - 1)
    before = [block(i, old) for i in range(1, n + 1)]
    other = None
    if category in ("unique", "unicode-fix"):
        before = [block(i, old if i == a + 1 else new) for i in range(1, n + 1)]
    after, other_after = list(before), None
    if category in ("replace-all", "unique", "unicode-fix"):
        after = [x.replace(old, new) for x in before]
    elif category == "delete-block":
        del after[a]
    elif category == "insert-block":
        after.insert(b, block(n + 1, new))
    elif category == "move-block":
        after.insert(b, after.pop(a))
    elif category == "copy-block":
        after.append(before[a])
    else:
        other = [block(n + 1, old)]
        other_after = [*other, after.pop(a)]
    files = lambda main, more: {D.MAIN: "".join(main)} | ({D.OTHER: "".join(more)} if more else {}) | {D.UNTOUCHED: D.GUARD}
    task = f"{category}-{n}-{variant}"
    draft = {"id": task, "input": files(before, other), "expected": files(after, other_after)}
    return task, draft["input"], draft["expected"], hashlib.sha256(json.dumps(draft, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


SCHEMA = "key long, category string, scale int, variant string, value string, old string, extra int"


def test_drafts_and_their_inverses(spark):
    rows = [(k, c, 2 + (k * 5 + i) % 11, v, value) for i, c in enumerate(D.CATEGORIES) for v in ("plain", "unicode") for k in (0, 1, 17, -4, 10**9) for value in ("a red-hot cup", "xyz", "")]
    odd = [(None, "unique", 5, "plain", "x"), (1, "other", 5, "plain", "x"), (1, "unique", 1, "plain", "x"), (1, "unique", None, "plain", "x"), (1, "unique", 5, "bold", "x"), (1, None, 5, "plain", "x"), (1, "unique", 5, "plain", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + odd], SCHEMA).repartition(3)
    got = [(r.key, r.taskId, r.input, r.expected, r.fixtureSha256) for r in D.drafts(df).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *plain(*r)) for r in rows), key=repr)
    found = D.draft_violations(df).collect()
    assert {r.rule for r in found} == {"unchanged"}  # every inverse gives the input back
    same = {(r[0], r[1]) for r in rows if (lambda p: p[1] == p[2])(plain(*r))}
    assert {r.key for r in found} == {k for k, _ in same}
    assert D.drafts(df.limit(0)).collect() == [] and D.draft_violations(df.limit(0)).collect() == []
