"""Drafts of edit tasks, a row each: input files, expected files, and the hash of both.

A draft is made of a key, a category, a number of blocks, a variant and a value, all columns, so a table of any size
gives as many drafts where its rows lie. The key seeds which block is edited and where to. Every edit has its inverse,
by which drafts are checked: what the inverse makes of the expected files must be the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("replace-all", "unique", "delete-block", "insert-block", "move-block", "copy-block", "move-between", "unicode-fix")
#: Characters and what they look like: fixed values.
PLAIN, ALIKE = " -ac", " ‑ас"
MAIN, OTHER, UNTOUCHED = "main.txt", "other.txt", "untouched.txt"
GUARD = "Nothing here is to be edited.\n"


def alike(text: Column) -> Column:
    """The text with spaces, hyphens, a and c replaced by characters that look the same."""
    return F.translate(text, PLAIN, ALIKE)


def block(i: Column, value: Column) -> Column:
    n = i.cast("string")
    return F.concat(F.lit("[item "), n, F.lit("]\nname = "), value, F.lit("\nsize = "), (i % 7).cast("string"), F.lit("\n\n"))


def blocks(n: Column, value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda i: block(i, value))


def without(items: Column, at: Column) -> Column:
    return F.concat(F.slice(items, F.lit(1), at - 1), F.slice(items, at + 1, F.size(items)))


def inserted(items: Column, at: Column, item: Column) -> Column:
    """item as the at-th one."""
    return F.concat(F.slice(items, F.lit(1), at - 1), F.array(item), F.slice(items, at, F.size(items)))


def replaced(items: Column, at: Column, item: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i + 1 == at, item).otherwise(x))


def by_category(rules: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, rule in rules.items():
        out = F.when(F.col("category") == name, rule).otherwise(out)
    return out


def seeded(n: Column, prime: int) -> Column:
    """A place from 1 to n that the key and a prime settle."""
    return (F.pmod(F.col("key") * prime, n.cast("long")) + 1).cast("int")


def plans(rows: DataFrame) -> DataFrame:
    """rows (key long, category, scale int of at least 2, variant plain or unicode, value) with edit's places and blocks.

    old and new are the value before and after; from and to the places of the edit; before and after the blocks of
    main.txt; otherBefore and otherAfter those of other.txt, which only move-between has. A null in any of the columns,
    a smaller scale, an unknown category or a variant of another name gives no plan.
    """
    n, unicode = F.col("scale"), F.col("variant") == "unicode"
    fine = rows.where(F.col("category").isin(*CATEGORIES) & F.col("variant").isin("plain", "unicode") & (n >= 2) & F.col("key").isNotNull() & F.col("value").isNotNull())
    kept = fine.select("key", "category", n.cast("int").alias("scale"), "variant", "value")
    old = F.when(F.col("category") == "unicode-fix", alike(F.col("value"))).when(unicode, F.concat(alike(F.col("value")), F.lit("-old"))).otherwise(F.concat("value", F.lit("-old")))
    new = F.when(F.col("category") == "unicode-fix", F.col("value")).when(unicode, F.concat(alike(F.col("value")), F.lit("-new"))).otherwise(F.concat("value", F.lit("-new")))
    placed = kept.withColumns({"old": old, "new": new, "from": seeded(n, 7919), "to": seeded(n - 1, 104729)})
    only = F.col("category").isin("unique", "unicode-fix")
    # a unique match and a look-alike stand in one block, the others have the new value already
    base = F.when(only, replaced(blocks(n, F.col("new")), F.col("from"), block(F.col("from"), F.col("old")))).otherwise(blocks(n, F.col("old")))
    made = placed.withColumn("before", base)
    extra, at = block(n + 1, F.col("new")), F.col("before")
    mine = F.element_at("before", F.col("from"))
    moved = without(at, F.col("from"))
    after = by_category({
        "replace-all": blocks(n, F.col("new")), "unique": blocks(n, F.col("new")), "unicode-fix": blocks(n, F.col("new")), "delete-block": moved,
        "insert-block": inserted(at, F.col("to"), extra), "move-block": inserted(moved, F.col("to"), mine), "copy-block": F.concat(at, F.array(mine)), "move-between": moved,
    })
    between = F.col("category") == "move-between"
    other = F.when(between, F.array(block(n + 1, F.col("old"))))
    return made.withColumns({"after": after, "otherBefore": other, "otherAfter": F.when(between, F.concat(other, F.array(mine)))})


def undone(planned: DataFrame) -> DataFrame:
    """plans() with undone and otherUndone: the blocks that the inverse of each edit makes of the blocks after it."""
    n, at, old = F.col("scale"), F.col("after"), F.col("old")
    lost = F.element_at("before", F.col("from"))
    back = by_category({
        "replace-all": F.transform(at, lambda x: F.replace(x, F.col("new"), old)), "unique": replaced(at, F.col("from"), F.replace(F.element_at(at, F.col("from")), F.col("new"), old)),
        "unicode-fix": replaced(at, F.col("from"), F.replace(F.element_at(at, F.col("from")), F.col("new"), old)), "delete-block": inserted(at, F.col("from"), lost),
        "insert-block": without(at, F.col("to")), "move-block": inserted(without(at, F.col("to")), F.col("from"), F.element_at(at, F.col("to"))), "copy-block": F.slice(at, F.lit(1), n),
        "move-between": inserted(at, F.col("from"), F.element_at("otherAfter", -1)),
    })
    return planned.withColumns({"undone": back, "otherUndone": F.slice("otherAfter", F.lit(1), F.size("otherAfter") - 1)})


def drafts(rows: DataFrame) -> DataFrame:
    """Drafts of rows (see plans): key, taskId, input and expected (path to text), fixtureSha256.

    taskId follows the grammar of task ids: category, scale and variant. The hash is over the JSON of id, input and
    expected, in this order, so equal drafts of different keys have equal hashes.
    """
    text = lambda c: F.array_join(c, "")
    files = lambda main, other: F.map_filter(F.create_map(F.lit(MAIN), text(main), F.lit(OTHER), text(other), F.lit(UNTOUCHED), F.lit(GUARD)), lambda _, v: v.isNotNull())
    p = plans(rows)
    named = p.select("key", F.concat("category", F.lit("-"), F.col("scale").cast("string"), F.lit("-"), "variant").alias("taskId"), files("before", "otherBefore").alias("input"), files("after", "otherAfter").alias("expected"))
    return named.withColumn("fixtureSha256", F.sha2(F.to_json(F.struct(F.col("taskId").alias("id"), "input", "expected")), 256))


def draft_violations(rows: DataFrame) -> DataFrame:
    """(rule, key): drafts whose inverse doesn't give the input back, and drafts that change nothing.

    A block moved to its own place changes nothing, as does a fix of a value without look-alikes.
    """
    u = undone(plans(rows))
    wrong = (F.col("undone") != F.col("before")) | ~F.col("otherUndone").eqNullSafe(F.col("otherBefore"))
    still = (F.col("after") == F.col("before")) & F.col("otherAfter").eqNullSafe(F.col("otherBefore"))
    rules = F.filter(F.array(F.when(wrong, F.lit("inverse")), F.when(still, F.lit("unchanged"))), lambda x: x.isNotNull())
    return u.select(F.explode(rules).alias("rule"), "key")
