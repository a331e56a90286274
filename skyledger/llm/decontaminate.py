"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Benchmark items are cut into windows; a window is a set of shingles that a text must contain whole. For containment of
1 the necessary prefix of a window, in order of rarity, is its rarest shingle. So:

1. one pass over the texts finds the places of all benchmark shingles (postings), with the words they start at;
2. their counts order each window's shingles by rarity; a window with a shingle that no text holds can't occur;
3. postings are joined to the windows' prefix shingles, bound by position (the window must start inside the text) and
   length (and end inside it);
4. a window occurs at such a place exactly if shingles that cover all its words stand there, one after the other.

Shingles are compared by their words, not only by hashes. Only postings are shuffled, never texts. The shingles are
broadcast up to a number of them that is counted first; beyond it they are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, row_key, words

SHINGLE = 3
BROADCAST_SHINGLES = 1_000_000  # about 100 MB


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ws (words), n, items. A shorter item is one window; items without words or id have none."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    cutouts = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(window)))).alias("ws"))
    return cutouts.groupBy("ws").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("ws")).withColumn("window", F.sha2(F.array_join("ws", " "), 256))


def shingles_of(wins: DataFrame) -> DataFrame:
    """A row per window and place of a shingle in it: window, n, offset, gram (words joined by spaces), size."""
    size = F.least("n", F.lit(SHINGLE))
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.array_join(F.slice("ws", i, F.lit(SHINGLE)), " "))
    return wins.select("window", "n", size.alias("size"), F.posexplode(grams).alias("offset", "gram"))


def gram_hash(ws: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(ws)), *ws)


def postings_of(tokens: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Places of grams in tokens (_k1, _k2, _words): _k1, _k2, n_words, pos, gram. Each text is split once."""
    ws = [f"w{j}" for j in range(1, SHINGLE + 1)]
    later = [F.slice("_words", j, F.lit(2**31 - 1)).alias(f"w{j}") for j in range(2, SHINGLE + 1)]
    zipped = tokens.select("_k1", "_k2", F.size("_words").alias("n_words"), F.arrays_zip(F.col("_words").alias("w1"), *later).alias("_zip"))
    # the outer form: for the plain one Spark would add a filter that splits every text a second time
    at = zipped.select("_k1", "_k2", "n_words", F.posexplode_outer("_zip").alias("pos", "_z")).select("_k1", "_k2", "n_words", "pos", *[F.col(f"_z.{w}") for w in ws])
    made = [F.when(F.col(ws[s - 1]).isNotNull(), gram_hash([F.col(w) for w in ws[:s]])) for s in sizes]
    hashed = at.select("*", made[0].alias("hash"), F.lit(sizes[0]).alias("size")) if len(sizes) == 1 else at.select("*", F.explode(F.arrays_zip(F.array(*made).alias("hash"), F.array(*map(F.lit, sizes)).alias("size"))).alias("_h")).select("*", "_h.hash", "_h.size").drop("_h")
    split = F.split("gram", " ")
    known = grams.select("gram", F.size(split).alias("_size"), *[F.get(split, F.lit(j)).alias(f"g{j + 1}") for j in range(SHINGLE)])
    by_size = F.lit(None).cast("long")
    for s in sizes:
        by_size = F.when(F.col("_size") == s, gram_hash([F.col(f"g{j + 1}") for j in range(s)])).otherwise(by_size)
    known = known.withColumn("hash", by_size)
    same = (F.col("size") == F.col("_size")) & (F.col("w1") == F.col("g1"))
    for j in range(2, SHINGLE + 1):
        same = same & ((F.col("_size") < j) | (F.col(f"w{j}") == F.col(f"g{j}")))
    side = F.broadcast(known) if grams.count() <= BROADCAST_SHINGLES else known
    return hashed.join(side, "hash").where(same).select("_k1", "_k2", "n_words", "pos", "gram")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, with_keys: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    n_hit counts the words inside any occurrence of any window, n_items the items with windows that occur. A null text
    has no words. Rows that repeat each get the same result; null ids of documents are kept. Items that repeat count
    once by id. Other columns are ignored, whatever their names. Empty tables give no rows, or no hits. Texts of any
    length are read whole. with_keys adds _k1 and _k2, the hashes by which common.row_key tells rows apart.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    wins = cut(windows_of(benchmark, item_col, item_text_col, window))
    parts = cut(shingles_of(wins))
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # at most SHINGLE values

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    keys = row_key(F.col(id_col), F.col("_text"))
    if not sizes:
        found = spark.createDataFrame([], "_k1 long, _k2 long, n_hit long, items array<string>")
    else:
        tokens = rows.where("_text is not null").select(*keys, words(F.col("_text")).alias("_words"))
        postings = cut(postings_of(tokens, parts.select("gram").distinct(), sizes))
        counts = postings.groupBy("gram").agg(F.count("*").alias("times"))
        times = F.coalesce("times", F.lit(0))
        ranked = parts.join(counts, "gram", "left").groupBy("window").agg(F.min(times).alias("rarest"), F.min(F.struct(times, "gram", "offset")).alias("first"))
        prefix = cut(ranked.where("rarest > 0").select("window", "first.gram", "first.offset").join(wins.select("window", "n"), "window"))

        start = F.col("pos") - F.col("offset")
        inside = postings.join(prefix, "gram").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        places = cut(inside.select("_k1", "_k2", "window", "n", start.alias("start")).distinct())
        # a window's shingles at every SHINGLE-th place, and its last one, cover its words
        cover = parts.where((F.col("offset") % SHINGLE == 0) | (F.col("offset") == F.col("n") - F.col("size"))).select("window", "offset", "gram")
        needed = places.join(cover, "window").select("_k1", "_k2", "window", "n", "start", (F.col("start") + F.col("offset")).alias("pos"), "gram")
        there = needed.join(postings.select("_k1", "_k2", "pos", "gram").distinct(), ["_k1", "_k2", "pos", "gram"], "left_semi")
        lengths = cover.groupBy("window").agg(F.count("*").alias("all"))
        hits = there.groupBy("_k1", "_k2", "window", "n", "start").agg(F.count("*").alias("met")).join(lengths, "window").where(F.col("met") == F.col("all"))
        hits = cut(hits.select("_k1", "_k2", "window", "start", (F.col("start") + F.col("n")).alias("stop")))
        grown = F.aggregate(
            F.sort_array("spans"), F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("total")),
            lambda a, s: F.struct(F.greatest(a["stop"], s["stop"]).alias("stop"), (a["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["stop"], s["start"]))).cast("long").alias("total")),
        )
        spans = hits.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select("_k1", "_k2", grown["total"].alias("n_hit"))
        owners = wins.select("window", F.explode(F.transform("items", lambda x: x.cast("string"))).alias("item"))
        names = hits.select("_k1", "_k2", "window").distinct().join(owners, "window").groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
        found = spans.join(names, ["_k1", "_k2"])
    counted = rows.select(F.col(id_col), F.size(words(F.col("_text"))).cast("long").alias("n_words"), *keys)
    joined = counted.join(found, ["_k1", "_k2"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), *["_k1", "_k2"] * with_keys)
