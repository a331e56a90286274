"""Spelling variants: words at distance one, found by walking compact tries with a Levenshtein automaton.

The words and their counts are a table. Its sorted ranges become compact tries (one label, one offset and one count a
node), a row each. Tries are broadcast a bounded batch at a time, and every word walks every trie of the batch depth
first with the automaton that accepts what is one insertion, deletion or replacement away: before the edit all children
are open, after it only the child with the word's next letter. What is found is reduced to a count and the best form
per word, in the task and then over the batches. Forms are followed to their roots by pointer doubling.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import LOWER, UPPER, cut, tidy

#: Words of a trie, bytes of the tries that are broadcast together, and words that a task walks with, about.
SHARD_WORDS = 100_000
BATCH_BYTES = 48 << 20
TASK_WORDS = 10_000


class Trie:
    """Nodes in breadth-first order, so that node i's edges are labels[start[i]:start[i + 1]] and edge p leads to p + 1."""

    def __init__(self, labels: str, start: bytes, counts: bytes):
        self.labels, self.start, self.counts = labels, array("i", start), array("q", counts)

    @staticmethod
    def pack(words: list[str], counts: list[int]) -> tuple[str, bytes, bytes]:
        """The parts of the trie of distinct words in code-point order."""
        labels, start, held = [], [], []
        level = [(0, len(words), 0)]
        while level:
            deeper = []
            for low, high, depth in level:
                start.append(len(labels))
                ends = low < high and len(words[low]) == depth  # the shortest word of the range comes first
                held.append(counts[low] if ends else 0)
                at = low + ends
                while at < high:
                    letter, first = words[at][depth], at
                    while at < high and words[at][depth] == letter:
                        at += 1
                    labels.append(letter)
                    deeper.append((first, at, depth + 1))
            level = deeper
        start.append(len(labels))
        return "".join(labels), np.array(start, np.int32).tobytes(), np.array(held, np.int64).tobytes()

    def follow(self, node: int, rest: str) -> int:
        """The automaton after its edit: only equal letters lead on. The count of the word that is reached, else 0."""
        find, start = self.labels.find, self.start
        for letter in rest:
            node = find(letter, start[node], start[node + 1]) + 1
            if not node:
                return 0
        return self.counts[node]

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Each word of the trie that is one edit away, once, with its count."""
        labels, start, node, size = self.labels, self.start, 0, len(word)
        for i in range(size + 1):
            own, rest, after = word[i : i + 1], word[i:], word[i + 1 :]
            for p in range(start[node], start[node + 1]):
                letter = labels[p]
                if letter != own:  # the same letter inserted here is found where its run of letters ends
                    if n := self.follow(p + 1, rest):
                        yield word[:i] + letter + rest, n
                    if own and (n := self.follow(p + 1, after)):
                        yield word[:i] + letter + after, n
            if own and own != after[:1] and (n := self.follow(node, after)):
                yield word[:i] + after, n
            if not own:
                return
            node = labels.find(own, start[node], start[node + 1]) + 1
            if not node:
                return


def word_counts(docs: DataFrame, run: Column, *, text_col: str = "text", least_letters: int = 6, least: int = 5) -> DataFrame:
    """The words (word, n) of at least least_letters code points with at least least occurrences in whole texts.

    Runs of A-Z, a-z and U+00C0 to U+00FF are words once A-Z is lower-cased; null and empty texts have none. run is a
    column over docs and `run`, a lower-cased run of letters, that gives the word (a null or short one doesn't count).
    """
    pieces = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-zÀ-ÿ]+"))
    raw = docs.withColumn("run", pieces).where(F.length("run") >= least_letters)
    plain = F.octet_length("run") == F.length("run")
    lower = raw.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    counted = lower.select(run.alias("word")).where(F.length("word") >= least_letters)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_deleted(id_col: Column, every: int) -> Column:
    """`run` less the code point h % length, if every divides h, the crc32 of `<id>:<run>` (a null id is empty)."""
    run = F.col("run")
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def build_tries(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Tries of sorted ranges of words (word, n), as rows (labels, start, counts) of shard_words words at most."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            labels, start, counts = Trie.pack(some[:shard_words], n[:shard_words])
            del some[:shard_words], n[:shard_words]
            return pa.RecordBatch.from_arrays([pa.array([labels]), pa.array([start]), pa.array([counts])], ["labels", "start", "counts"])

        some: list[str] = []
        n: list[int] = []
        for batch in batches:
            some += batch.column(0).to_pylist()
            n += batch.column(1).to_pylist()
            while len(some) >= shard_words:
                yield packed()
        if some:
            yield packed()

    ranges = max(1, -(-words.count() // shard_words))
    return words.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(tidy(build), "labels string, start binary, counts binary")


def spelling_variants(words: DataFrame, *, ratio: int = 5, shard_words: int = SHARD_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Every word of words (word, n) with its form, root, n, n_near and form_n.

    Two words are near if one inserted, deleted or replaced code point tells them apart; n_near counts a word's near
    words. Its form is the near word of the largest n (ties: the smallest in code-point order), if that n is at least
    ratio times its own; root follows forms to the last one. Words must be distinct; null words and counts take no part,
    an empty word is a word, other columns are ignored, and an empty table gives no rows. A word's occurrences rise
    ratio-fold (ratio at least 2) at each form, so chains of forms are short.
    """
    spark = words.sparkSession
    words = cut(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null and n > 0"))
    tries = cut(build_tries(words, shard_words).withColumn("shard", F.monotonically_increasing_id()))
    size = F.octet_length("labels") + F.octet_length("start") + F.octet_length("counts")
    batches: list[list[int]] = []
    held = 0
    for shard, n in sorted(tuple(r) for r in tries.select("shard", size.cast("long")).collect()):  # a row for shard_words words
        if not batches or held + n > batch_bytes:
            batches.append([])
            held = 0
        batches[-1].append(shard)
        held += n

    walkers = words.select("word").repartition(max(1, -(-words.count() // TASK_WORDS)))
    found = None
    for shards in batches:
        rows = tries.where(F.col("shard").isin(shards)).drop("shard").collect()  # batch_bytes, or one trie, at most
        shared = spark.sparkContext.broadcast([tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in rows])

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            loaded = [Trie(*parts) for parts in shared.value]
            for batch in batches:
                out: list[tuple[str, int, str, int]] = []
                for word in batch.column(0).to_pylist():
                    near = [(-n, other) for trie in loaded for other, n in trie.near(word)]
                    if near:
                        n, other = min(near)
                        out.append((word, len(near), other, -n))
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best", "best_n"])

        some = cut(walkers.mapInArrow(tidy(walk), "word string, n_near long, best string, best_n long"))
        shared.destroy()
        found = some if found is None else found.unionAll(some)
    if found is None:
        found = spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    reduced = words.join(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "word", "left")
    form_n = F.when(-F.col("best.n") >= ratio * F.col("n"), -F.col("best.n"))
    formed = reduced.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("best.word")).alias("form"))
    formed = cut(formed)
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): pointers are doubled until none moves, so a chain of n forms takes log2(n) rounds."""
    now = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(onward, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now
