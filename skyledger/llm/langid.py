"""Language identification: known words first, character n-grams for unseen ones.

Fitting counts words per language on a bounded sample of labelled rows, and character n-grams (1 to 4, over the word
with its ends marked) of the same words. A known word scores its log frequency in each language. An unseen word is
read gram by gram: at each position the longest known n-gram counts, falling back to shorter ones. A text's score is
the sum over all its words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, tidy

LONGEST = 4
CACHED = 150_000


def letters_and_marks(stop: int) -> re.Pattern:
    """Runs of letters and combining marks (vowel signs of Indic scripts, accents), which belong to their word."""
    ranges = []
    for c in range(stop):
        if unicodedata.category(chr(c))[0] in "LM":
            if ranges and c == ranges[-1][1] + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")


#: The class up to U+FFFF is several times faster and serves texts without characters beyond it.
COMMON_WORDS, ALL_WORDS, BEYOND = letters_and_marks(0x10000), letters_and_marks(0x32000), re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    lower = text.lower()
    return (ALL_WORDS if BEYOND.search(lower) else COMMON_WORDS).findall(lower)


class LanguageModel(NamedTuple):
    langs: tuple[str, ...]
    words: dict[str, np.ndarray]  # log frequency per language, less the largest
    grams: dict[str, np.ndarray]


def quotas(counts: dict[str, int], max_rows: int) -> dict[str, int]:
    """How many rows of each language: all of the rare ones, equal parts of the rest for the others, never none."""
    out, left = {}, max_rows
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= out[lang]
    return out


def stratified_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """The (lang, text) rows of a sample: quotas() of each language, equal texts once, the same on every run.

    Hashes of texts are shuffled, not texts; texts move only if they are in the sample, once per task at most.
    """
    spark = rows.sparkSession
    hashed = rows.select("lang", "text", F.xxhash64(F.lit("sample"), "lang", "text").alias("h"))
    known = cut(hashed.select("lang", "h").distinct())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    most = quotas(counts, max_rows)
    # the lowest hashes win; twice as many as needed and some more are looked at, which is never too few
    bounds = spark.createDataFrame([(lang, min(1 << 30, int((1 << 30) * (2 * q + 100) / counts[lang]) + 1)) for lang, q in most.items()], "lang string, bound long")
    place = F.pmod("h", F.lit(1 << 30))
    low = known.join(F.broadcast(bounds), "lang").where(place < F.col("bound")).select("lang", "h", place.alias("place")).collect()
    chosen: dict[str, list[int]] = {}
    for r in sorted(low, key=lambda r: (r.place, r.h)):
        if len(some := chosen.setdefault(r.lang, [])) < most[r.lang]:
            some.append(r.h)
    ids = spark.createDataFrame([(lang, h) for lang, some in chosen.items() for h in some], "lang string, h long")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = hashed.join(F.broadcast(ids), ["lang", "h"], "left_semi").select("lang", "text", "h")
    # written, as several counts are made of it
    return cut(texts.mapInArrow(tidy(once), "lang string, text string, h long").dropDuplicates(["lang", "h"]).select("lang", "text"))


def word_grams(word: str) -> list[str]:
    """For each position the grams that start there, longest first, joined by position."""
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w)) for n in range(1, min(LONGEST, len(w) - i) + 1)]


def fit_language_model(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_rows: int = 8_000, max_words: int = 60_000, max_grams: int = 60_000) -> LanguageModel:
    """Fit on rows with text and language; max_rows rows, max_words words and max_grams n-grams at most.

    The rows are dealt over the languages, all of a rare one and equal parts of the others, and equal texts count once.
    Words of any length count, and all their n-grams. Texts without words add nothing; a language that has only such
    texts, or of which none is labelled, is not learned.
    Counts are made by the executors; only the most frequent words and grams, within the bounds, reach the driver.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = stratified_sample(rows, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in found.items():
            grams: Counter = Counter()
            for word, n in words.items():
                for g in word_grams(word):
                    grams[g] += n
            for kind, counts in (("w", words), ("g", grams)):
                if counts:  # texts without a word have none
                    columns = ([lang] * len(counts), [kind] * len(counts), list(counts))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(counts.values(), pa.int64())], ["lang", "kind", "key", "n"])

    # written, as totals and both tables are made of it
    counts = cut(rows.mapInArrow(tidy(count), "lang string, kind string, key string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")))
    totals = {(r.kind, r.lang): r.n for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = tuple(sorted({lang for _, lang in totals}))
    tables = []
    for kind, most in (("w", max_words), ("g", max_grams)):
        top = pd.DataFrame()
        if langs:
            share = F.create_map(*[x for (k, lang), n in totals.items() if k == kind for x in (F.lit(lang), F.lit(float(n)))])
            each = counts.where(F.col("kind") == kind).withColumn("share", F.col("n") / share[F.col("lang")])
            # a key is kept or left with its counts in all languages
            keys = each.groupBy("key").agg(F.max("share").alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
            kept = keys.orderBy(F.desc("share"), "key").limit(most)
            top = kept.select("key", F.explode("n").alias("lang", "n")).toPandas()
        tables.append(log_table(top, langs, {lang: totals[kind, lang] for lang in langs}))
    return LanguageModel(langs, *tables)


def log_table(top: pd.DataFrame, langs: tuple[str, ...], totals: dict[str, int]) -> dict[str, np.ndarray]:
    if not len(top):
        return {}
    wide = top.pivot_table(index="key", columns="lang", values="n", aggfunc="sum").reindex(columns=list(langs)).fillna(0).sort_index()
    logs = np.log((wide.to_numpy() + 0.5) / (np.array([totals[x] for x in langs]) + 0.5 * len(wide)))
    logs -= logs.max(1, keepdims=True)
    return dict(zip(wide.index, np.maximum(logs, -9.0), strict=True))


class Scorer(dict):
    """Row numbers of words' score vectors. New words get a number at once and their vectors together, in settle()."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.langs = model.langs
        table = lambda known: ({k: i for i, k in enumerate(known)}, np.stack([*known.values()]) if known else np.zeros((0, len(model.langs))))
        (self.words, self.word_rows), (self.grams, self.gram_rows) = table(model.words), table(model.grams)
        self.gram_weights = np.array([len(g) / LONGEST for g in model.grams])
        self.rows, self.n, self.new = np.zeros((1024, len(model.langs))), 0, []
        self.familiar = np.zeros(1024)  # 1 for known words, the known share of their n-grams for others

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def settle(self) -> None:
        if not self.new:
            return
        while self.n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.familiar = np.concatenate([self.familiar, np.zeros_like(self.familiar)])
        first, grams, words = self.n - len(self.new), self.grams.get, self.words.get
        known, found, ends, sizes = [], [], [], []
        for i, word in enumerate(self.new):
            at = words(word)
            if at is not None:
                known.append((i, at))
                sizes.append(4)
            else:
                w = f"^{word}$"
                sizes.append(len(w))
                for j in range(len(w)):
                    part = w[j : j + LONGEST]
                    while part:
                        g = grams(part)
                        if g is not None:
                            found.append(g)
                            break
                        part = part[:-1]
            ends.append(len(found))
        size = np.array(sizes)
        lengths, most = np.maximum(1.0, size / 4), (LONGEST - 1) * (size - LONGEST / 2) / LONGEST  # of grams of two and more
        weight = self.gram_weights[found]
        begins = np.array([0, *ends[:-1]])
        some = np.array(ends) > begins

        def summed(x: np.ndarray) -> np.ndarray:
            """Sums per word, each over its own grams only, so that they don't depend on a batch's other words."""
            out = np.zeros((len(begins), x.shape[1]))
            if len(x):
                out[some] = np.add.reduceat(x, begins[some], axis=0)
            return out

        familiar = summed((weight - 1 / LONGEST)[:, None])[:, 0] / np.maximum(most, (LONGEST - 1) / LONGEST)
        total = summed(self.gram_rows[found] * weight[:, None])
        total -= total.max(1, keepdims=True)
        total = np.maximum(total / lengths[:, None], -6.0)
        if known:
            places, rows = np.array(known).T
            total[places] = self.word_rows[rows]
            familiar[places] = 1.0
        self.rows[first : self.n] = total
        self.familiar[first : self.n] = familiar
        self.new.clear()

    def vector(self, word: str) -> np.ndarray:
        at = self[word]
        self.settle()
        return self.rows[at]

    def score(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share, and how much of the text is familiar: the mean over its words."""
        found = words_of(text) if text else []
        if not any(c.isalpha() for w in found for c in w) or not self.langs:
            return "und", 0.0, 0.0
        total, familiar = np.zeros(len(self.langs)), 0.0
        for at in range(0, len(found), 100_000):
            if self.n > CACHED:
                self.clear()
                self.n = 0
            part = found[at : at + 100_000]
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            self.settle()
            total += self.rows[rows].sum(0)
            familiar += float(self.familiar[rows].sum())
        total = total / np.sqrt(len(found))
        chances = np.exp(total - total.max())
        best = int(chances.argmax())  # ties: the first by name
        return self.langs[best], float(chances[best] / chances.sum()), familiar / len(found)


def predict_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_familiar: bool = False) -> DataFrame:
    """Add lang_pred and score to the columns in keep.

    The whole text is read. Null texts and texts without letters are ``und`` with score 0, as is everything if the
    model was fitted on no rows. Ties go to the language whose name sorts first. Rows that repeat, and null ids, are
    scored like any other; columns outside keep are ignored, whatever their names. An empty table gives no rows.
    with_familiar adds familiar, from 0 to 1: the mean over the text's words, 1 for a word of the model, for others the
    share of their n-grams of two and more characters that the model knows.
    """
    picked = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    width, at = len(keep), keep.index(text_col) if text_col in keep else len(keep)
    added = ["lang_pred", "score"] + ["familiar"] * with_familiar
    model_bc = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model_bc.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array([x[0] for x in found], pa.string()), *(pa.array([x[i] for x in found], pa.float64()) for i in range(1, len(added)))], [*keep, *added])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:width])
    return picked.mapInArrow(tidy(run), f"{fields}lang_pred string, score double" + ", familiar double" * with_familiar)
