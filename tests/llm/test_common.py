import pytest
from pyspark.sql import functions as F

from skyledger.llm.common import ascii_lower, crc_bucket, cut, row_key, scratch, words


def test_words_keys_and_cut(spark):
    df = spark.createDataFrame([(1, "Ab-c É2"), (1, "Ab-c É2"), (None, "Ab-c É2"), (1, None)], "k long, t string")
    got = df.select(words(F.col("t")).alias("w"), ascii_lower(F.col("t")).alias("l"), crc_bucket(F.col("k"), 4).alias("c"), *row_key(F.col("k"), F.col("t"))).collect()
    assert got[0].w == ["ab", "c", "É2"] and got[0].l == "ab-c É2" and got[3].w == [] and got[2].c is None
    assert len({(r._k1, r._k2) for r in got}) == 3
    again = cut(df)
    assert again.schema == df.schema and again.count() == 4


def test_scratch_removes_what_is_not_kept(spark):
    with scratch(spark):
        inner, outer = cut(spark.range(3)), cut(spark.range(4), kept=True)
        assert inner.count() == 3
    assert outer.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|no such|not_exist"):
        inner.count()
