"""The native fold against Python's Unicode data: every code point, and texts of many."""

import random
import sys

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import names, unicode


def test_every_code_point(spark):
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    r = random.Random(1)
    words = ["".join(r.choices(every[:0x3000], k=20)) + r.choice(every) for _ in range(5000)] + ["", None]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(every) + len(words)), "c": every + words}))
    got = df.select("i", unicode.fold_marks(F.col("c")).alias("d")).toPandas().sort_values("i")["d"].tolist()
    want = [None if x is None else unicode.decomposed(x) for x in every + words]
    wrong = [(hex(i), g, w) for i, (g, w) in enumerate(zip(got, want, strict=True)) if g != w]
    assert not wrong, wrong[:5]


def test_folds_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("Ángel O’Łukasz ﬁ 한글",)], "n string").select(names.fold(F.col("n")).alias("f"))
    assert df.first().f == "angel olukasz fi " + unicode.decomposed("한글")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_expression_of_thousands_of_points(spark):
    """Such a class is tried point by point on every letter: 900,000 institutions' names took over four minutes."""
    df = spark.createDataFrame([("Collège of Arts",)], "n string").select(unicode.fold_marks(F.col("n")).alias("f"))
    assert df._jdf.queryExecution().analyzed().toString().count("\\x{") < 20
    assert df.first().f == "College of Arts"
