"""Decomposition of names without Python workers, against Python's own normalisation."""

import random
import unicodedata

from pyspark.sql import functions as F

from phaseflux.functions import text
from phaseflux.plans import catalog


def plain(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def decompose(spark, values):
    return [r.d for r in spark.createDataFrame(list(enumerate(values)), "i int, s string").orderBy("i").select(text.decomposed(F.col("s")).alias("d")).collect()]


def test_every_code_point(spark):
    points = [chr(x) for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000]
    values = ["|".join(points[i : i + 2000]) for i in range(0, len(points), 2000)]
    assert decompose(spark, values) == ["|".join(map(plain, points[i : i + 2000])) for i in range(0, len(points), 2000)]


def test_any_text(spark):
    rng = random.Random(6)
    odd = "eéÉ́̂ﬁ½Ⅳ①한글ﷺ㎎ạ̈𝒳𝟙ΩΩ豈ば゙‍\n {}%$\\"
    values = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(500)] + ["", None, "plain", "naïve café — ﬂoxacin®", "x" * 50_000 + "ﬁé"]
    assert decompose(spark, values) == [None if x is None else plain(x) for x in values]


def test_the_query_has_no_python(spark):
    plan = catalog.QUERIES["p6_canonical_drug"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
