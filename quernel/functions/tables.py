"""Table functions and aggregates in Python, for SQL and DataFrames.

    register(spark)
    spark.sql("SELECT d.id, t.* FROM docs d, LATERAL terms_of(d.text) t")
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_TERM = re.compile(r"[^\W_]+")


@F.udtf(returnType="term string, position int")
class TermsOf:
    """The terms of a text, in lower case, with their positions; none of a null."""

    def eval(self, text: str):
        for k, m in enumerate(_TERM.finditer((text or "").lower())):
            yield m.group(), k


@F.pandas_udf("double")
def geometric_mean(v: pd.Series) -> float:
    """Of the positive values of a group; null without any."""
    import numpy as np

    v = v[v > 0]
    return float(np.exp(np.log(v).mean())) if len(v) else None


def register(spark: SparkSession) -> None:
    spark.udtf.register("terms_of", TermsOf)
    spark.udf.register("geometric_mean", geometric_mean)
