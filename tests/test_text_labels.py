"""k-NN and naive Bayes take text labels and decide as with numbered ones."""

import pytest
from pyspark.sql import functions as F

from custlens.operators import classify as C


@pytest.mark.parametrize("fit", [C.knn_classify, C.gaussian_nb])
def test_text_labels_equal_numbered_ones(spark, fit):
    rows = [(i, float((i * 37) % 50) + 40.0 * (i % 3), float((i * 13) % 29) - 15.0 * (i % 3), i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, u double, v double, n int").withColumn("_train", F.col("id") % 4 != 0)
    named = df.withColumn("t", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("n") + 1))
    by_number = {r["id"]: ("abc"[r["truth"]], "abc"[r["pred"]]) for r in fit(df, ["u", "v"], "n", "id").collect()}
    by_text = {r["id"]: (r["truth"], r["pred"]) for r in fit(named, ["u", "v"], "t", "id").collect()}
    assert by_text == by_number and len(by_text) == 38
