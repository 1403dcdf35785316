from pyspark.sql import functions as F

from custlens.sources import io as IO
from custlens.sources.profiling import profile, roles


def test_csv_with_quotes_commas_and_newlines(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('review_id,review_text,star_rating\n'
                    '1,"Great taste, fast ""delivery""",5\n'
                    '2,"Box arrived\nbroken",1\n'
                    '3,plain,3\n')
    df = IO.read_table(spark, str(path))
    assert dict(df.dtypes) == {"review_id": "int", "review_text": "string", "star_rating": "int"}
    rows = {r["review_id"]: r["review_text"] for r in df.collect()}
    assert rows == {1: 'Great taste, fast "delivery"', 2: "Box arrived\nbroken", 3: "plain"}


def test_catalog_pipeline_preview_shape(spark, tmp_path):
    a = tmp_path / "a.parquet"
    spark.range(5).withColumn("v", F.col("id") * 2).write.parquet(str(a))
    cat = IO.Catalog({"a": str(a)}, default="a")
    df = cat.load(spark, "missing-name")
    pipe = IO.Pipeline([lambda d: d.where("v > 2")])
    assert pipe.apply(df).count() == 3 and df.count() == 5  # the raw table is untouched
    assert [r["id"] for r in IO.preview(df, 2, ["id"]).collect()] == [0, 1]
    assert IO.shape(df).collect()[0].asDict() == {"n_rows": 5, "n_cols": 2}


def test_profile_roles(spark):
    df = spark.createDataFrame(
        [(1, 0, "x", "a long free text answer that is clearly over thirty chars", "2024-01-01"),
         (2, 1, "y", "another long free text answer well over thirty chars", "bad")],
        "id long, flag int, cat string, txt string, order_date string")
    prof = {r["column"]: r for r in profile(df).collect()}
    assert prof["flag"]["role"] == "binary"
    assert prof["cat"]["role"] == "categorical"
    assert prof["txt"]["role"] == "text"
    assert prof["order_date"]["role"] == "date"
    assert prof["id"]["role"] == "numeric, few values"
    r = {x["column"]: x for x in roles(profile(df)).collect()}
    assert r["txt"]["is_text"] and r["txt"]["is_categorical"]  # both tests are independent
    approx = {x["column"]: x["unique"] for x in profile(df, exact_distinct=False).collect()}
    assert approx["cat"] == 2
