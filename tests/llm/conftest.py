import pytest

EXTRA = "text2 string, shard int, slot long, r string, sig long, ref long, block long, word long, h long"


@pytest.fixture(scope="session")
def frame(spark):
    """(rows, schema) -> DataFrame with extra columns whose names the operators
    use inside."""
    def make(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F
            have = {c.lower() for c in df.columns}
            for c in ("shard", "slot", "r", "rid", "sig", "ref", "block", "b0", "w0", "h", "t", "rep", "n", "found", "owner", "listed", "x", "score", "c0"):
                if c not in have:
                    df = df.withColumn(c, F.lit("extra"))
        return df
    return make
