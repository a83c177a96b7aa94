import pytest

#: Columns that clash with names the operators use inside.
EXTRA = "shard int, text2 string, set_id string, n string, length string, rank string, `key` string, score string"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with columns that clash."""

    def make(rows, lang=None):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        extra = [f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in EXTRA.split(", ")]
        return df.selectExpr("doc_id", "text", f"cast({lang or 'null'} as string) as lang", "'s' as source", *extra)

    return make
