import pytest

TABLES = ("documents", "source_documents", "chunks", "ask_requests", "ask_results", "eval_dataset", "content_labels", "test_items", "source_targets", "split_limits")


@pytest.fixture(scope="session")
def make_dir(spark, small, tmp_path_factory):
    """A directory of tables: the given rows (dicts), other tables with the schemas of the test data and no rows."""

    def make(extra_column=None, **rows):
        path = tmp_path_factory.mktemp("tables")
        for name in TABLES:
            schema = spark.read.parquet(f"{small}/{name}.parquet").schema
            data = [tuple(r.get(c) for c in schema.names) for r in rows.get(name, [])]
            df = spark.createDataFrame(data, schema)
            if extra_column:
                df = df.selectExpr("*", f"'x' as {extra_column}")
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make
