import time

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (doc_id = position) or (doc_id, text) pairs."""

    def make(texts, **more):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make


@pytest.fixture
def shuffled(spark):
    """Bytes that the session has written to shuffles so far; Spark broadcasts no small table by itself, as at size."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(name)
    spark.conf.set(name, "-1")

    def total():
        time.sleep(0.5)  # the status store is brought up to date now and then, and with each task
        spark.range(1).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    yield total
    spark.conf.set(name, threshold)
