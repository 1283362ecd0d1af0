from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from lodestone.session import configure


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    configure(session)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


DOC = (
    "doc_id string, title string, content string, author string, publish_time bigint, category string,"
    " tags array<string>, quality_score double, click_count bigint, like_count bigint, content_length int"
)


@pytest.fixture
def docs(spark):
    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            base = {
                "doc_id": f"d{i}", "title": "", "content": "", "author": "", "publish_time": 0, "category": "",
                "tags": [], "quality_score": 0.5, "click_count": 0, "like_count": 0, "content_length": 0,
            }
            full.append(tuple({**base, **r}[c.split()[0]] for c in DOC.split(", ")))
        return spark.createDataFrame(full, DOC)

    return make
