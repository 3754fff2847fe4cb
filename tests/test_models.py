"""Models as column functions: one load per worker, results as without Spark."""

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from quire.functions.models import model_function
from quire.operators import candidates as K


def test_one_load_per_worker(spark, tmp_path):
    """Two jobs of many tasks: every process that took part has loaded its model once."""
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            return {"by": 3}
    triple = model_function(load, lambda model, x: x * model["by"], "long")
    df = spark.range(0, 4000, 1, 32).select("id", triple(F.col("id")).alias("y"), (F.spark_partition_id()).alias("p"))
    for _ in range(2):
        assert df.where("y <> 3 * id").count() == 0
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads)) and 0 < len(loads) <= 32


def test_scorer_of_two_columns(spark):
    def score(model, query, text):
        return pd.Series([float(sum(w in t for w in q.split())) * model for q, t in zip(query, text)])
    scorer = model_function(lambda: 0.5, score, "double", inputs=2)
    rows = [("q", "fever cough", "d", f"c{i}", 0.1, t) for i, t in enumerate(["fever", "none", "cough and fever"])]
    df = spark.createDataFrame(rows, "query_id string, query string, doc_id string, chunk_id string, score double, text string")
    out = K.rerank_topk(df, 2, scorer=scorer).orderBy("rank").collect()
    assert [(r.chunk_id, r.rerank_score) for r in out] == [("c2", 1.0), ("c0", 0.5)]
