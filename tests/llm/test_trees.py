"""The boosted trees as conditions against the fitted model's own transform."""

import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from seqweave.llm import pii


def test_conditions_give_the_models_probability(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(600):
        x = [float(rng.randint(0, 5)), rng.random(), float(rng.randint(0, 1)), rng.gauss(0, 1)]
        rows.append((x, float((x[0] > 2) != (x[1] > 0.5) or x[3] > 1.2)))
    data = spark.createDataFrame(rows, "values array<double>, label double").withColumn("features", array_to_vector("values"))
    fitted = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.3, seed=3).fit(data)
    model = pii.Model([(float(w), pii._node(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)])
    both = fitted.transform(data).select(vector_to_array("probability")[1].alias("own"), pii.probability(model, F.col("values")).alias("conditions"))
    found = both.collect()
    assert len({round(r["own"], 6) for r in found}) > 10
    assert all(abs(r["own"] - r["conditions"]) < 1e-9 for r in found)
