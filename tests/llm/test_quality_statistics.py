import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import quality


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (3000, quality.N_FEATURES))
    x[:600] += 0.6
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "doc_id long, x array<double>").repartition(3).cache()
    return x, df


def test_cuts_and_priors_are_of_all_documents(spark, features):
    x, df = features
    want = np.quantile(x, np.arange(1, quality.BINS) / quality.BINS, axis=0).T
    got = quality.all_cuts(df)
    assert np.abs(got - want).max() < 0.02
    model = quality.Model(got, np.random.default_rng(1).normal(0, 1, (quality.N_FEATURES, quality.BINS)), 0.1, 0.5)
    z = model.logit(model.bins(x))
    ids, fitted = np.arange(0, 3000, 10), np.arange(300) % 2 == 0
    part = quality.Half(model, z[:500], fitted)
    rest = np.setdiff1d(np.arange(3000), ids[fitted])
    assert quality.all_priors(df, [part], ids) == [pytest.approx(quality.estimate_prior(z[:500], z[rest]))]


def test_a_small_sample_does_not_decide_the_cuts(spark, features):
    x, df = features
    labels = df.where("doc_id < 400").select("doc_id", F.lit(1).alias("quality"))
    few = quality.fit(df, labels, max_unlabelled=50)
    assert np.abs(few.cuts - np.quantile(x, np.arange(1, quality.BINS) / quality.BINS, axis=0).T).max() < 0.02
