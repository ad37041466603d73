"""Light heads on vectors, by Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import ranks
from lakeweave.operators.prepare import keyed


def _parts(df: DataFrame, vector: str, label: str, fold: Column):
    """Folds 0 to 2 train, 3 validates, 4 tests; the scaler knows the training rows alone."""
    x = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"), fold.alias("fold"))
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(x.filter("fold <= 2"))
    z = scaler.transform(x)
    return z.filter("fold <= 2"), z.filter("fold = 3"), z.filter("fold = 4")


def logistic_probe(df: DataFrame, vector: str, label: str, fold: Column, sweep: tuple[float, ...] = (0.01, 0.1, 1.0)) -> DataFrame:
    train, valid, test = _parts(df, vector, label, fold)
    score = lambda m, part: m.transform(part).agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("s")).first().s or 0.0
    fits = [(c, LogisticRegression(featuresCol="z", labelCol="y", regParam=c, maxIter=50).fit(train)) for c in sweep]
    c, best = max(fits, key=lambda f: (score(f[1], valid), -f[0]))
    return best.transform(test).agg(F.lit(c).alias("reg"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def ridge_probe(df: DataFrame, vector: str, label: str, fold: Column, sweep: tuple[float, ...] = (0.01, 0.1, 1.0)) -> DataFrame:
    train, valid, test = _parts(df, vector, label, fold)
    score = lambda m, part: m.transform(part).agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("s")).first().s or 0.0
    fits = [(c, LinearRegression(featuresCol="z", labelCol="y", regParam=c, elasticNetParam=0.0, solver="normal").fit(train)) for c in sweep]
    c, best = min(fits, key=lambda f: (score(f[1], valid), f[0]))
    return best.transform(test).agg(F.lit(c).alias("reg"), F.round(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)), 4).alias("rmse"), F.count("*").alias("n"))


def _accuracy(m, part: DataFrame) -> float:
    return m.transform(part).agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("s")).first().s or 0.0


def forest_probe(df: DataFrame, vector: str, label: str, fold: Column, classes: bool = True, trees: int = 50, sweep: tuple[int, ...] = (4, 8)) -> DataFrame:
    """Random forests, their depth chosen on the held-out fold; accuracy, or the root of the mean squared error."""
    train, valid, test = _parts(df, vector, label, fold)
    kind = RandomForestClassifier if classes else RandomForestRegressor
    error = lambda m, part: 1 - _accuracy(m, part) if classes else m.transform(part).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("s")).first().s or 0.0
    fits = [(d, kind(featuresCol="z", labelCol="y", numTrees=trees, maxDepth=d, seed=0).fit(train)) for d in sweep]
    depth, best = min(fits, key=lambda f: (error(f[1], valid), f[0]))
    out = 1 - error(best, test) if classes else error(best, test)
    return test.agg(F.lit(depth).alias("depth"), F.lit(round(out, 6)).alias("accuracy" if classes else "rmse"), F.count("*").alias("n"))


def mlp_probe(df: DataFrame, vector: str, label: str, fold: Column, dim: int, classes: int, sweep: tuple[int, ...] = (16, 64)) -> DataFrame:
    """One hidden layer, its width chosen on the held-out fold."""
    train, valid, test = _parts(df, vector, label, fold)
    fits = [(w, MultilayerPerceptronClassifier(featuresCol="z", labelCol="y", layers=[dim, w, classes], maxIter=100, seed=0).fit(train)) for w in sweep]
    width, best = max(fits, key=lambda f: (_accuracy(f[1], valid), -f[0]))
    return test.agg(F.lit(width).alias("width"), F.lit(round(_accuracy(best, test), 6)).alias("accuracy"), F.count("*").alias("n"))


def cleaned_target(c: Column) -> Column:
    """A number written with commas or a percent sign; null where there is none."""
    x = F.regexp_replace(c.cast("string"), "[,%]", "").try_cast("double")
    return F.when(~F.isnan(x), x)


def boosted_probe(df: DataFrame, key: str, vector: str, target: str, seed: str = "boost") -> DataFrame:
    """Boosted trees on four fifths of the rows in hash order; the mean squared error of the rest, the target scaled to 0 .. 1. Rows without a target go."""
    known = df.withColumn("_y", cleaned_target(F.col(target))).filter(F.col("_y").isNotNull())
    low, high, n = known.agg(F.min("_y"), F.max("_y"), F.count("*")).first()
    if n < 10:
        raise ValueError("too few rows have a target")
    scaled = known.withColumn("y", (F.col("_y") - low) / (high - low + 1e-6)).withColumn("x", array_to_vector(F.col(vector).cast("array<double>")))
    rows = ranks.placed(scaled.withColumn("_h", keyed(seed, key)), "_h", [key], "_r").select("x", "y", "_r")
    cut = n // 5 * 4
    model = GBTRegressor(featuresCol="x", labelCol="y", maxDepth=5, maxIter=20, seed=0).fit(rows.filter(F.col("_r") < cut))
    rest = model.transform(rows.filter(F.col("_r") >= cut))
    return rest.agg(F.round(F.avg((F.col("prediction") - F.col("y")) ** 2), 6).alias("mse"), F.count("*").alias("n"))
