"""Preparation, models and evaluation of the good-price classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_counted, pinned, ranks
from ..operators.stats import column_stats, vocabulary
from .labels import guard
from .trees import Boosted, boost


@dataclass(frozen=True)
class Preparation:
    """Median, mean and deviation of numeric columns; of each categorical one a table (value, at, n) of its known values
    (those of two rows or more, all or the `most` most frequent), numbered in order, and how many there are. The table stays
    in Spark, so that a column may have millions of values."""

    numeric: dict[str, tuple[float, float, float]]
    categorical: dict[str, tuple[DataFrame, int]]

    @staticmethod
    def fit(df: DataFrame, numeric: list[str], categorical: list[str], most: int | None = None) -> Preparation:
        guard([*numeric, *categorical])
        stats = {r["column"]: (r["median"] or 0.0, r["mean"] or 0.0, r["std"] or 1.0) for r in column_stats(df, numeric).collect()} if numeric else {}
        tables = {}
        for c in categorical:
            known = vocabulary(df, [c]).drop("column")
            known = known.orderBy(F.desc("n"), "value").limit(most) if most is not None else known
            table = pinned(ranks(known, [F.col("value")], "__at").select("value", (F.col("__at") - 1).cast("double").alias("at"), "n"))
            tables[c] = table, table.count()
        return Preparation(stats, {c: t for c, t in tables.items() if t[1]})

    def transform(self, df: DataFrame) -> DataFrame:
        """df with features: the numeric columns, filled and scaled, then a place for each known value. Vectors are sparse where
        that is shorter; an unknown value has no place. Common values are handed to all tasks, the others joined."""
        scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - a) / s for c, (m, a, s) in self.numeric.items()]
        out, parts, names = df, [], df.columns
        if scaled:
            out, parts = out.withColumn("__numeric", array_to_vector(F.array(*scaled))), ["__numeric"]
        for k, (c, (table, size)) in enumerate(self.categorical.items()):
            keyed = out.withColumn("value", F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))))
            out = join_counted(keyed, table, "value", "n", F.xxhash64(*names)).drop("value", "n").withColumn(f"__at{k}", F.coalesce("at", F.lit(float(size)))).drop("at")
            encoder = OneHotEncoder(inputCol=f"__at{k}", outputCol=f"__hot{k}", handleInvalid="keep", dropLast=True)  # the last place, of unknown values, is dropped
            out = encoder.fit(df.sparkSession.createDataFrame([(size - 1.0,)], f"__at{k} double")).transform(out)
            parts.append(f"__hot{k}")
        return VectorAssembler(inputCols=parts, outputCol="features").transform(out).select(*names, "features")


def balanced(df: DataFrame, label: str = "good") -> DataFrame:
    """Weights that make both classes count alike."""
    n = df.groupBy(label).count().collect()  # two rows
    total = sum(r["count"] for r in n)
    weight = F.lit(1.0)
    for r in n:
        weight = F.when(F.col(label) == r[label], total / (len(n) * r["count"])).otherwise(weight)
    return df.withColumn("weight", weight)


def boosted(df: DataFrame, rounds: int = 400, seed: int = 42, label: str = "good", hold_out: float = 0.15, **more) -> Boosted:
    """Boosted trees with balanced classes, small steps, an l2 penalty and 15 rows a leaf; rounds end early when they no longer
    help on a share `hold_out` of the rows."""
    return boost(balanced(df, label), label=label, weight="weight", rounds=rounds, seed=seed, hold_out=hold_out, **more)


def network(df: DataFrame, seeds: tuple[int, ...] = (42,), label: str = "good", rounds: int = 100) -> list:
    """One model per seed; they score as an ensemble."""
    n = len(df.select("features").first()["features"])
    return [MultilayerPerceptronClassifier(labelCol=label, layers=[n, 64, 32, 2], maxIter=rounds, seed=s).fit(df) for s in seeds]


def scored(models, df: DataFrame) -> DataFrame:
    """prob: the mean probability of a good price."""
    models = models if isinstance(models, list) else [models]
    out, names = df, []
    for k, m in enumerate(models):
        out = m.transform(out).withColumn(f"__p{k}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        names.append(F.col(f"__p{k}"))
    return out.withColumn("prob", sum(names[1:], names[0]) / len(names)).drop(*(f"__p{k}" for k in range(len(models))))


def folds(df: DataFrame, k: int, key: list[str], label: str = "good", seed: int = 42) -> DataFrame:
    """fold from 0 to k - 1, stratified: by the order of a hash of the key and the seed, the same wherever it is run.
    Ranks are counted inside 1000 hash ranges plus the ranges before, so no class has to fit in one task."""
    h = F.xxhash64(*key, F.lit(seed))
    own = df.withColumn("__h", h).withColumn("__r", F.shiftright("__h", 54))
    sums = own.groupBy(label, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(label, "__r", before.alias("__b"))
    nth = F.row_number().over(Window.partitionBy(label, "__r").orderBy("__h", *key))
    return own.withColumn("__k", nth).join(base, [label, "__r"]).withColumn("fold", ((F.col("__b") + F.col("__k") - 1) % k).cast("int")).drop("__h", "__r", "__k", "__b")


def out_of_fold(df: DataFrame, k: int, fit) -> DataFrame:
    """df: features, fold and label. fit: from training rows to models. Every row scored by the models that haven't seen it."""
    out = None
    for n in range(k):
        part = scored(fit(df.filter(F.col("fold") != n)), df.filter(F.col("fold") == n))
        out = part if out is None else out.unionByName(part)
    return out


def thresholds(rows: DataFrame, label: str = "good") -> DataFrame:
    """t from 0.05 to 0.95 by 0.01 with tp, fp, fn, tn, precision, recall, f1 and accuracy of prob >= t. Rows are
    counted by the last threshold that they pass, and sums run over these hundred counts."""
    reach = F.least(F.lit(96), F.floor(F.col("prob").cast("decimal(20,12)") * 100)).cast("int")
    counts = rows.groupBy(reach.alias("reach")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = rows.sparkSession.range(5, 96).select(F.col("id").cast("int").alias("step"))
    met = grid.join(F.broadcast(counts), F.lit(True), "left")  # 91 x 97 rows at most
    over = F.coalesce(F.col("reach") >= F.col("step"), F.lit(False))
    sums = met.groupBy("step").agg(*(F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).alias(n) for n, test, c in (("tp", over, "pos"), ("fp", over, "neg"), ("fn", ~over, "pos"), ("tn", ~over, "neg"))))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    accuracy = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return sums.select((F.col("step") / 100).alias("t"), "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), accuracy.alias("accuracy"))


def best_threshold(rows: DataFrame, label: str = "good") -> DataFrame:
    """The first threshold of the largest F1, with its metrics."""
    return thresholds(rows, label).orderBy(F.desc("f1"), "t").limit(1)


def auc(rows: DataFrame, label: str = "good") -> DataFrame:
    """One row: the share of (good, other) pairs in which the good one scores higher, ties counting half; 0.5 if a
    class is missing. Scores are counted first, and ranks run over distinct ones, inside 1/1000 ranges plus those before."""
    counts = rows.groupBy("prob").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranged = counts.withColumn("r", F.floor(F.col("prob") * 1000))
    sums = ranged.groupBy("r").agg(F.sum("neg").alias("s"))
    base = sums.select("r", F.coalesce(F.sum("s").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # 1001 rows at most
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("r").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = ranged.withColumn("in", inside).join(F.broadcast(base), "r").withColumn("below", F.col("b") + F.col("in"))
    total = below.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(F.coalesce(F.try_divide("u", F.col("p") * F.col("n")), F.lit(0.5)).alias("auc"))


def verdict(prob: Column, threshold: float) -> Column:
    return F.when(prob >= threshold + 0.1, "good").when(prob <= threshold - 0.1, "expensive").when(prob.isNotNull(), "arguable")


def annotate(df: DataFrame, models, preparation: Preparation, threshold: float) -> DataFrame:
    """Priced rows with prob and verdict; the others without."""
    own = scored(models, preparation.transform(df.filter("price IS NOT NULL"))).drop("features")
    prob = F.bround("prob", 3)
    return own.withColumns({"verdict": verdict(F.col("prob"), threshold), "prob": prob}).unionByName(df.filter("price IS NULL"), allowMissingColumns=True)


def experiments(df: DataFrame, configs: dict, k: int = 5) -> DataFrame:
    """configs: name to a function from df to (rows with features and good, fit). A row of metrics each, best F1 first."""
    results = []
    for name, config in configs.items():
        rows, fit = config(df)
        oof = out_of_fold(folds(rows, k, ["url"]), k, fit).select("prob", "good").cache()
        best, area = best_threshold(oof).first(), auc(oof).first()["auc"]
        results.append((name, best["t"], best["f1"], best["precision"], best["recall"], best["accuracy"], area))
        oof.unpersist()
    return df.sparkSession.createDataFrame(results, "name string, t double, f1 double, precision double, recall double, accuracy double, auc double").orderBy(F.desc("f1"), "name")
