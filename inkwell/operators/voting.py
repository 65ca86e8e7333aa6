"""Exactly stratified folds, and a soft vote of a forest, a calibrated kernel machine and naive Bayes.

The radial kernel exp(-gamma |x - y|^2) is approximated by random Fourier features (Rahimi and Recht, 2007): cosines of random
projections, on which a linear machine is trained at the cost of a linear one. Its margins become probabilities by
sigmoids fitted on margins of rows that the machine hadn't seen (Platt, 1999), fold by fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.models import featurizer, weigher
from inkwell.operators.tables import stored

#: Blocks of a label's rows, by the head of their hash, that are ranked apart.
BLOCKS = 64


def stratified_folds(rows: DataFrame, label_col: str, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """Adds ``fold``: of each label any two folds hold the same number of rows, or one differs by one.

    Rows of a label are ranked by the hash of their id, in ``BLOCKS`` blocks of it whose sizes are counted first, so
    that no task ranks all rows of a hot label. Rows that repeat an id are told apart by their order in the input, so that
    must be a table. Null labels are a label.
    """
    hashed = rows.withColumn("_h", F.xxhash64(F.col(id_col).cast("string")))
    hashed = hashed.withColumns({"_b": F.shiftrightunsigned("_h", 64 - int(math.log2(BLOCKS))), "_m": F.monotonically_increasing_id()})
    sizes = stored(hashed.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_n")), "fold-sizes")  # BLOCKS rows a label
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(label_col).alias("_l"), F.col("_b").alias("_c"), before.alias("_before"))
    joined = hashed.join(starts, F.col("_l").eqNullSafe(F.col(label_col)) & (F.col("_b") == F.col("_c")))
    rank = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", "_m")) - 1 + F.col("_before")
    return joined.withColumn("fold", F.pmod(rank, F.lit(folds)).cast("int")).select(*rows.columns, "fold")


@dataclass
class Fourier:
    """Random Fourier features of the radial kernel."""

    weights: np.ndarray
    shifts: np.ndarray

    @classmethod
    def draw(cls, dim: int, width: int, gamma: float, seed: int = 7) -> Fourier:
        rng = np.random.Generator(np.random.PCG64(seed))
        return cls(rng.standard_normal((dim, width)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, width))

    def of(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / len(self.shifts)) * np.cos(x @ self.weights + self.shifts)

    def column(self, features: Column) -> Column:
        def turned(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.of(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        return array_to_vector(F.pandas_udf(turned, "array<double>")(vector_to_array(features)))


@dataclass
class Vote:
    """Three fitted members over one featuriser."""

    labels: list[str]
    text: PipelineModel
    forest: object
    bayes: object
    fourier: Fourier
    machines: list[LinearSVCModel]
    sigmoids: list[tuple[float, float]]

    def probabilities(self, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """``(id, forest, bayes, svm, raw_svm, vote)``: arrays of a probability for each label; ``raw_svm`` is 1 for the largest margin."""
        out = self.text.transform(rows)
        for name, model in (("forest", self.forest), ("bayes", self.bayes)):
            out = model.transform(out).withColumn(name, vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
        out = out.withColumn("features", self.fourier.column(F.col("features")))
        margins = []
        for k, model in enumerate(self.machines):
            out = model.transform(out).withColumn(f"_m{k}", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
            margins.append(F.col(f"_m{k}"))
        ps = [1 / (1 + F.exp(-(F.lit(a) * m + F.lit(b)))) for m, (a, b) in zip(margins, self.sigmoids)]
        if len(self.labels) == 2:
            margins, ps = [-margins[0], margins[0]], [1 - ps[0], ps[0]]
        total = sum(ps, F.lit(0.0))
        out = out.withColumn("svm", F.array(*[F.when(total > 0, p / total).otherwise(1.0 / len(ps)) for p in ps]))
        most = F.array_max(F.array(*margins))
        out = out.withColumn("raw_svm", F.array(*[F.when(m == most, 1.0).otherwise(0.0) for m in margins]))
        out = out.withColumn("vote", F.transform(F.arrays_zip("forest", "bayes", "svm"), lambda z: (z["forest"] + z["bayes"] + z["svm"]) / 3))
        return out.select(id_col, "forest", "bayes", "svm", "raw_svm", "vote")

    def predict(self, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """``(id, predicted, confidence)`` of the vote; ties go to the first label."""
        top = F.array_max("vote")
        names = F.array(*[F.lit(n) for n in self.labels])
        return self.probabilities(rows, id_col).select(id_col, F.element_at(names, F.array_position("vote", top).cast("int")).alias("predicted"), top.alias("confidence"))


def fit(rows: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", features: int = 1 << 10, width: int = 256, gamma: float = 0.02, trees: int = 200, folds: int = 3) -> Vote:
    """Members fitted on all rows with a label; the machine's sigmoids on its margins of ``folds`` stratified folds.

    Null labels go, null texts are empty. There must be two labels at least.
    """
    rows = rows.where(F.col(label_col).isNotNull()).withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    index = StringIndexer(inputCol=label_col, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    if len(index.labels) < 2:
        raise ValueError("a vote needs two labels")
    folded = stored(stratified_folds(index.transform(rows).select(id_col, text_col, "label"), "label", id_col, folds), "vote-rows")
    counting = PipelineModel(featurizer(text_col, features))
    counts = stored(counting.transform(folded).select("label", "fold", "_tf"), "vote-counts")  # texts are split once, whatever reads them
    weights = weigher().fit(counts)
    text, seen = PipelineModel([*counting.stages, weights]), weights.transform(counts).select("label", "fold", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=42).fit(seen)
    bayes = NaiveBayes().fit(seen)
    fourier = Fourier.draw(features, width, gamma)
    turned = stored(seen.withColumn("features", fourier.column(F.col("features"))), "vote-features")
    machines, sigmoids = [], []
    for k in [1] if len(index.labels) == 2 else range(len(index.labels)):
        own = turned.withColumn("label", (F.col("label") == k).cast("double"))
        machine = LinearSVC(maxIter=30, regParam=1e-4)
        margins = None
        for f in range(folds):
            part = machine.fit(own.where(F.col("fold") != f)).transform(own.where(F.col("fold") == f))
            part = part.select("label", F.array(vector_to_array("rawPrediction")[1]).alias("m"))
            margins = part if margins is None else margins.unionByName(part)
        sigmoid = LogisticRegression(maxIter=50, regParam=1e-4).fit(stored(margins, "vote-margins").withColumn("features", array_to_vector("m")))
        machines.append(machine.fit(own))
        sigmoids.append((float(sigmoid.coefficients[0]), float(sigmoid.intercept)))
    return Vote(list(index.labels), text, forest, bayes, fourier, machines, sigmoids)


def scores(vote: Vote, rows: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(member, rows, accuracy, brier)`` of each member, the vote, and the machine without calibration (``raw_svm``)."""
    truth = rows.select(id_col, F.array(*[(F.col(label_col).cast("string") == n).cast("double") for n in vote.labels]).alias("y"))
    known = vote.probabilities(rows, id_col).join(truth, id_col)
    members = F.explode(F.array(*[F.struct(F.lit(c).alias("member"), F.col(c).alias("p")) for c in ("forest", "bayes", "svm", "raw_svm", "vote")]))
    each = known.select("y", members.alias("x")).select("y", "x.*")
    right = F.element_at("y", F.array_position("p", F.array_max("p")).cast("int"))
    brier = F.aggregate(F.zip_with("p", "y", lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda a, x: a + x)
    return each.groupBy("member").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(brier), 6).alias("brier"))
