"""Trainable text classifiers on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.lexicons import STOP_WORDS
from inkwell.operators import terms
from inkwell.operators.tables import stored


def worder(text_col: str = "text") -> list:
    """Stages from text to its words, ``_w1``."""
    return [RegexTokenizer(inputCol=text_col, outputCol="_raw", pattern=r"(?U)[\p{L}\p{N}_]{2,}", gaps=False), StopWordsRemover(inputCol="_raw", outputCol="_w1", stopWords=STOP_WORDS, locale="en_US")]


def grammer(n_max: int) -> list:
    """Stages from words to one- to n-word terms, ``_terms``."""
    joined = SQLTransformer(statement=f"SELECT *, concat({', '.join(f'_w{n}' for n in range(1, n_max + 1))}) AS _terms FROM __THIS__")
    return [*[NGram(n=n, inputCol="_w1", outputCol=f"_w{n}") for n in range(2, n_max + 1)], joined]


def featurizer(text_col: str = "text", features: int = 1 << 12, n_max: int = 2) -> list:
    """Stages from text to counts of hashed one- to n-word terms, ``_tf``; none of them is fitted."""
    return [*worder(text_col), *grammer(n_max), HashingTF(numFeatures=features, inputCol="_terms", outputCol="_tf")]


def weigher(min_df: int = 2) -> IDF:
    """From counts to TF-IDF; a hashed term of fewer than ``min_df`` texts weighs 0."""
    return IDF(minDocFreq=min_df, inputCol="_tf", outputCol="features")


def classifier(kind: str):
    if kind == "forest":
        return RandomForestClassifier(numTrees=40, maxDepth=8, seed=42)
    if kind == "bayes":
        return NaiveBayes()
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=20))
    return LogisticRegression(maxIter=25, regParam=1e-3)


def indexer(label_col: str) -> StringIndexer:
    return StringIndexer(inputCol=label_col, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")


def fit(rows: DataFrame, label_col: str, kind: str = "logistic", text_col: str = "text", features: int = 1 << 12) -> PipelineModel:
    """A pipeline from text and a label of any type; labels are ordered by name."""
    return fit_counts(indexer(label_col).fit(rows), featurizer(text_col, features), weigher(), classifier(kind), rows)


def fit_counts(index, counting: list, idf: IDF, learner, rows: DataFrame) -> PipelineModel:
    """Fits what learns on term counts that are written once: no pass of the weights or the learner reads a text again."""
    counts = stored(PipelineModel([index, *counting]).transform(rows).select("label", "_tf"), "term-counts")
    weights = idf.fit(counts)
    return PipelineModel([index, *counting, weights, learner.fit(weights.transform(counts).select("label", "features"))])


def predict(model: PipelineModel, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, predicted, confidence)``; a classifier without probabilities has a null confidence."""
    names = model.stages[0].labels
    stages = PipelineModel(model.stages[1:])
    out = stages.transform(rows)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int") + 1)
    confidence = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(id_col, label.alias("predicted"), confidence.alias("confidence"))


def soft_vote(models: list[PipelineModel], rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The label of largest mean probability over models that give probabilities."""
    names = models[0].stages[0].labels
    out = None
    for i, m in enumerate(models):
        one = PipelineModel(m.stages[1:]).transform(rows).select(id_col, vector_to_array("probability").alias(f"p{i}"))
        out = one if out is None else out.join(one, id_col)
    mean = F.transform(F.arrays_zip(*[f"p{i}" for i in range(len(models))]), lambda z: sum((z[f"p{i}"] for i in range(len(models))), F.lit(0.0)) / len(models))
    top = F.array_max("_m")
    return out.withColumn("_m", mean).select(id_col, F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("_m", top).cast("int")).alias("predicted"), top.alias("confidence"))


def held_out(id_col: str = "doc_id", share: float = 0.2):
    """A fixed split by hash."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1000)) < int(share * 1000)


def evaluate(predicted: DataFrame, label_col: str) -> DataFrame:
    """Accuracy and mean confidence over all rows."""
    return predicted.agg(F.avg((F.col("predicted") == F.col(label_col).cast("string")).cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"), F.count("*").alias("rows"))


def cross_validate(rows: DataFrame, label_col: str, kind: str, folds: int = 2, id_col: str = "doc_id") -> list[float]:
    """Accuracy of each fold of a split by hash."""
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(folds))
    out = []
    for i in range(folds):
        model = fit(rows.where(fold != i), label_col, kind)
        scored = model.transform(rows.where(fold == i))
        out.append(MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored))
    return out


def forest_of(trees: int) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=42)


def counted_forest(rows: DataFrame, label_col: str, text_col: str = "text", features: int = 1000, n_max: int = 3, trees: int = 200) -> PipelineModel:
    """A forest on a counted vocabulary of 1- to 3-word terms; the driver sees the vocabulary, which ``features`` bounds, and the trees.

    The vocabulary are the ``features`` most frequent terms of those in two texts at least, ties by term.
    """
    known = rows.where(F.col(label_col).isNotNull()).withColumn("fold", F.lit(0))
    words = terms.numbered(PipelineModel(worder(text_col)).transform(known), [label_col])
    vocab = terms.vocabularies(words, features, n_max)[None]
    counting = [*grammer(n_max), CountVectorizerModel.from_vocabulary(vocab or [""], inputCol="_terms", outputCol="_tf")]
    model = fit_counts(indexer(label_col).fit(words), counting, weigher(0), forest_of(trees), words)
    return PipelineModel([model.stages[0], *worder(text_col), *model.stages[1:]])


def fold_accuracies(rows: DataFrame, label_col: str, folds: int = 5, id_col: str = "doc_id", group: str | None = None, text_col: str = "text", features: int = 1000, n_max: int = 3, trees: int = 200) -> DataFrame:
    """``(fold, label, rows, correct)`` of forests like ``counted_forest``'s, each fitted on all folds but one and scored on that.

    Folds are exactly stratified. With ``group``, folds are dealt to the groups by hash instead, so that related rows (an original and its paraphrase)
    stay in one. Null labels take no part.

    Texts are split once, and terms counted once by fold. Each forest's vocabulary is that of the folds it learns from; a text's counts are written over
    the union of these, and a forest reads its own part.
    """
    from inkwell.operators.voting import stratified_folds

    known = rows.where(F.col(label_col).isNotNull()).withColumn("_expected", F.col(label_col).cast("string")).drop(label_col)
    label_col = "_expected"
    if group:
        known = known.withColumn("fold", F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds)).cast("int"))
    else:
        known = stratified_folds(stored(known, "labelled"), label_col, id_col, folds)
    words = terms.numbered(PipelineModel(worder(text_col)).transform(known), [label_col])
    vocabularies = terms.vocabularies(words, features, n_max)
    every = sorted({t for v in vocabularies.values() for t in v})
    place = {t: i for i, t in enumerate(every)}
    counting = PipelineModel([*grammer(n_max), CountVectorizerModel.from_vocabulary(every or [""], inputCol="_terms", outputCol="_all")])
    counts = stored(counting.transform(words).select(label_col, "fold", "_all"), "term-counts")
    out = None
    for i in range(folds):
        own, other = counts.where(F.col("fold") == i), counts.where(F.col("fold") != i)
        slicer = VectorSlicer(inputCol="_all", outputCol="_tf", indices=[place[t] for t in vocabularies.get(i, vocabularies[None])] or [0])
        model = Pipeline(stages=[indexer(label_col), slicer, weigher(0), forest_of(trees)]).fit(other)
        names = F.array(*[F.lit(n) for n in model.stages[0].labels])
        said = PipelineModel(model.stages[1:]).transform(own).select(F.col("_expected").alias("label"), "prediction")
        right = F.element_at(names, F.col("prediction").cast("int") + 1) == F.col("label")
        one = said.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(right).alias("correct")).select(F.lit(i).cast("long").alias("fold"), "label", "rows", "correct")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_bands(results: DataFrame, bands: list[tuple[str, float | None, float | None]], keys: list[str]) -> DataFrame:
    """By ``keys``: accuracy, mean confidence, mean seconds, score accuracy and rows of ``predicted, expected, confidence, seconds, score``.

    A score is right if it lies in the band of the expected label: from the second value on, below the third; a missing bound is open and a label
    without a band is never right. The top band takes its lower bound alone. Nulls in a measure are left out of its mean.
    """
    inside = F.lit(False)
    for label, low, high in bands:
        here = F.col("expected") == label
        inside = inside | (here & (F.lit(True) if low is None else F.col("score") >= low) & (F.lit(True) if high is None else F.col("score") < high))
    return results.groupBy(*keys).agg(
        F.avg(F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"), F.avg("seconds").alias("mean_seconds"),
        F.avg(F.coalesce(inside, F.lit(False)).cast("double")).alias("score_accuracy"), F.count("*").alias("rows"))


def score_with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's predicted quality, by logistic regression fitted on the labelled rows outside the held-out split."""
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality").where(~held_out())
    return predict(fit(rows, "quality"), docs.select("doc_id", "text")).withColumn("confidence", F.round("confidence", 6))


def forest_accuracy(docs: DataFrame, label_col: str) -> DataFrame:
    """Held-out accuracy of a random forest for each label, and its support."""
    rows = docs.select("doc_id", "text", label_col).where(F.col(label_col).isNotNull())
    model = fit(rows.where(~held_out()), label_col, "forest", features=1 << 10)
    got = predict(model, rows.where(held_out())).join(rows.select("doc_id", label_col), "doc_id")
    return got.groupBy(label_col).agg(F.count("*").alias("support"), F.count_if(F.col("predicted") == F.col(label_col)).alias("correct"))


def paraphrase_pairs(docs: DataFrame, pairs: list[tuple[str, str]], text_col: str = "text", least: int = 30) -> DataFrame:
    """``(doc_id, text, label)``: each text of at least ``least`` characters, original and paraphrased."""
    from inkwell.functions.text import paraphrase

    rows = docs.where(F.length(text_col) >= least)
    return rows.select("doc_id", F.explode(F.array(F.struct(F.col(text_col).alias("text"), F.lit("original").alias("label")), F.struct(paraphrase(F.col(text_col), pairs).alias("text"), F.lit("paraphrased").alias("label")))).alias("x")).select("doc_id", "x.*")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
