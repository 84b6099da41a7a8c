"""Document-type classifier: TF-IDF of words and word pairs, and a linear model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.decisions import split_policy


def pipeline(model: str = "svm", *, vocabulary: int = (1 << 31) - 1, max_share: float = 0.95) -> Pipeline:
    """Stages from text and label to prediction; words of two characters or more, all terms of at most max_share of documents."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    terms = SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")
    counts = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary, maxDF=max_share)
    weights = IDF(inputCol="tf", outputCol="features")
    label = StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep")
    linear = OneVsRest(classifier=LinearSVC(maxIter=20), labelCol="y") if model == "svm" else LogisticRegression(labelCol="y", maxIter=100)
    return Pipeline(stages=[words, pairs, terms, counts, weights, label, linear])


def train(rows: DataFrame, *, model: str = "svm", seed: int = 42) -> tuple[PipelineModel, DataFrame | None]:
    """(model, held-out rows with predictions or None) from rows with text and label."""
    rows = rows.na.fill("", ["text"]).where("trim(text) <> '' and label is not null")
    n, classes = rows.count(), rows.select("label").distinct().count()
    held = split_policy(n, classes)
    if not held:
        return pipeline(model).fit(rows), None
    fit, test = rows.randomSplit([1 - held / n, held / n], seed=seed)
    fitted = pipeline(model).fit(fit)
    return fitted, fitted.transform(test)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict_types(model: PipelineModel, rows: DataFrame, ident: str) -> DataFrame:
    """ident, doc_type of rows with a text; blank or null ones are left out, for dml.update."""
    names = next(s.labels for s in model.stages if hasattr(s, "labels"))
    said = model.transform(rows.select(ident, "text").where("trim(text) <> ''"))
    return said.select(ident, F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")).alias("doc_type"))
