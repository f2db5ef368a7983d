"""Baseline text classifier, and the hook for models made elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators.aggregates import class_weights


def word_bound_grams(text, low: int = 3, high: int = 5):
    """Character n-grams inside words, each word between spaces; words shorter than n give themselves once."""
    padded = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    grams = lambda w, n: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n))))
    every = lambda w: F.array_distinct(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when((F.length(w) > n) | (n == low), n)), lambda n: n.isNotNull()))
    return F.flatten(F.transform(tokens(text), lambda w: F.flatten(F.transform(every(padded(w)), lambda n: grams(padded(w), n)))))


def char_features(rows: DataFrame, text: str, n_features: int = 1 << 14) -> DataFrame:
    """Adds char_counts, the hashed counts of character n-grams, damped: 1 + log of each."""
    from pyspark.ml.feature import HashingTF

    grams = rows.withColumn("_g", word_bound_grams(F.lower(F.coalesce(F.col(text), F.lit("")))))
    return HashingTF(inputCol="_g", outputCol="char_counts", numFeatures=n_features).transform(grams).drop("_g")


def grid_choice(train: DataFrame, validation: DataFrame, text: str, label: str, n_classes: int, grid: list[float] | None = None):
    """(the classifier fitted again on both sets, its regularisation): of the candidates the one with best macro-F1 on the validation set, the first of equals."""
    from lectern.operators.aggregates import scores

    best = None
    for reg in grid or [0.001, 0.01, 0.1]:
        model = tfidf_classifier(train, text, label, n_classes, reg=reg)
        out = model.transform(validation.withColumn("class_weight", F.lit(1.0))).select(F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))
        f1 = scores(out, list(range(n_classes))).first()["macro_f1"]
        if best is None or f1 > best[0]:
            best = (f1, reg)
    return tfidf_classifier(train.unionByName(validation), text, label, n_classes, reg=best[1]), best[1]


def scored(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], classes: list[str], batch: int = 64) -> DataFrame:
    """rows with p_<class> for each class and pred, by a model made elsewhere.

    load() makes the model once in each worker: from texts to probabilities. Texts are taken by length, so that a batch's are alike, and come back in order.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {', '.join(f'p_{c} double' for c in classes)}, pred string"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in it:
            order = pdf[text].fillna("").str.len().sort_values(kind="stable").index
            found = {}
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                found.update(zip(part, model(pdf.loc[part, text].fillna("").tolist()), strict=True))
            probs = [found[i] for i in pdf.index]
            yield pdf.assign(**{f"p_{c}": [p[k] for p in probs] for k, c in enumerate(classes)}, pred=[classes[max(range(len(classes)), key=p.__getitem__)] for p in probs])

    return rows.mapInPandas(run, schema)


def tfidf_classifier(train: DataFrame, text: str, label: str, n_classes: int, features: int = 1 << 14, iterations: int = 15, reg: float = 0.01):
    """Words and pairs of words, hashed, weighted by inverse document frequency, into a balanced logistic regression; a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler

    weights = class_weights(train, label, n_classes).select(label, "class_weight")
    rows = train.join(F.broadcast(weights), label)  # one row a class
    steps = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\s+"), NGram(n=2, inputCol="_w", outputCol="_b"),
        HashingTF(inputCol="_w", outputCol="_wt", numFeatures=features), HashingTF(inputCol="_b", outputCol="_bt", numFeatures=features),
        VectorAssembler(inputCols=["_wt", "_bt"], outputCol="_t"), IDF(inputCol="_t", outputCol="features", minDocFreq=2),
        LogisticRegression(labelCol=label, weightCol="class_weight", maxIter=iterations, regParam=reg),
        SQLTransformer(statement="SELECT * EXCEPT (_w, _b, _wt, _bt, _t, features, rawPrediction, probability) FROM __THIS__"),
    ]
    return Pipeline(stages=steps).fit(rows)
