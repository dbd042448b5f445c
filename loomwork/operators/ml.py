"""Text classifiers on Spark ML: TF-IDF features, multinomial logistic regression, linear SVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.metrics import class_weights
from loomwork.session import shared_dir, written

#: A model is fitted on at most this many labelled rows, taken in the order of a hash of the id.
TRAIN_ROWS = 100_000


class TfIdf:
    """Word 1-2-grams; weight (1 + ln tf) * (ln((n+1)/(df+1)) + 1), rows of length 1."""

    def __init__(self, vocabulary: int = 10_000):
        self.vocabulary = vocabulary

    def fit(self, df: DataFrame, text: str = "text") -> TfIdf:
        self.text = text
        pipe = Pipeline(stages=[
            RegexTokenizer(inputCol="__t", outputCol="__w", pattern=r"(?U)\w\w+", gaps=False),
            NGram(n=2, inputCol="__w", outputCol="__b"),
            SQLTransformer(statement="select *, concat(__w, __b) __g from __THIS__"),
        ])
        self.prep = pipe.fit(self._in(df))
        grams = self.prep.transform(self._in(df))
        self.counts = CountVectorizer(inputCol="__g", outputCol="__c", vocabSize=self.vocabulary).fit(grams)
        n = df.count()
        vocab = {t: i for i, t in enumerate(self.counts.vocabulary)}
        # document frequencies of at most ``vocabulary`` terms reach the driver
        terms = df.sparkSession.createDataFrame([(t,) for t in vocab] or [("",)], "g string")
        dfs = grams.select(F.explode(F.array_distinct("__g")).alias("g")).join(F.broadcast(terms), "g").groupBy("g").agg(F.count("*").alias("n"))
        known = dfs.collect()
        idf = [1.0] * len(vocab)
        for r in known:
            idf[vocab[r["g"]]] = log((n + 1) / (r["n"] + 1)) + 1
        self.idf = idf
        return self

    def _in(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__t", F.lower(F.coalesce(F.col(self.text), F.lit(""))))

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        from pyspark.ml.feature import ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        c = self.counts.transform(self.prep.transform(self._in(df)))
        damp = _log_tf(c, "__c", "__l")
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="__l", outputCol="__s").transform(damp)
        done = Normalizer(p=2.0, inputCol="__s", outputCol=out).transform(scaled)
        return done.drop("__t", "__w", "__b", "__g", "__c", "__l", "__s")


def _log_tf(df: DataFrame, src: str, out: str) -> DataFrame:
    """1 + ln(tf) of the values of a sparse vector."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def damp(v):
        import numpy as np

        return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))

    return df.withColumn(out, damp(src))


def bounded(df: DataFrame, id_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """All rows, or the first ``rows`` of them in the order of a hash."""
    return df.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(rows)


def fit_classifier(
    train: DataFrame, label: str, kind: str = "logistic", iterations: int = 100, weights: DataFrame | None = None
) -> tuple[PipelineModel, StringIndexerModel]:
    """A balanced classifier on ``features``; ``kind`` is ``logistic`` or ``svm``.  ``weights`` (label, weight) are
    those of all rows where ``train`` is a part of them; one row a label."""
    known = class_weights(train, label) if weights is None else weights
    weighted = train.join(F.broadcast(known.select(label, "weight")), label)
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(weighted)
    # the solver passes over the rows once an iteration: features are made once
    rows = written(index.transform(weighted).select("features", "__y", "weight"), "training")
    n = max(1, rows.count())
    if kind == "logistic":
        est = LogisticRegression(labelCol="__y", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / n, maxIter=iterations)
    else:
        est = OneVsRest(labelCol="__y", weightCol="weight", classifier=LinearSVC(standardization=False, regParam=1.0 / n, maxIter=min(50, iterations)))
    return _reloaded(est.fit(rows), rows), index


def _reloaded(model, rows: DataFrame):
    """The model as saved and read again: without its training summary, which holds on to the session."""
    path = f"{shared_dir(rows.sparkSession)}/loomwork/models/{model.uid}"
    model.write().overwrite().save(path)
    return type(model).load(path)


def softmax(scores: Column) -> Column:
    """Shares of an array of scores, shifted by the largest."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def ranked_labels(shares: Column, labels: list[str], n: int = 3) -> Column:
    """``array<struct<confidence, label>>`` of the ``n`` largest shares, four digits, ties by label in reverse order."""
    pairs = F.arrays_zip(shares.alias("confidence"), F.array(*[F.lit(x) for x in labels]).alias("label"))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, n), lambda x: F.struct(F.round(x["confidence"], 4).alias("confidence"), x["label"].alias("label")))


def predict(model, index: StringIndexerModel, df: DataFrame, text: str | None = None, fallback: str = "unknown_other") -> DataFrame:
    """``df`` with ``prediction_label``, ``confidence``, ``margin`` (share of the best label less that of the second, four
    digits) and ``top`` (the best three).  A model without probabilities gives the softmax of its scores.

    Rows whose ``text`` (if given) is null or blank get the fallback with confidence and margin 0 and no top."""
    out = model.transform(df)
    labels = list(index.labels)
    shares = vector_to_array("probability") if "probability" in out.columns else softmax(vector_to_array("rawPrediction"))
    out = out.withColumn("__p", shares).withColumn("__s", F.sort_array("__p", asc=False))
    blank = F.lit(False) if text is None else F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    first, second = F.get("__s", F.lit(0)), F.coalesce(F.get("__s", F.lit(1)), F.lit(0.0))
    named = F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))
    out = out.withColumns({
        "prediction_label": F.when(blank, fallback).otherwise(named), "confidence": F.when(blank, 0.0).otherwise(F.round(first, 4)),
        "margin": F.when(blank, 0.0).otherwise(F.round(first - second, 4)), "top": F.when(~blank, ranked_labels(F.col("__p"), labels)),
    })
    return out.drop("prediction", "probability", "rawPrediction", "__p", "__s")


def ambiguous_cases(scored: DataFrame, truth: str, review: str = "needs_review") -> DataFrame:
    """The rows that the reviewers left open, with what the classifier makes of them."""
    return scored.filter(F.col(truth) == review).select("tweet_id", "prediction_label", "confidence", "margin", "top")


def save_model(model, index: StringIndexerModel, path: str) -> None:
    """Model and label index to a folder; one that exists is refused."""
    model.write().save(f"{path}/model")
    index.write().save(f"{path}/labels")


def load_model(path: str, kind: type):
    """What :func:`save_model` wrote; ``kind`` is the class of the model."""
    return kind.load(f"{path}/model"), StringIndexerModel.load(f"{path}/labels")


def hashed_encoder(df: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """A vector of ``size`` for each text from hashed words; the stand-in where no trained encoder is given."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z0-9]+"), 0)
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("vector", F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))


def encode_batches(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str, text: str = "text", batch: int = 256) -> DataFrame:
    """``key, vector`` by an encoder of the caller's, which takes texts in batches; vectors are scaled to length 1.

    Null texts are encoded as empty ones.  A batch that comes back with another number of vectors is an error."""
    kind = df.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            vectors = []
            for a in range(0, len(texts), batch):
                got = np.asarray(encode(texts[a : a + batch]), dtype=np.float32)
                if len(got) != len(texts[a : a + batch]):
                    raise ValueError("the encoder gave another number of vectors than texts")
                norm = np.linalg.norm(got, axis=1, keepdims=True)
                vectors += list(got / np.where(norm > 0, norm, 1))
            yield pd.DataFrame({key: pdf[key], "vector": [v.tolist() for v in vectors]})

    return df.select(key, text).mapInPandas(work, f"{key} {kind}, vector array<float>")


def check_vectors(corpus: DataFrame, vectors: DataFrame, key: str, low: float = 0.99, high: float = 1.01) -> DataFrame:
    """One row: ``n_corpus, n_vectors, n_missing`` (rows without vector), ``n_off`` (vectors whose length is not in [low, high])."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    both = corpus.select(F.col(key).alias("k"), F.lit(1).alias("c")).join(vectors.select(F.col(key).alias("k"), norm.alias("norm"), F.lit(1).alias("v")), "k", "full")
    return both.agg(
        F.count("c").alias("n_corpus"), F.count("v").alias("n_vectors"), F.count_if(F.col("v").isNull()).alias("n_missing"),
        F.count_if((F.col("norm") < low) | (F.col("norm") > high)).alias("n_off"),
    )


__all__ = ["TfIdf", "bounded", "check_vectors", "encode_batches", "fit_classifier", "hashed_encoder", "load_model", "predict", "save_model"]
