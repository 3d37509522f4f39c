"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: the model of each sees the words of a text and the
probabilities of the categories before it. In training those are out-of-fold predictions, so a later
model meets the same kind of error as when scoring. Models are Spark ML logistic regressions on
the presence of the words that tell most in their training rows.

Models are fitted on at most `sample` labelled documents (those of least hash of their number);
every document is scored.

Cases: a null or empty text is scored by its (lack of) words; a category without both classes
in the labels or telling words has a
constant probability, the share of positives, or 0 without labels; rows without a label only get
scores; of rows with one number each is scored by itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage


def words_in(text: Column) -> Column:
    """The words of a text, each once, without marks behind them."""
    return F.array_distinct(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\s.,;:!?]+", -1), ""))


def telling_words(rows: DataFrame, category: str, n: int, positive: int, most: int, least: int) -> list[str]:
    """The `most` words whose presence depends most on the category, by chi-square."""
    share = positive / n
    counts = rows.select(category, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("t"), F.sum(category).alias("a"))
    t, expected = F.col("t"), F.col("t") * share
    score = F.pow(F.col("a") - expected, 2) / (expected * (1 - share) * (1 - t / n) + F.lit(1e-9))
    return [r.word for r in counts.where(t >= least).orderBy(score.desc(), "word").limit(most).collect()]


@dataclass
class Chain:
    """`categories` are label columns (1 is positive), in the order in which they are predicted.

    Each model knows the presence of `words` words, those that tell most in its training rows.
    """

    categories: Sequence[str] = ("poor", "toxic")
    sample: int = 20_000
    words: int = 128
    least: int = 5
    folds: int = 3
    penalty: float = 1e-4
    rounds: int = 30
    models: dict = field(default_factory=dict)

    def fitted(self, rows: DataFrame, k: int) -> PipelineModel | float:
        """A model of category k, or its share where there is nothing to learn from."""
        category = self.categories[k]
        n, positive = rows.agg(F.count("*"), F.sum(category)).first()
        words = telling_words(rows, category, n, positive, self.words, self.least) if n and 0 < positive < n else []
        if not words:
            return float(positive / n) if n else 0.0
        present = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="present", binary=True)
        together = VectorAssembler(inputCols=["present", *[f"p_{c}" for c in self.categories[:k]]], outputCol="inputs")
        learner = LogisticRegression(featuresCol="inputs", labelCol=category, probabilityCol="chance", rawPredictionCol="raw", predictionCol="guess", maxIter=self.rounds, regParam=self.penalty, standardization=False)
        ready = together.transform(present.transform(rows)).select("inputs", category)
        return PipelineModel([present, together, learner.fit(ready)])

    def predicted(self, rows: DataFrame, model: PipelineModel | float, k: int) -> DataFrame:
        name = f"p_{self.categories[k]}"
        if isinstance(model, float):
            return rows.withColumn(name, F.lit(model))
        scored = model.transform(rows).withColumn(name, vector_to_array("chance")[1])
        return scored.drop("present", "inputs", "chance", "raw", "guess")

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", judge: bool = False) -> DataFrame:
        """Fit all models; returns the training rows with their out-of-fold probabilities.

        Nothing learns from those of the last category; they are computed to `judge` the chain.
        """
        named = labels.select(F.col(id_col).alias("name"), *[F.col(c).cast("double").alias(c) for c in self.categories]).dropna().dropDuplicates(["name"])
        chosen = named.orderBy(F.xxhash64("name"), "name").limit(self.sample)
        # the sample is bounded, so texts stay where they are and only its rows are cut into words
        texts = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "name")
        texts = texts.withColumn("words", words_in(F.col("text"))).drop("text")
        rows = cut_lineage(texts.withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "name"), F.lit(self.folds))), "chain").coalesce(8)
        for k, category in enumerate(self.categories):
            rows.persist()
            self.models[category] = self.fitted(rows, k)
            if k + 1 < len(self.categories) or judge:
                out = None
                for f in range(self.folds):
                    part = self.predicted(rows.where(F.col("fold") == f), self.fitted(rows.where(F.col("fold") != f), k), k)
                    out = part if out is None else out.unionByName(part)
                rows.unpersist()
                rows = cut_lineage(out, "chain").coalesce(8)
        return rows

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, p_<category> ...) with `row` the whole row of `docs`."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words_in(F.col(f"`{text_col}`")).alias("words"))
        for k, category in enumerate(self.categories):
            rows = self.predicted(rows, self.models[category], k)
        return rows.drop("words")


def category_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, poor, toxic) from quality and toxicity marks."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """(doc_id, p_poor, p_toxic, is_toxic) of every row."""
    chain = Chain(**settings)
    chain.fit(docs, category_labels(labels))
    scored = chain.score(docs)
    return scored.select("row.doc_id", *[f"p_{c}" for c in chain.categories], (F.col("p_toxic") >= threshold).alias("is_toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """`docs` without the documents whose toxicity reaches the threshold; all columns stay."""
    chain = Chain(**settings)
    chain.fit(docs, category_labels(labels))
    return chain.score(docs).where(F.col("p_toxic") < threshold).select("row.*")
