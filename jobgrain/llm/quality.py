"""Quality scores learned from preference pairs (Bradley-Terry) and cut at a score quantile."""

from dataclasses import dataclass
from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.llm.html import STOP_WORDS

SAMPLE = 40_000
PAIRS_EACH = 6
THRESHOLD = 0.3
FOLDS = 5
# Steps of the score distribution that the cut is read from.
QUANTILES = 1_000


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def _described(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep` columns and `features`: numbers that describe the whole text, each of a fixed range. Null counts as ''."""
    n = F.greatest(F.size("w"), F.lit(1))
    size = F.greatest(F.length("b"), F.lit(1))

    def share(pattern: str, of: Column = size) -> Column:
        return F.least(F.regexp_count("b", F.lit(pattern)) / of, F.lit(1.0))

    stop = F.filter("w", lambda x: F.lower(F.regexp_replace(x, r"\p{Punct}+$", "")).isin(sorted(STOP_WORDS)))
    again = F.filter("w", lambda x, i: F.lower(x) == F.lower(F.get("w", i - 1)))
    parts = [
        F.log1p(F.size("w")) / 10,
        F.least(F.length(F.array_join("w", "")) / n, F.lit(20.0)) / 10,
        F.size(stop) / n,
        F.size(again) / n,
        F.size(F.array_distinct("w")) / n,
        share(r"[.,;:]", n),
        share(r"[^\p{L}\p{N}\s.,;:'\"()\-]") * 4,
        share(r"\p{Lu}"),
        F.sqrt(share(r"\p{N}")),
        F.log1p(n / (F.regexp_count("b", F.lit("\n")) + 1)) / 10,
    ]
    return (df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("b"))
            .withColumn("w", F.filter(F.split("b", r"\s+"), lambda x: x != ""))
            .select(*keep, F.array(*[p.cast("double") for p in parts]).alias("features")))


@dataclass(frozen=True)
class Ranker:
    """score = logistic(weights . features - cut + log odds of the threshold)."""
    weights: tuple[float, ...]
    cut: float

    def raw(self, values: Column) -> Column:
        return sum((F.get(values, F.lit(i)) * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, values: Column) -> Column:
        return 1 / (1 + F.exp(-(self.raw(values) - self.cut + log(THRESHOLD / (1 - THRESHOLD)))))


def _cut(docs: DataFrame, usable: DataFrame, ranker: "Ranker", text: str) -> float:
    """The quantile of the scores of all documents in `usable` at the share of 0 labels; no text is shuffled for it."""
    scores = _described(docs.select("doc_id", F.col(text).alias("text")), "text", "doc_id").select(
        "doc_id", ranker.raw(F.col("features")).alias("s"))
    known = scores.groupBy("doc_id").agg(F.min("s").alias("s")).join(usable, "doc_id")
    held = known.agg(F.percentile_approx("s", F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)]), 10 * QUANTILES).alias("at"),
                     F.avg(1 - F.col("quality")).alias("share")).first()
    place = held["share"] * QUANTILES
    low = min(int(place), QUANTILES - 1)
    return held["at"][low] + (held["at"][low + 1] - held["at"][low]) * (place - low)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs_each: int = PAIRS_EACH, text: str = "text") -> Ranker:
    """Learn a ranker from `quality` labels outside the held-out fold.

    At most `sample` labelled documents of `docs` are used for the weights, those with
    the lowest hash of their id. Every document labelled 0 is paired with `pairs_each` documents
    labelled 1, and the logistic loss on the difference of their features is
    minimised without an intercept. The cut is the quantile of the scores of all
    labelled documents outside the held-out fold at their share of 0 labels, so as many
    of them fall below it as are labelled 0.

    Labels that are null or neither 0 nor 1, or of documents that `docs` does not have,
    are left out; of several labels of a document the highest counts. If only one label occurs
    there is nothing to rank: all weights are 0 and the cut puts every document on
    the side of that label; without labels every document passes.
    """
    usable = (labels.where((remainder() != 0) & F.col("quality").isin(0, 1))
              .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
              .join(docs.select("doc_id"), "doc_id", "left_semi"))
    chosen = usable.withColumn("mix", F.xxhash64("doc_id")).orderBy("mix", "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    known = _described(texts, "text", "doc_id", "quality", "mix").groupBy("doc_id", "mix").agg(
        F.max("quality").alias("quality"), F.min("features").alias("features"))
    known = known.persist()
    ranks = known.withColumn("place", F.row_number().over(Window.partitionBy("quality").orderBy("mix", "doc_id")) - 1).persist()
    counts = {r["quality"]: r["count"] for r in ranks.groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    try:
        if not good or not bad:
            return Ranker((), 1e9 if bad else 0.0)
        lows = ranks.where("quality = 0").select(F.col("features").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(pairs_each - 1))).alias("k"), "place")
        lows = lows.withColumn("place", F.expr(f"cast((cast(place as bigint) * {pairs_each} + k) % {good} as int)"))
        pairs = lows.join(ranks.where("quality = 1").select("place", F.col("features").alias("high")), "place")
        # Half of the pairs are turned round, so that both outcomes occur.
        turned = pairs.withColumn("won", (F.col("k") % 2).cast("double")).select("won", array_to_vector(F.zip_with(
            "high", "low", lambda h, x: F.when(F.col("won") == 1, h - x).otherwise(x - h))).alias("difference"))
        turned = turned.persist()
        model = LogisticRegression(featuresCol="difference", labelCol="won", fitIntercept=False, standardization=True,
                                   regParam=1e-3, maxIter=100).fit(turned)
        turned.unpersist()
        ranker = Ranker(tuple(float(x) for x in model.coefficients), 0.0)
        return Ranker(ranker.weights, _cut(docs, usable, ranker, text))
    finally:
        ranks.unpersist()
        known.unpersist()


def score(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null and empty texts get the score of ''.

    Rows are independent and nothing is shuffled. Only the text enters the score. A
    null doc_id is not held out. Extra columns are not looked at.
    """
    described = _described(docs.select("doc_id", F.col(text).alias("text")), "text", "doc_id")
    value = ranker.score(F.col("features"))
    return described.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), value.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores at least the threshold, all columns unchanged."""
    packed = docs.select(F.struct("*").alias("_document"), F.col(text).alias("_text"))
    # A filter on the score would be pushed below the features and make all of them once per weight;
    # it stays above a projection that has a number in it which is not a function of the row.
    described = _described(packed, "_text", "_document").withColumn("_number", F.monotonically_increasing_id())
    return described.where((F.col("_number") >= 0) & (ranker.score(F.col("features")) >= THRESHOLD)).select("_document.*")
