"""Note -> category classification.

TF-IDF as a table (K2) is plain DataFrame work: explode tokens, count per
(doc, token), document frequency per token, an equi-join on the token and
an L2 norm per document.  The model (K3) is an MLlib pipeline whose IDF
stage is corrected to the smoothed ``ln((1+n)/(1+df)) + 1`` weighting by an
element-wise scaling vector of vocabulary size.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (CountVectorizer, ElementwiseProduct, IDF, Normalizer,
                                RegexTokenizer, StringIndexer, IndexToString)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counted, half_even, py_round
from ..schema import MIN_CATEGORY_ROWS
from ..session import discard, materialize
from .sharded import ShardedModel, fit_laid_out, fit_sharded, lay_out, predict_sharded
from .skew import salted_join

TOKEN_MIN = 2
# doubles of the multinomial model that the driver holds and sends to every
# task in each iteration; the library's scaled features also take more of them
MAX_COEFFICIENTS = 1 << 18


def train_test_split(df: DataFrame, test_share: int = 5, seed: int = 42, key=("clean_notes",)
                     ) -> DataFrame:
    """K1: repeatable 80/20 split by an md5 of the row (independent of
    partitioning and input order, unlike ``randomSplit``)."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in key])
    low = F.substring(F.md5(text), 1, 8) < F.lit(f"{2 ** 32 // test_share:08x}")
    return df.withColumn("split", F.when(low, "test").otherwise("train"))


def tokens(df: DataFrame, text: str = "clean_notes", doc: str = "doc_id") -> DataFrame:
    """Word tokens of at least two characters (cleaned text: split on spaces)."""
    return (df.select(doc, F.explode(F.split(F.col(text), " ")).alias("token"))
            .filter(F.length("token") >= TOKEN_MIN))


def token_counts(df: DataFrame, text: str = "clean_notes", doc: str = "doc_id") -> DataFrame:
    """(doc, token, tf).  A document of one row is counted within its row;
    only rows that share an id with others are shuffled, by (doc, token)."""
    # written, so that the planner knows how few there are
    shared = materialize(df.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(doc), "shared")
    words = F.filter(F.split(F.col(text), " "), lambda t: F.length(t) >= TOKEN_MIN)
    single = df.join(shared, doc, "left_anti").select(doc, F.inline(counted(words)))
    return single.unionByName(tokens(df.join(shared, doc, "left_semi"), text, doc)
                              .groupBy(doc, "token").agg(F.count(F.lit(1)).alias("tf")))


def tfidf_features(df: DataFrame, text: str = "clean_notes", doc: str = "doc_id",
                   digits: int = 9) -> DataFrame:
    """K2: (doc, token, tfidf) with raw counts, smoothed idf and L2 norm.

    A very common token is one key of the document-frequency group-by
    (partial aggregation) and is split over sub-keys in the tf-idf join."""
    # one (doc, token) count feeds the df, the hot-token list, the weights
    # and the norms: materialise it once instead of re-tokenising per branch
    tf = materialize(token_counts(df.filter(F.col(doc).isNotNull()), text, doc), "tf")
    dfreq = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # scalar subquery; documents without an id have no terms and don't count
    n_docs = df.filter(F.col(doc).isNotNull()).select(F.count(F.lit(1)).cast("double")).scalar()
    idf = dfreq.select("token", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df")))
                                 + F.lit(1.0)).alias("idf"))
    # a very common token is split over sub-keys (its rows are one per document)
    w = salted_join(tf, idf, ["token"], salt_from=[doc],
                    counts=dfreq.select("token", F.col("df").alias("_n")), written=True)
    w = w.withColumn("w", F.col("tf") * F.col("idf"))
    # L2 norm per document: a window over one document's distinct tokens
    # (bounded by that one input row), no aggregate-and-join back
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, "token", half_even(F.col("w") / norm, digits).alias("tfidf"))


def keep_frequent_categories(df: DataFrame, min_rows: int = MIN_CATEGORY_ROWS,
                             col: str = "category") -> DataFrame:
    """Rows whose category has at least ``min_rows`` rows.  The categories
    are written when the frame is built."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    # written, so that the planner knows if they are few and broadcasts them
    # without a shuffle of the rows; otherwise AQE splits the rows of a huge one
    big = materialize(counts.filter(F.col("_n") >= min_rows).select(col), "frequent")
    return df.join(big, col, "left_semi").select(*df.columns)


def train_category_model(train: DataFrame, text: str = "clean_notes", label: str = "category",
                         max_iter: int = 1000, tol: float = 1e-4,
                         max_coefficients: int = MAX_COEFFICIENTS) -> PipelineModel | ShardedModel:
    """K3: tokens -> counts -> smoothed idf -> L2 -> multinomial logistic
    regression (L2 penalty with C = 1, i.e. regParam = 1/n, unstandardised;
    at most 1000 iterations, stopping tolerance 1e-4 as the reference's
    library defaults).  Beyond ``max_coefficients`` (tokens x categories) the
    coefficients stay in a table (``sharded.fit_sharded``)."""
    counts = {r[0]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = None
    if counts and None not in counts:
        # the words are found and counted once, for the choice and for the table
        layout = lay_out(train, text, label, rows=sum(counts.values()))
        size = layout.size
        if size * len(counts) > max_coefficients:
            return fit_laid_out(layout, max_iter, tol)
        discard(layout.blocks)
        discard(layout.links)
    # the library's fit passes over the training rows several times (vocabulary,
    # idf, labels, iterations): keep them once instead of re-cleaning the texts
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern="\\w\\w+", gaps=False)
        # the reference's vocabulary has no limit: room for every distinct token
        if size is None:
            size = tok.transform(train).select(F.explode("_tok").alias("t")).distinct().count()
            if size * len(counts) > max_coefficients:
                return fit_sharded(train, text, label, max_iter, tol)
        cv = CountVectorizer(inputCol="_tok", outputCol="_tf", vocabSize=max(size, 1))
        lab = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
        pre = Pipeline(stages=[tok, cv, lab]).fit(train)
        counted = pre.transform(train)
        idf_model = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
        # Spark's idf is ln((n+1)/(df+1)); the smoothed weighting adds 1
        scale = Vectors.dense([x + 1.0 for x in idf_model.idf.toArray()])
        n = train.count()
        post = Pipeline(stages=[
            ElementwiseProduct(inputCol="_tf", outputCol="_w", scalingVec=scale),
            Normalizer(inputCol="_w", outputCol="features", p=2.0),
            LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial",
                               maxIter=max_iter, tol=tol, regParam=1.0 / max(n, 1),
                               elasticNetParam=0.0, standardization=False),
            IndexToString(inputCol="prediction", outputCol="predicted_category",
                          labels=pre.stages[-1].labels),
        ]).fit(counted)
        return PipelineModel(stages=pre.stages + post.stages)
    finally:
        train.unpersist()


def predict_category(model: PipelineModel | ShardedModel | None, df: DataFrame, known: list[str] | None = None,
                     fallback: str = "Other") -> DataFrame:
    """K4: predicted category and its probability (3 decimals) for every
    row; no model -> fallback with NULL confidence; a prediction outside
    ``known`` (default: the model's training labels) is replaced by the
    fallback."""
    if model is None:
        return df.withColumn("predicted_category", F.lit(fallback)).withColumn(
            "confidence", F.lit(None).cast("double"))
    if isinstance(model, ShardedModel):
        return predict_sharded(model, df, known=known, fallback=fallback)
    out = model.transform(df)
    conf = py_round(F.array_max(vector_to_array("probability")), 3)
    pred = F.col("predicted_category")
    known = list(model.stages[-1].getLabels()) if known is None else known
    pred = F.when(pred.isin(known), pred).otherwise(F.lit(fallback))
    keep = [c for c in df.columns]
    return out.select(*keep, pred.alias("predicted_category"), conf.alias("confidence"))
