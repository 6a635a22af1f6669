"""Shortcut models: how well labels can be told from what should tell nothing. Spark's own features and classes."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, HashingTF, NGram, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.streaming.ledger import shared_folder


def fold_of(group: Column, folds: int = 3) -> Column:
    """The fold of a group by its hash: all rows of a group are in one, whatever else the table holds."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), group.cast("string"))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def char_ngrams(text: Column, sizes=(3, 4, 5)) -> Column:
    """All runs of characters of those sizes, words apart; linear in the text."""
    t = X.let(F.split(F.concat(F.lit(" "), F.array_join(X.words(text), " "), F.lit(" ")), ""), lambda c: F.flatten(F.array(*[_runs(c, n) for n in sizes])))
    return t


def _runs(c: Column, n: int) -> Column:
    return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>"))


def left_out_rate(rows: DataFrame, key: str, prior: float | None = None) -> DataFrame:
    """``rows`` (y 0 or 1, fold, key) plus ``score``: the rate of y under the row's key in the other folds, the rate of
    the other folds as a whole where they don't have the key.

    Counts by (key, fold) and their totals: nothing is fitted fold by fold, and a hot key costs a row a fold."""
    by = rows.groupBy(key, "fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)  # a row a fold
    rest = by.select(F.col(key).alias("_k"), F.col("fold").alias("_f"), (F.sum("s").over(w) - F.col("s")).alias("_s"), (F.sum("n").over(w) - F.col("n")).alias("_n"))
    folds = by.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    all_ = Window.partitionBy(F.lit(1))  # a row a fold
    priors = folds.select(F.col("fold").alias("_pf"), F.try_divide(F.sum("fs").over(all_) - F.col("fs"), F.sum("fn").over(all_) - F.col("fn")).alias("_prior"))
    joined = rows.join(rest, F.col(key).eqNullSafe(F.col("_k")) & (F.col("fold") == F.col("_f")), "left").join(F.broadcast(priors), F.col("fold") == F.col("_pf"))
    return joined.withColumn("score", F.coalesce(F.try_divide("_s", "_n"), F.col("_prior"))).drop("_k", "_f", "_s", "_n", "_pf", "_prior")


def top_gap_tokens(rows: DataFrame, k: int = 20, support: int = 3) -> DataFrame:
    """(fold, token, gap): for each fold, the tokens whose share of documents among y = 1 exceeds that among y = 0 the
    most in the other folds; tokens in fewer than ``support`` of these count for nothing."""
    t = rows.select("fold", "y", F.explode(F.array_distinct(X.words(F.col("text")))).alias("token"))
    by = t.groupBy("token", "fold").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    total = by.groupBy("token").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    sizes = rows.groupBy("fold").agg(F.sum("y").alias("np"), F.sum(1 - F.col("y")).alias("nq"))
    all_ = Window.partitionBy(F.lit(1))  # a row a fold
    sizes = sizes.select("fold", (F.sum("np").over(all_) - F.col("np")).alias("np"), (F.sum("nq").over(all_) - F.col("nq")).alias("nq"))
    # Every fold asks about every token: a fold without it leaves the totals as they are.
    asked = total.join(F.broadcast(sizes)).join(by.select("token", "fold", "p", "q"), ["token", "fold"], "left")  # folds times tokens
    rest = asked.select("fold", "token", (F.col("tp") - F.coalesce("p", F.lit(0))).alias("p"), (F.col("tq") - F.coalesce("q", F.lit(0))).alias("q"), "np", "nq").where(F.col("p") + F.col("q") >= support)
    gap = F.round(F.col("p") / F.greatest("np", F.lit(1)) - F.col("q") / F.greatest("nq", F.lit(1)), 9)
    ranked = rest.where("p > 0").withColumn("gap", gap).withColumn("rn", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("gap"), "token")))
    return ranked.where(F.col("rn") <= k).select("fold", "token", "gap")


def token_rule(rows: DataFrame, top: DataFrame) -> DataFrame:
    """(id, y, score): how many of its fold's top tokens a text has."""
    t = rows.select("id", "fold", F.explode(F.array_distinct(X.words(F.col("text")))).alias("token"))
    hits = t.join(F.broadcast(top.select("fold", "token")), ["fold", "token"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("hits"))  # a few tokens a fold
    return rows.select("id", "y").join(hits, "id", "left").select("id", "y", F.coalesce("hits", F.lit(0)).cast("double").alias("score"))


def out_of_fold(rows: DataFrame, build, folds: int = 3) -> DataFrame:
    """(id, y, fold, score) with each row scored by a model that its fold had no part in.

    ``build(train)`` gives a fitted model with a ``probability``. Folds without both classes elsewhere score 0."""
    out = None
    for f in range(folds):
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        if train.select("y").distinct().count() < 2:
            scored = test.select("id", "y", "fold", F.lit(0.0).alias("score"))
        else:
            scored = build(train).transform(test).select("id", "y", "fold", F.element_at(vector_to_array("probability"), 2).alias("score"))
        out = scored if out is None else out.union(scored)
    return out


def hashed(rows: DataFrame, kinds, buckets: int) -> DataFrame:
    """``rows`` with ``tf_char`` and ``tf_word``, the hashed counts of their ``chars`` and of pairs of their ``words``, in
    place of these: n-grams are made once, one row at a time, and what all folds and passes read again is sparse
    vectors in Parquet in the shared folder, a hundredth of the n-grams as strings. Hashing knows no fold."""
    out, folder = rows, shared_folder(rows.sparkSession, "ngrams")
    for kind in kinds:
        if kind == "word":
            out = NGram(n=2, inputCol="words", outputCol="grams").transform(out)
        out = HashingTF(numFeatures=buckets, inputCol="grams" if kind == "word" else "chars", outputCol=f"tf_{kind}").transform(out)
    out.drop("chars", "words", "grams").write.option("parquet.block.size", str(in_bytes(SPLIT) // 2)).parquet(folder)  # else a split is a row group of 128 MB
    return small_splits(rows.sparkSession).read.parquet(folder)


#: Bytes of a file of sparse vectors that one task reads. In memory they are some six times as many, and a fit holds all of a task's.
SPLIT = "16m"


def small_splits(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose tasks read at most ``SPLIT`` of a file; ``spark`` stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    least = min((spark.conf.get("spark.sql.files.maxPartitionBytes"), SPLIT), key=in_bytes)
    own.conf.set("spark.sql.files.maxPartitionBytes", least)
    return own


def in_bytes(size: str) -> int:
    """Bytes of a setting such as 16m, 128MB or 134217728b."""
    number = size.lower().removesuffix("b")
    return int(number) if number.isdigit() else int(number[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[number[-1]]


def ngram_model(train: DataFrame, kind: str = "char", l1: bool = True, strength: float = 0.01, buckets: int = 1 << 15) -> PipelineModel:
    """TF-IDF of hashed n-grams of characters or words under a logistic regression, classes weighing the same. Rows may
    come hashed (``hashed``), or with their ``chars`` or ``words``."""
    return _weighted(train, [*_hashed(train, kind, buckets), LogisticRegression(labelCol="y", featuresCol="features", weightCol="w", elasticNetParam=float(l1), regParam=strength, maxIter=20)])


def _hashed(train: DataFrame, kind: str, buckets: int) -> list:
    idf = IDF(inputCol=f"tf_{kind}", outputCol="features", minDocFreq=2)
    if f"tf_{kind}" in train.columns:
        return [idf]
    if kind == "word":
        return [NGram(n=2, inputCol="words", outputCol="grams"), HashingTF(numFeatures=buckets, inputCol="grams", outputCol="tf_word"), idf]
    return [HashingTF(numFeatures=buckets, inputCol="chars", outputCol="tf_char"), idf]


def _weighted(train: DataFrame, stages: list) -> PipelineModel:
    n = train.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    w = n.select("y", (1 / F.col("n")).alias("w0"))
    mean = train.count() / 2
    return Pipeline(stages=stages).fit(train.join(F.broadcast(w), "y").withColumn("w", F.col("w0") * mean))


def chosen_model(train: DataFrame, kind: str, strengths=(0.01, 0.1), buckets: int = 1 << 14):
    """The same with squared penalty, whose strength is chosen on inner folds that keep groups together;
    where an inner fold lacks a class, the first strength."""
    features = Pipeline(stages=_hashed(train, kind, buckets)).fit(train)
    made = features.transform(train).select("y", "features", "inner")
    lr = LogisticRegression(labelCol="y", featuresCol="features", elasticNetParam=0.0, regParam=strengths[0], maxIter=15)
    if made.groupBy("inner").agg(F.count_distinct("y").alias("n")).where("n = 2").count() < 2:  # nothing to choose by
        return PipelineModel(stages=[*features.stages, lr.fit(made)])
    # Not a CrossValidator: it caches the rows of each fold, ten thousand vectors to a batch, while four models are fitted at once.
    judge = BinaryClassificationEvaluator(labelCol="y")
    means = {x: sum(judge.evaluate(lr.fit(made.where(F.col("inner") != k), {lr.regParam: x}).transform(made.where(F.col("inner") == k))) for k in (0, 1)) / 2 for x in strengths}
    best = max(strengths, key=means.get)  # of equal ones the first
    return PipelineModel(stages=[*features.stages, lr.fit(made, {lr.regParam: best})])


def nuisance_model(train: DataFrame, columns: list[str], trees: bool = False) -> PipelineModel:
    """A model that sees only nuisance columns: one-hot under a logistic regression, or boosted trees."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_i" for c in columns], handleInvalid="keep")
    if trees:
        stages = [index, VectorAssembler(inputCols=[f"{c}_i" for c in columns], outputCol="features"), GBTClassifier(labelCol="y", featuresCol="features", maxIter=8, maxDepth=3, maxBins=64, seed=7)]
        return Pipeline(stages=stages).fit(train)
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in columns], outputCols=[f"{c}_h" for c in columns], handleInvalid="keep")
    return _weighted(train, [index, hot, VectorAssembler(inputCols=[f"{c}_h" for c in columns], outputCol="features"), LogisticRegression(labelCol="y", featuresCol="features", weightCol="w", regParam=0.01, maxIter=30)])


def top_features(train: DataFrame, k: int = 12) -> DataFrame:
    """(token, weight) of the words with the largest weights either way in a model of all rows."""
    spark = train.sparkSession
    made = _weighted(train, [CountVectorizer(inputCol="words", outputCol="features", minDF=3.0, vocabSize=20000, binary=True), LogisticRegression(labelCol="y", featuresCol="features", weightCol="w", elasticNetParam=1.0, regParam=0.01, maxIter=30)])
    weights = list(zip(made.stages[0].vocabulary, (float(x) for x in made.stages[-1].coefficients.toArray()), strict=True))  # bounded by the vocabulary
    chosen = sorted((w for w in weights if w[1]), key=lambda w: (-abs(w[1]), w[0]))[: 2 * k]
    return spark.createDataFrame(chosen, "token string, weight double")


def probe(rows: DataFrame, dims: int | None = None) -> PipelineModel:
    """A linear probe on vectors: standardised, projected on ``dims`` principal components if asked, logistic."""
    stages = [StandardScaler(inputCol="v", outputCol="s", withMean=True)]
    if dims:
        stages.append(PCA(k=dims, inputCol="s", outputCol="p"))
    return Pipeline(stages=[*stages, LogisticRegression(labelCol="y", featuresCol="p" if dims else "s", regParam=0.01, maxIter=30)]).fit(rows)


def as_vectors(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``v``, the column as a vector; rows whose vector is null or holds null or non-finite values go."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & fine).withColumn("v", array_to_vector(F.col(column).cast("array<double>")))
