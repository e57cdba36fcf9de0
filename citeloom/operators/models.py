"""Trained recommenders on pyspark.ml: matrix factorisation and a content-aware factorisation machine."""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel, Normalizer, OneHotEncoder, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.vectors import dot
from citeloom.operators.numbering import dense_ids
from citeloom.operators.recommend import vector_topk
from citeloom.session import cut_lineage


def factorise(pairs: DataFrame, rank: int = 64, iterations: int = 10, seed: int = 7):
    """An implicit-feedback ALS model of (user, item, n), users and items numbered densely, and the two id tables.

    The loss differs from logistic loss on sampled negatives: every unseen pair counts as a weak negative.
    """
    users = cut_lineage(dense_ids(pairs.select("user_id").distinct(), ["user_id"], "u"))
    items = cut_lineage(dense_ids(pairs.select("item_id").distinct(), ["item_id"], "i"))
    rows = pairs.join(users, "user_id").join(items, "item_id").select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.col("n").cast("float").alias("n"))
    als = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, seed=seed, userCol="u", itemCol="i", ratingCol="n", checkpointInterval=5)
    return als.fit(rows), users, items


def recommend_factors(model, users: DataFrame, items: DataFrame, asked: DataFrame, seen: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, rk, item_id, score): the k best unseen items of the asked users, by the sigmoid of the factors' product."""
    people = model.userFactors.join(users.join(asked, "user_id", "left_semi"), F.col("id") == F.col("u")).select(F.col("user_id").alias("id"), F.col("features").alias("vector"))
    things = model.itemFactors.join(items, F.col("id") == F.col("i")).select(F.col("item_id").alias("id"), F.col("features").alias("vector"))
    seen = seen.withColumnRenamed("user_id", "query_id")
    return vector_topk(things, people, k, cosine=False, seen=seen, own=True).withColumnRenamed("query_id", "user_id")


def content_features(pairs: DataFrame, users: DataFrame, bags: DataFrame, n_users: int, n_keywords: int) -> DataFrame:
    """pairs with `features`: the user's one-hot, then the item's weighted keyword bag normalised to 1 (index 0 stands for no keyword).

    users: (user_id, u) numbered from 0 to n_users - 1; bags: (item_id, keyword_id, weight), ids from 1 to n_keywords.
    """
    repeated = F.flatten(F.transform("bag", lambda b: F.array_repeat(b["keyword_id"].cast("string"), b["weight"].cast("int"))))
    lists = bags.groupBy("item_id").agg(F.collect_list(F.struct("keyword_id", "weight")).alias("bag")).select("item_id", repeated.alias("words"))
    rows = pairs.join(users.select("user_id", F.col("u").cast("double").alias("_u")), "user_id").join(lists, "item_id", "left").withColumn("words", F.coalesce("words", F.array(F.lit("0"))))
    # the vocabulary is as long as the model's own keyword part, which the driver holds
    count = CountVectorizerModel.from_vocabulary([str(k) for k in range(n_keywords + 1)], inputCol="words", outputCol="_counts")
    one_hot = OneHotEncoder(inputCol="_u", outputCol="_user", dropLast=False).fit(users.sparkSession.createDataFrame([(float(n_users - 1),)], "_u double"))
    for stage in (count, Normalizer(p=1.0, inputCol="_counts", outputCol="_bag"), one_hot, VectorAssembler(inputCols=["_user", "_bag"], outputCol="features")):
        rows = stage.transform(rows)
    return rows.drop("_u", "words", "_counts", "_bag", "_user")


def content_model(examples: DataFrame, factors: int = 16, epochs: int = 10, seed: int = 7):
    """A factorisation machine with logistic loss on (features, label)."""
    fm = FMClassifier(factorSize=factors, maxIter=epochs, stepSize=0.05, regParam=1e-4, solver="adamW", seed=seed, featuresCol="features", labelCol="label")
    return fm.fit(examples)


def loss_history(model) -> list[float]:
    """The loss after each epoch of a model just trained; empty for a loaded one."""
    return list(model.summary().objectiveHistory) if model.hasSummary else []


def save(model, ids: dict[str, DataFrame], path: str) -> None:
    """A model with the id tables that its rows stand for, so that changed inputs can't change their meaning."""
    model.write().overwrite().save(f"{path}/model")
    for name, table in ids.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, kind, path: str, *names: str):
    """A saved model of a kind (a pyspark.ml model class) and its id tables by name."""
    return kind.load(f"{path}/model"), {name: spark.read.parquet(f"{path}/{name}") for name in names}


def content_vectors(model, people: DataFrame, bags: DataFrame, n_users: int) -> tuple[DataFrame, DataFrame]:
    """The machine's scores as dot products: (id, vector) of users and of items, bias terms as further places.

    score(u, i) = w0 + w_u + item part + v_u . sum of the bag's weighted factors; the item part holds its linear terms
    and the products of its keywords among themselves. people: (user_id, u); bags: (item_id, keyword_id, weight).
    """
    spark = people.sparkSession
    factors, linear, start = model.factors.toArray(), model.linear.toArray(), float(model.intercept)
    # a row per feature; users and keywords, as many as the model itself holds on the driver
    rows = spark.createDataFrame([(i, factors[i].tolist(), float(linear[i])) for i in range(len(linear))], "f long, v array<double>, w double")
    left = people.join(rows, people["u"] == rows["f"]).select(F.col("user_id").alias("id"), F.concat("v", F.array(F.lit(1.0), F.col("w") + start)).alias("vector"))
    share = F.col("weight") / F.col("total")
    cells = bags.join(bags.groupBy("item_id").agg(F.sum("weight").alias("total")), "item_id").withColumn("x", share).join(rows, F.col("keyword_id") + n_users == F.col("f"))
    width = factors.shape[1]
    sums = cells.groupBy("item_id").agg(F.array(*[F.sum(F.col("x") * F.get("v", F.lit(d))) for d in range(width)]).alias("s"), F.sum(F.col("x") * F.col("w")).alias("lin"), F.sum(F.col("x") * F.col("x") * dot(F.col("v"), F.col("v"))).alias("own"))
    bias = F.col("lin") + (dot(F.col("s"), F.col("s")) - F.col("own")) / 2
    right = sums.select(F.col("item_id").alias("id"), F.concat("s", F.array(bias, F.lit(1.0))).alias("vector"))
    return left, right
