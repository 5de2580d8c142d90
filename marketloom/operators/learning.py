"""Spark ML fits, class weights and prediction attribution."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from marketloom.operators import boosting
from marketloom.operators.rows import beside
from marketloom.session import cut_lineage

DIRECTION = boosting.Loss(log=True)
SQUARED = boosting.Loss(log=False)


@dataclass(frozen=True)
class Boosted:
    """Boosted trees with the surface of a fitted pipeline: `transform` adds
    `probability` to a direction model's rows and `prediction` to others'."""
    features: list[str]
    ensemble: boosting.Ensemble
    loss: boosting.Loss

    def transform(self, rows: DataFrame) -> DataFrame:
        out = boosting.margins({0: self.ensemble}, F.lit(0), feature_array(self.features))
        if not self.loss.log:
            return rows.withColumn("prediction", out)
        up = 1 / (1 + F.exp(-out))
        return rows.withColumn("probability", array_to_vector(F.array(1 - up, up)))


Model = PipelineModel | Boosted


def feature_array(features: list[str], within: list[str] | None = None) -> Column:
    """The features as an array, in the order of `within`, 0 where they lack one."""
    return F.array(*[F.col(f).cast("double") if f in features else F.lit(0.0) for f in within or features])


def fit_boosted(plan: boosting.Plan, parts: list[tuple[DataFrame, list[str], str]]) -> list[Boosted | None]:
    """Boosted models over (rows, features, label) parts, all in one go; None
    for a part without rows."""
    every = list(dict.fromkeys(f for _, features, _ in parts for f in features))
    rows = [df.select(F.lit(i).alias("model"), F.col(label).cast("double").alias("label"), feature_array(features, every).alias("x"))
            for i, (df, features, label) in enumerate(parts)]
    if not rows:
        return []
    fitted = boosting.fit_many(plan, reduce(DataFrame.unionByName, rows), every, {i: features for i, (_, features, _) in enumerate(parts)})

    def narrow(i: int) -> Boosted | None:
        features = parts[i][1]
        return Boosted(features, boosting.narrowed(fitted[i], [every.index(f) for f in features]), plan.loss) if i in fitted else None

    return [narrow(i) for i in range(len(parts))]


def direction_plan(rounds: int) -> boosting.Plan:
    return boosting.Plan(DIRECTION, rounds, 4, 0.1)


def volatility_plan(rounds: int) -> boosting.Plan:
    return boosting.Plan(SQUARED, rounds, 5, 0.05)


#: Training rows of a task: the linear fits pass over their rows many times, so small tables keep to few tasks.
TASK_ROWS = 50_000


def in_tasks(train: DataFrame, rows: int) -> DataFrame:
    """`train` in no more tasks than its number of rows asks for."""
    return train.coalesce(max(1, -(-rows // TASK_ROWS)))


def balanced(train: DataFrame, label: str) -> DataFrame:
    """Adds `weight` = n / (2 n_class)."""
    y = F.col(label)
    counts = train.agg(F.count_if(y == 1).alias("_up"), F.count_if(y == 0).alias("_down"))
    n, up, down = F.col("_up") + F.col("_down"), F.col("_up"), F.col("_down")
    weight = F.when(y == 1, F.try_divide(n, 2 * up)).otherwise(F.try_divide(n, 2 * down))
    return beside(train, counts).withColumn("weight", weight.cast("double")).drop("_up", "_down")


def _logistic(features: list[str], n: int) -> Pipeline:
    assemble = VectorAssembler(inputCols=features, outputCol="raw_features")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    fit = LogisticRegression(weightCol="weight", regParam=1.0 / max(n, 1), standardization=False, maxIter=1000)
    return Pipeline(stages=[assemble, scale, fit])


def fit_direction(train: DataFrame, features: list[str], label: str, kind: str = "boosted",
                  rounds: int = 200) -> Model:
    """Balanced direction classifier on rows without missing values."""
    if kind != "logistic":
        return fit_boosted(direction_plan(rounds), [(train, features, label)])[0]
    n = train.count()
    rows = in_tasks(balanced(train, label).withColumn("label", F.col(label).cast("double")), n)
    return _logistic(features, n).fit(rows)


def predict_direction(model: Model, rows: DataFrame) -> DataFrame:
    """Adds `proba_up`, `pred` (up from 0.5 on) and `confidence`."""
    p = vector_to_array("probability")[1]
    out = model.transform(rows).withColumn("proba_up", p)
    out = out.withColumn("pred", (F.col("proba_up") >= 0.5).cast("int"))
    return out.withColumn("confidence", F.greatest(F.col("proba_up"), 1 - F.col("proba_up"))).drop(
        "raw_features", "features", "rawPrediction", "probability", "prediction", "label", "weight")


def fit_regression(train: DataFrame, features: list[str], label: str, rounds: int = 300) -> Model:
    """Boosted regression trees, depth 5, rate 0.05."""
    return fit_boosted(volatility_plan(rounds), [(train, features, label)])[0]


def fit_ols(train: DataFrame, features: list[str], label: str) -> Model:
    ols = LinearRegression(labelCol=label, solver="normal", regParam=0.0)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), ols]).fit(train)


def predict_value(model: Model, rows: DataFrame, out: str = "pred") -> DataFrame:
    return model.transform(rows).withColumnRenamed("prediction", out).drop("features")


def in_parallel(tasks: list[Callable], parallelism: int = 8) -> list:
    """Run independent fits side by side; each is its own set of Spark jobs."""
    if not tasks:
        return []
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda t: t(), tasks)


def hashed_words(text: str = "text", features: int = 1 << 16) -> PipelineModel:
    """Adds `words` and `tf`, their hashed counts. Nothing is fitted."""
    words = RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}]+")
    return PipelineModel([words, HashingTF(inputCol="words", outputCol="tf", numFeatures=features)])


#: Far above what the text fits need: they end by their tolerance.
TEXT_ITERATIONS = 10_000


def fit_hashed(hashed: DataFrame, label: str = "label") -> PipelineModel:
    """IDF and three-class logistic regression over rows with `tf`, to convergence."""
    lr = LogisticRegression(labelCol=label, maxIter=TEXT_ITERATIONS, regParam=0.01, family="multinomial")
    return Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), lr]).fit(hashed)


def text_classifier(labelled: DataFrame, text: str = "text", label: str = "label",
                    features: int = 1 << 16) -> Model:
    """Three-class text model: words, hashed counts, IDF, logistic regression.
    Texts are split once; the fits read their counts."""
    words = hashed_words(text, features)
    hashed = cut_lineage(words.transform(labelled).select(label, "tf"), "hashed-words")
    return PipelineModel([*words.stages, *fit_hashed(hashed, label).stages])


def text_probabilities(model: Model, texts: DataFrame, classes: list[str]) -> DataFrame:
    """Adds one probability column per class, in the order of their labels."""
    p = vector_to_array("probability")
    out = model.transform(texts).withColumns({c: p[i] for i, c in enumerate(classes)})
    return out.drop("words", "tf", "features", "rawPrediction", "probability", "prediction")


TEMPERATURES = [round(0.25 * 1.25 ** i, 4) for i in range(18)]


def tempered(probabilities: list[str], temperature: Column) -> list[Column]:
    """The probabilities at another temperature: powers 1 / t, summed to 1."""
    # a probability of 0 stays finite in the log loss
    powers = [F.pow(F.greatest(F.col(p), F.lit(1e-12)), 1 / temperature) for p in probabilities]
    whole = reduce(lambda a, b: a + b, powers)
    return [x / whole for x in powers]


def class_log_loss(probabilities: list[Column], label: Column) -> Column:
    """-ln of the probability given to the row's own class, 0, 1, ...; NULL
    without a class."""
    own = reduce(lambda rest, i: F.when(label == i, probabilities[i]).otherwise(rest), range(len(probabilities)), F.lit(None).cast("double"))
    return F.when(own.isNotNull(), -F.ln(F.greatest(own, F.lit(1e-12))))


#: Where the search for a fold's own temperature begins: powers of 1.6 on both sides of 1.
WIDE = [64 ** (i / 9) for i in range(-9, 10)]


def least_loss(scored: DataFrame, classes: list[str], tried: list[list[float]], zooms: int = 0) -> list[float]:
    """For each fold 0, 1, ... the one of its temperatures in `tried` with the
    least mean log loss over its rows, of equals the nearest to 1; 1 without
    labels. Each zoom tries as many again between both neighbours of the best:
    the loss is convex in 1 / temperature."""
    of_folds = [F.get(F.array(*[F.lit(float(t)) for t in same]), F.col("fold")) for same in zip(*tried)]
    means = [F.avg(class_log_loss(tempered(classes, t), F.col("label"))).alias(f"loss{i}") for i, t in enumerate(of_folds)]
    best, closer = [1.0] * len(tried), list(tried)
    for fold, *loss in scored.filter("label IS NOT NULL").groupBy("fold").agg(*means).collect():
        if loss[0] is None:
            continue
        _, _, best[fold], i = min((v, abs(t - 1), t, i) for i, (v, t) in enumerate(zip(loss, tried[fold])))
        low, high = tried[fold][max(i - 1, 0)], tried[fold][min(i + 1, len(loss) - 1)]
        closer[fold] = sorted([best[fold], *[low * (high / low) ** (j / (len(loss) - 2)) for j in range(len(loss) - 1)]])
    return least_loss(scored, classes, closer, zooms - 1) if zooms else best


def cross_fitted_texts(docs: DataFrame, classes: list[str], key: str = "doc_id", text: str = "text", label: str = "label",
                       folds: int = 3, features: int = 1 << 16, nested: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Class probabilities of every text from a model that has not seen it.

    A text's fold is a hash of its word counts, all that a model reads of it,
    so texts that are equal to a model are never on both sides of a fit; rows without a label are scored like the others and never
    fitted on. Each fold's model is fitted on the labelled rows of the other
    folds. Its probabilities are sharpened or softened by a temperature:

    * by default one for all, that of `TEMPERATURES` with the least mean log
      loss over the held-out labelled rows. Every label has a part in it.
    * `nested`: each fold's own, with the least loss over the rows of the other
      folds, scored by models that have seen neither them nor the fold. So no
      label of a fold has any part in its scores. Each two folds left out
      take one more fit; two folds are halved for it.

    Returns `key`, `label`, `fold`, `temperature`, one column per class, the
    columns named in `keep`, and `share_loss`: the log loss of a row by the
    class shares alone, counted over the rows its model was fitted on. NULL
    texts count as empty. A fold whose other folds hold fewer than two classes,
    or no rows, has no model: its probabilities are equal.
    """
    parts = folds * 2 if nested and folds == 2 else folds
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("double").alias("label"), *keep)
    rows = hashed_words("text", features).transform(rows).withColumn("part", F.pmod(F.xxhash64("tf"), F.lit(parts)).cast("int"))
    # texts are split once, for all folds
    rows = cut_lineage(rows.select(key, "label", "part", F.pmod("part", F.lit(folds)).alias("fold"), "tf", *keep), "hashed-words")
    counted = {(r.part, r.label): r.n for r in rows.filter("label IS NOT NULL").groupBy("part", "label").agg(F.count("*").alias("n")).collect()}

    def fitted_on(left_out: frozenset[int]) -> dict[float, int]:
        """Labelled rows outside some parts, by class."""
        return {c: sum(n for (part, label), n in counted.items() if label == c and part not in left_out)
                for c in {label for part, label in counted if part not in left_out}}

    def scored(left_out: frozenset[int], judged: dict[int, int] | None = None) -> DataFrame:
        """Rows of the parts left out of a fit; those of `judged` for the folds
        whose temperature they help to find."""
        own, out = rows.filter(F.col("part").isin(*left_out)), [key, "fold", "label", *keep]
        if judged is not None:
            fold = reduce(lambda rest, part: F.when(F.col("part") == part, judged[part]).otherwise(rest), judged, F.lit(None).cast("int"))
            own, out = own.withColumn("fold", fold).filter("fold IS NOT NULL AND label IS NOT NULL"), ["fold", "label"]
        known = fitted_on(left_out)
        if len(known) < 2:
            return own.select(*out, *[F.lit(1.0 / len(classes)).alias(c) for c in classes])
        train = rows.filter(~F.col("part").isin(*left_out) & F.col("label").isNotNull())
        model = fit_hashed(in_tasks(train.select("label", "tf"), sum(known.values())))
        p = vector_to_array("probability")
        # a class that no fitted row holds has no place in the vector or probability 0
        return model.transform(own).select(*out, *[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(classes)])

    owned = {k: frozenset(range(k, parts, folds)) for k in range(folds)}
    inner: dict[frozenset[int], dict[int, int]] = {}
    for k, own in owned.items() if nested else ():
        for part in set(range(parts)) - own:
            # two folds left out together are fitted once, and judge each other's temperature
            inner.setdefault(own | {part}, {})[part] = k
    fits = in_parallel([*[partial(scored, own) for own in owned.values()], *[partial(scored, *pair) for pair in inner.items()]], folds)
    held_out = cut_lineage(reduce(DataFrame.unionByName, fits[:folds]), "held-out")
    if nested:
        judges = reduce(DataFrame.unionByName, fits[folds:] or [held_out.limit(0)])
        best = least_loss(cut_lineage(judges.select("fold", "label", *classes), "judges"), classes, [WIDE] * folds, zooms=3)
    else:
        best = least_loss(held_out.withColumn("fold", F.lit(0)), classes, [TEMPERATURES]) * folds

    def of_fold(values: list[float]) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("fold"))

    known = [fitted_on(own) for own in owned.values()]
    shares = [of_fold([n.get(i, 0) / sum(n.values()) if n else 1.0 / len(classes) for n in known]) for i in range(len(classes))]
    sharp = dict(zip(classes, tempered(classes, F.col("temperature"))))
    held_out = held_out.withColumn("temperature", of_fold(best))
    return held_out.select(key, "label", "fold", "temperature", *[v.alias(c) for c, v in sharp.items()], *keep,
                           class_log_loss(shares, F.col("label")).alias("share_loss"))


def margin(scored: DataFrame) -> Column:
    """Log odds of 'up' from either kind of classifier."""
    p = vector_to_array("probability")[1]
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(p / (1 - p))


def linear_attribution(model: Model, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Exact contributions of a linear model: coefficient times the scaled value."""
    coefficients = model.stages[-1].coefficients.toArray().tolist()
    scaled = vector_to_array("features")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"),
                               (scaled[i] * F.lit(c)).alias("contribution"))
                      for i, (f, c) in enumerate(zip(features, coefficients))])
    return model.transform(rows).select(*keys, F.inline(cells))


def tree_attribution(model: Boosted, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Exact Shapley contributions to the margin, per row and feature."""
    split = rows.select(*keys, *features, boosting.attribution(model.ensemble, feature_array(features)).alias("_split"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col("_split")[i].alias("contribution"))
                      for i, f in enumerate(features)])
    return split.select(*keys, F.inline(cells))


def sampled_attribution(model: Model, rows: DataFrame, background: DataFrame, features: list[str],
                        keys: list[str], permutations: int = 16, seed: int = 42,
                        output: Callable[[DataFrame], Column] = margin) -> DataFrame:
    """Shapley contributions by sampled feature orders, per row and feature.

    Each row is scored along every order, switching its features one by one
    from the background mean to its own value: permutations * (features + 1)
    rows, a constant factor, scored by a distributed `transform`. Contributions
    add up to the row's output minus the background's for every order.
    """
    rng = random.Random(seed)
    orders = []
    for _ in range(permutations):
        order = list(range(1, len(features) + 1))
        rng.shuffle(order)
        orders.append(order)
    table = F.array(*[F.array(*[F.lit(i) for i in order]) for order in orders])
    base = background.agg(*[F.avg(f).alias(f"_mean_{f}") for f in features])
    steps = F.sequence(F.lit(0), F.lit(len(features)))
    wide_rows = beside(rows.select(*keys, *features), base)
    grid = (wide_rows.withColumnsRenamed({f: f"x_{f}" for f in features}).withColumn("order", F.explode(table)).withColumn("step", F.explode(steps)))
    place = {f: F.array_position("order", i) for i, f in enumerate(features, 1)}
    grid = grid.withColumns({f: F.when(place[f] <= F.col("step"), F.col(f"x_{f}")).otherwise(F.col(f"_mean_{f}"))
                             for f in features})
    scored = model.transform(grid)
    scored = scored.withColumn("_out", output(scored))
    sums = {f: (F.sum(F.when(F.col("step") == place[f], F.col("_out")))
                - F.sum(F.when(F.col("step") == place[f] - 1, F.col("_out")))) / permutations for f in features}
    wide = scored.groupBy(*keys).agg(*[s.alias(f) for f, s in sums.items()],
                                     *[F.max(f"x_{f}").alias(f"x_{f}") for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x_{f}").alias("value"),
                               F.col(f).alias("contribution")) for f in features])
    return wide.select(*keys, F.inline(cells))


def sentiment_share(attribution: DataFrame, keys: list[str], sentiment: list[str]) -> DataFrame:
    """Share of the absolute contributions that comes from sentiment features; 0
    when there is nothing to share."""
    a = F.abs("contribution")
    mine = F.coalesce(F.sum(F.when(F.col("feature").isin(sentiment), a)), F.lit(0.0))
    return attribution.groupBy(*keys).agg(
        F.coalesce(F.try_divide(mine, F.sum(a)), F.lit(0.0)).alias("sentiment_share"))


def share_of_list(explanation: str | Column, sentiment: list[str]) -> Column:
    """The same share for an explanation kept as array<struct<feature, shap>>."""
    total = F.aggregate(explanation, F.lit(0.0), lambda s, e: s + F.abs(e["shap"]))
    mine = F.aggregate(F.filter(explanation, lambda e: e["feature"].isin(sentiment)), F.lit(0.0),
                       lambda s, e: s + F.abs(e["shap"]))
    return F.coalesce(F.try_divide(mine, total), F.lit(0.0))


