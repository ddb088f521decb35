"""Model quality per window and slice (M7-M21) over labelled rows of an inference log."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmill.functions.ordering import Sizes, choose_grids, running_totals
from watchmill.operators.frequencies import SIGN
from watchmill.operators.grouping import fan_out, group_columns, with_base_keys, within
from watchmill.operators.moments import merge_moments, needs_two_rounds
from watchmill.schemas import PERFORMANCE_FIELDS
from watchmill.settings import REGRESSION, Monitor
from watchmill.sources.scratch import materialize

#: Probabilities are kept this far from 0 and 1 in the log loss.
CLIP = 1e-15
_POSITIVE, _NEGATIVE = ("1", "true"), ("0", "false")


def _type(df: DataFrame, column: str) -> T.DataType:
    by_name = {f.name.lower(): f.dataType for f in df.schema}
    return by_name[column.lower()]


def has_scores(df: DataFrame, monitor: Monitor) -> bool:
    """Predictions are probabilities if all labels are 0 or 1 and any prediction lies strictly between them.

    The types decide first; only a fractional prediction next to a numeric or boolean label needs a look at the rows.
    """
    prediction, label = _type(df, monitor.prediction_column), _type(df, monitor.label_column)
    fractional = isinstance(prediction, (T.FractionalType, T.DecimalType))
    if not (fractional and isinstance(label, (T.NumericType, T.BooleanType))):
        return False
    score = F.col(f"`{monitor.prediction_column}`").cast("double")
    truth = F.col(f"`{monitor.label_column}`").cast("double")
    seen = df.agg(F.bool_and(truth.isin(0.0, 1.0)).alias("binary"), F.bool_or((score > 0) & (score < 1)).alias("between"))
    row = seen.first()
    return bool(row.binary and row.between)


def labelled(df: DataFrame, monitor: Monitor) -> DataFrame:
    """Rows that carry both a prediction and a label."""
    return df.filter(
        F.col(f"`{monitor.prediction_column}`").isNotNull() & F.col(f"`{monitor.label_column}`").isNotNull()
    )


def performance(df: DataFrame, monitor: Monitor) -> DataFrame | None:
    """One row of scores per window and slice; None unless prediction and label are both set."""
    if monitor.profile_type != "INFERENCE" or not (monitor.prediction_column and monitor.label_column):
        return None
    rows = labelled(df, monitor)
    return performance_of(performance_partials(rows, monitor, scored(rows, monitor)), monitor)


def scored(rows: DataFrame, monitor: Monitor) -> bool:
    """Whether the predictions of labelled rows are probabilities of a class."""
    return monitor.problem_type != REGRESSION and has_scores(rows, monitor)


def performance_partials(rows: DataFrame, monitor: Monitor, scored: bool) -> dict[str, DataFrame]:
    """Counts and sums of labelled rows by base window and slices, from which all scores follow. Those of several sets of rows
    may be put together; rows with a SIGN of -1 take away what they once gave.
    """
    if monitor.problem_type == REGRESSION:
        return {"errors": _error_sums(rows, monitor)}
    made = {"confusion": lambda: confusion_counts(rows, monitor, scored), "ranking": lambda: score_counts(rows, monitor)}
    made["classes"] = lambda: class_score_counts(rows, monitor, scored)
    return {name: made[name]() for name in partial_names(monitor, scored)}


def partial_names(monitor: Monitor, scored: bool) -> list[str]:
    """The kinds of partials of a monitor. Scores of every class, where there are some, give the area under the curve."""
    if monitor.problem_type == REGRESSION:
        return ["errors"]
    return ["confusion", *(["classes"] if monitor.class_scores else ["ranking"] if scored else [])]


def performance_of(partials: dict[str, DataFrame], monitor: Monitor, only: DataFrame | None = None) -> DataFrame:
    """Scores per window and slice from partials; with ``only``, of the groups that ``within`` keeps."""
    scores = _regression(partials["errors"], monitor, only) if "errors" in partials else _classification(partials, monitor, only)
    present = set(scores.columns)
    columns = [
        F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in PERFORMANCE_FIELDS
    ]
    return scores.select(*group_columns(monitor), *columns)


# --- regression -------------------------------------------------------------------------------------------------


def _sign(rows: DataFrame) -> Column:
    return F.col(SIGN).cast("bigint") if SIGN in rows.columns else F.lit(1).cast("bigint")


def _error_sums(rows: DataFrame, monitor: Monitor) -> DataFrame:
    """Rows (base keys, values, mean, m2 and sums). Rows that went have parts of their own, with everything but the mean below
    zero.
    """
    rows, keys = with_base_keys(rows.withColumn("__of", _sign(rows)), monitor)
    label = F.col(f"`{monitor.label_column}`").cast("double")
    error = F.col(f"`{monitor.prediction_column}`").cast("double") - label
    sums = {
        "values": F.count("*"),
        "m2": F.var_pop(label) * F.count("*"),
        "squares": F.sum(error * error),
        "absolutes": F.sum(F.abs(error)),
        "relatives": F.sum(F.try_divide(F.abs(error), F.abs(label))),
        "nonzero": F.count(F.when(label != 0, 1)),
    }
    partial = rows.groupBy(*keys, "__of").agg(F.avg(label).alias("mean"), *[value.alias(name) for name, value in sums.items()])
    return partial.withColumns({name: F.col(name) * F.col("__of") for name in sums}).drop("__of")


def _regression(partial: DataFrame, monitor: Monitor, only: DataFrame | None) -> DataFrame:
    """M17-M21 from sums that merge."""
    sums = {name: F.sum for name in ("squares", "absolutes", "relatives", "nonzero")}
    spread = within(fan_out(partial, monitor), only)
    merged = merge_moments(spread, ["g"], sums, two_rounds=needs_two_rounds(monitor)).filter("values > 0")
    n, mean_square = F.col("values"), F.col("squares") / F.col("values")
    return merged.select(
        "g",
        mean_square.alias("mean_squared_error"),
        F.sqrt(mean_square).alias("root_mean_squared_error"),
        (F.col("absolutes") / n).alias("mean_average_error"),
        F.try_divide(F.col("relatives"), F.col("nonzero")).alias("mean_absolute_percentage_error"),
        F.when(F.col("m2") > 0, 1 - F.col("squares") / F.col("m2")).alias("r2_score"),
    )


# --- classification ---------------------------------------------------------------------------------------------


def _classes(df: DataFrame, monitor: Monitor, scored: bool) -> tuple[Column, Column]:
    """True and predicted class as text."""
    label, prediction = F.col(f"`{monitor.label_column}`"), F.col(f"`{monitor.prediction_column}`")
    if not scored:
        kinds = [_type(df, name) for name in (monitor.label_column, monitor.prediction_column)]
        any_text = any(isinstance(kind, T.StringType) for kind in kinds)
        return _class_text(label, kinds[0], any_text), _class_text(prediction, kinds[1], any_text)
    return (
        label.cast("int").cast("string"),
        F.when(prediction.cast("double") >= 0.5, "1").otherwise("0"),
    )


def _class_text(value: Column, kind: T.DataType, beside_text: bool) -> Column:
    """A class as text that does not depend on its type: 1, 1.0 and true are one class, beside a text true is 'true'."""
    if isinstance(kind, T.BooleanType):
        return value.cast("string") if beside_text else value.cast("int").cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def confusion_counts(df: DataFrame, monitor: Monitor, scored: bool) -> DataFrame:
    """Rows (base keys, label, guess, n, loss, losses): how often each class was taken for which, and the log loss sums."""
    label, guess = _classes(df, monitor, scored)
    loss = F.lit(None).cast("double")
    if scored:
        score = F.col(f"`{monitor.prediction_column}`").cast("double")
        hit = F.when(label == "1", score).otherwise(1 - score)
        clipped = F.least(F.greatest(hit, F.lit(CLIP)), F.lit(1 - CLIP))
        loss = F.when(score.between(0, 1) & label.isin("0", "1"), -F.ln(clipped))
    rows = df.withColumns({"__label": label, "__guess": guess, "__loss": loss, "__of": _sign(df)})
    rows, keys = with_base_keys(rows, monitor)
    return rows.groupBy(*keys, F.col("__label").alias("label"), F.col("__guess").alias("guess")).agg(
        F.sum("__of").alias("n"),
        F.sum(F.col("__loss") * F.col("__of")).alias("loss"),
        F.sum(F.when(F.col("__loss").isNotNull(), F.col("__of")).otherwise(0)).alias("losses"),
    )


def confusion(partial: DataFrame, monitor: Monitor, only: DataFrame | None) -> DataFrame:
    """Rows (g, label, guess, n, loss, losses) of windows and slices."""
    grouped = within(fan_out(partial, monitor), only).groupBy("g", "label", "guess")
    return grouped.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("losses").alias("losses")).filter("n > 0")


def _per_class(table: DataFrame) -> DataFrame:
    """Accuracy, log loss and support-weighted precision, recall and F1."""
    zero = F.lit(0).cast("bigint")
    hits = F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(zero)
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("guessed"), hits.alias("hits")),
        F.struct(F.col("guess").alias("class"), zero.alias("support"), F.col("n").alias("guessed"), zero.alias("hits")),
    )
    classes = table.select("g", F.inline(roles)).groupBy("g", "class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("guessed")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def weighted(score: Column) -> Column:
        return F.struct((F.sum(score * F.col("support")) / F.sum("support")).alias("weighted"))

    return classes.groupBy("g").agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy_score"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1_score"),
    )


def _fairness(table: DataFrame) -> DataFrame:
    """A slice against the rest of its window; NULL on the overall row and for more than two classes."""
    label, guess = F.lower("label"), F.lower("guess")
    real, said = label.isin(*_POSITIVE), guess.isin(*_POSITIVE)
    known = _POSITIVE + _NEGATIVE

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    groups = table.groupBy("g").agg(
        F.struct(
            count(real & said).alias("tp"),
            count(~real & said).alias("fp"),
            count(real & ~said).alias("fn"),
            count(~real & ~said).alias("tn"),
        ).alias("own"),
        F.sum("loss").alias("loss"),
        F.sum("losses").alias("losses"),
        F.bool_and(label.isin(*known) & guess.isin(*known)).alias("binary"),
    )
    in_window = Window.partitionBy("g.granularity", "g.window_start")
    whole = F.max(F.when(F.col("g.slice").isNull(), F.struct("binary", "own"))).over(in_window)
    groups = groups.withColumn("whole", whole)

    def rest(name: str) -> Column:
        return F.col(f"whole.own.{name}") - F.col(f"own.{name}")

    def own(name: str) -> Column:
        return F.col(f"own.{name}")

    def differs(rate) -> Column:
        sliced = F.col("g.slice").isNotNull() & F.col("whole.binary")
        return F.when(sliced, rate(own) - rate(rest))

    def share(part: Column, *others: Column) -> Column:
        whole_ = part
        for other in others:
            whole_ = whole_ + other
        return F.try_divide(part.cast("double"), whole_)

    return groups.select(
        "g",
        F.try_divide(F.col("loss"), F.col("losses")).alias("log_loss"),
        differs(lambda n: share(n("tp"), n("fp"))).alias("predictive_parity"),
        differs(lambda n: share(n("fp"), n("tn"))).alias("predictive_equality"),
        differs(lambda n: share(n("tp"), n("fn"))).alias("equal_opportunity"),
        differs(
            lambda n: F.try_divide((n("tp") + n("fp")).cast("double"), n("tp") + n("fp") + n("fn") + n("tn"))
        ).alias("statistical_parity"),
    )


def score_counts(df: DataFrame, monitor: Monitor) -> DataFrame:
    """Rows (base keys, score, pos, neg): how often each score stands on rows of either label."""
    score = F.col(f"`{monitor.prediction_column}`").cast("double") + F.lit(0.0)
    positive = F.col(f"`{monitor.label_column}`").cast("int") == 1
    rows, keys = with_base_keys(df.withColumns({"__score": score, "__positive": positive, "__of": _sign(df)}), monitor)
    pos, neg = (F.sum(F.when(side, F.col("__of")).otherwise(0)) for side in (F.col("__positive"), ~F.col("__positive")))
    return rows.groupBy(*keys, F.col("__score").alias("score")).agg(pos.alias("pos"), neg.alias("neg"))


def ranking(partial: DataFrame, monitor: Monitor, only: DataFrame | None) -> DataFrame:
    """Area under the ROC curve for probabilities, by mid-ranks of the distinct scores."""
    grouped = within(fan_out(partial, monitor), only).groupBy("g", "score")
    counts = grouped.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos <> 0 OR neg <> 0")
    counts = materialize(counts, "scores")
    sizes = Sizes.of(counts.groupBy("g").agg(F.count("*").alias("values")))
    ranked = running_totals(counts, ["g"], "score", ["neg"], choose_grids(counts, ["g"], "score", sizes.largest))
    beaten = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    area = F.try_divide(F.sum(beaten), F.sum("pos").cast("double") * F.sum("neg"))
    return ranked.groupBy("g").agg(F.struct(F.struct(area.alias("weighted")).alias("one_vs_one")).alias("roc_auc_score"))


def class_score_counts(df: DataFrame, monitor: Monitor, scored: bool) -> DataFrame:
    """Rows (base keys, k, score, n0, n1, ...): how often the k-th class got a score on rows of each class.

    Rows of a class that has no score column, and rows that lack a score, are left out. A row gives one pair for each class, and
    these collapse by score before they are shuffled.
    """
    label, _ = _classes(df, monitor, scored)
    numbers = [F.col(f"`{column}`").cast("double") + F.lit(0.0) for _, column in monitor.class_scores]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), number.alias("score")) for k, number in enumerate(numbers)])
    place = F.coalesce(*[F.when(label == name, F.lit(k)) for k, (name, _) in enumerate(monitor.class_scores)])
    whole = reduce(and_, [number.isNotNull() & ~F.isnan(number) for number in numbers])
    rows, keys = with_base_keys(df.withColumns({"__class": F.when(whole, place), "__pairs": pairs, "__of": _sign(df)}), monitor)
    long = rows.filter("__class IS NOT NULL").select(*keys, "__class", "__of", F.inline("__pairs"))
    seen = [F.sum(F.when(F.col("__class") == j, F.col("__of")).otherwise(0)).alias(f"n{j}") for j in range(len(numbers))]
    return long.groupBy(*keys, "k", "score").agg(*seen)


def class_areas(partial: DataFrame, monitor: Monitor, only: DataFrame | None) -> DataFrame:
    """M12 for several classes: the area of each class against each other one, by mid-ranks of the former's score on rows of the
    two, as a mean weighted by their rows. Running totals of all classes come from one pass over the distinct scores; pairs of
    which a class has no row have no area.
    """
    names = [f"n{j}" for j in range(len(monitor.class_scores))]
    grouped = within(fan_out(partial, monitor), only).groupBy("g", "k", "score").agg(*[F.sum(n).alias(n) for n in names])
    counts = materialize(grouped.filter(" OR ".join(f"{n} <> 0" for n in names)), "class-scores")
    sizes = Sizes.of(counts.groupBy("g", "k").agg(F.count("*").alias("values")))
    ranked = running_totals(counts, ["g", "k"], "score", names, choose_grids(counts, ["g", "k"], "score", sizes.largest))
    own = F.get(F.array(*names), F.col("k"))
    sums = {f"w{j}": F.sum(own * (F.col(f"{n}_upto") - F.col(n) / 2)) for j, n in enumerate(names)}
    totals = ranked.groupBy("g", "k").agg(*[F.sum(n).cast("double").alias(n) for n in names], *[v.alias(w) for w, v in sums.items()])
    against = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"w{j}").alias("beaten"), F.col(n).alias("other")) for j, n in enumerate(names)])
    pairs = totals.select("g", "k", F.get(F.array(*names), F.col("k")).alias("mine"), F.inline(against)).filter("k <> j AND mine > 0 AND other > 0")
    rows = F.col("mine") + F.col("other")
    area = F.sum(F.col("beaten") / (F.col("mine") * F.col("other")) * rows) / F.sum(rows)
    return pairs.groupBy("g").agg(F.struct(F.struct(area.alias("weighted")).alias("one_vs_one")).alias("roc_auc_score"))


def _classification(partials: dict[str, DataFrame], monitor: Monitor, only: DataFrame | None) -> DataFrame:
    table = materialize(confusion(partials["confusion"], monitor, only), "confusion")
    scores = _per_class(table).join(_fairness(table), "g")
    if "classes" in partials:
        scores = scores.join(class_areas(partials["classes"], monitor, only), "g", "left")
    if "ranking" in partials:
        scores = scores.join(ranking(partials["ranking"], monitor, only), "g", "left")
    return scores
