"""Fitted models: boosted trees behind the objectives of a recipe."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.expressions import known
from tallyforge.operators import boosting
from tallyforge.spec import LOWER, UPPER

OBJECTIVES = ("squared", "absolute", "tweedie", "poisson", "aft", "logistic", "softprob")
LABELS = ("logistic", "softprob")
MIN_ROWS, NEWEST = 20, 0.85


class FitError(ValueError):
    """Too few usable rows, or a target that the objective does not take."""


@dataclass
class Fitted:
    objective: str
    model: object
    features: list[str]
    classes: list[str] = field(default_factory=list)
    backend: str = "tabular"


def usable(rows: DataFrame, objective: str, y: str = "y") -> DataFrame:
    """Rows that an objective can learn from: known targets, for waiting times also open rows with a bound above 0."""
    if objective == "aft":
        return rows.where(known(F.col(LOWER)) & (F.col(LOWER) > 0)).withColumns({"__t": F.col(LOWER), "__seen": F.coalesce(F.col(UPPER) == F.col(LOWER), F.lit(False))})
    if objective in LABELS:
        return rows.where(F.col(y).isNotNull())
    return rows.where(known(F.col(y)))


def fit_model(
    rows: DataFrame, objective: str, features: list[str], y: str = "y", order: str | None = None, depth: int = 4, rounds: int = 100, rate: float = 0.1, patience: int = 10, columns: list[Column] | None = None
) -> Fitted:
    """One boosted model. With ``order`` it keeps the number of rounds at which a probe, which does not learn from the newest
    15 %, did best on them. ``columns`` are what ``features`` are worked out from, where those are no columns of ``rows``."""
    return fit_models(rows, [objective], features, y, order, depth, rounds, rate, patience, columns)[0]


def fit_models(
    rows: DataFrame, objectives: list[str], features: list[str], y: str = "y", order: str | None = None, depth: int = 4, rounds: int = 100, rate: float = 0.1, patience: int = 10, columns: list[Column] | None = None
) -> list[Fitted]:
    """A model for each objective, as ``fit_model`` gives it. Objectives that learn from the same rows and targets share the
    passes over the rows."""
    alike: dict[str, list[str]] = {}
    for objective in dict.fromkeys(objectives):
        if objective not in OBJECTIVES:
            raise FitError(f"no objective {objective!r}")
        alike.setdefault("waits" if objective == "aft" else "classes" if objective in LABELS else "values", []).append(objective)
    made: dict[str, Fitted] = {}
    for some in alike.values():
        made.update(zip(some, _fit_alike(rows, some, features, y, order, (depth, rounds, rate, patience), columns)))
    return [made[objective] for objective in objectives]


def _fit_alike(rows: DataFrame, objectives: list[str], features: list[str], y: str, order: str | None, settings: tuple, columns: list[Column] | None) -> list[Fitted]:
    """Models of objectives that learn from the same rows and targets."""
    good = usable(rows, objectives[0], y)
    labels, waits = objectives[0] in LABELS, objectives[0] == "aft"
    facts = [F.count("*").alias("n"), F.min(F.col(y).try_cast("double")).alias("low")]
    facts += [F.array_sort(F.collect_set(F.col(y).cast("string"))).alias("classes")] if labels else []
    facts += [F.percentile(F.unix_date(order), NEWEST).alias("cut")] if order else []
    known_y = F.col("__t") if waits else F.col(y)
    facts += boosting.heads(objectives, columns or features, known_y) if not labels else []  # a class's code is not known yet
    found = good.agg(*facts).first()
    if found["n"] < MIN_ROWS:
        raise FitError(f"{found['n']} usable rows, {MIN_ROWS} needed")
    for objective in objectives:
        if objective in ("tweedie", "poisson") and (found["low"] or 0) < 0:
            raise FitError(f"{objective} takes no negative targets")
    classes = list(found["classes"]) if labels else []
    if labels:
        objectives = ["logistic" if len(classes) == 2 else "softprob"] * len(objectives)
    target = F.array_position(F.lit(classes), F.col(y).cast("string")) - 1 if labels else known_y
    wanted = [boosting.Settings(objective, *settings) for objective in objectives]
    newest = F.unix_date(order) > found["cut"] if order else None
    many = max(1, len(classes)) if objectives[0] == "softprob" else 1
    fitted = boosting.fit(good, columns or features, wanted, target, F.col("__seen") if waits else None, newest, many, None if labels else found)
    return [Fitted(objective, model, features, classes) for objective, model in zip(objectives, fitted)]


def predict(fitted: Fitted, rows: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """``rows`` with ``prediction``, or with ``class`` and ``probability`` and all ``probabilities`` by class order."""
    if fitted.objective not in LABELS:
        return rows.withColumn("prediction", boosting.prediction(fitted.model, columns or fitted.features))
    says = boosting.predictions(fitted.model, columns or fitted.features)
    names, most = F.lit(fitted.classes), F.array_max("probabilities")
    return rows.withColumn("probabilities", says).withColumns({"class": F.element_at(names, F.array_position("probabilities", most).cast("int")), "probability": most})


def predict_each(fitted: list[Fitted], rows: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """``rows`` once for each model, with its ``objective`` and ``prediction``. The models say one value each from the same
    features, and are all asked in one pass."""
    if not fitted or any(f.objective in LABELS or f.features != fitted[0].features for f in fitted):
        raise ValueError("models of one value each on the same features are needed")
    said = rows.withColumn("__said", boosting.each_prediction([f.model for f in fitted], columns or fitted[0].features))
    each = [F.struct(F.lit(f.objective).alias("objective"), F.col(f"__said.p{i}").alias("prediction")) for i, f in enumerate(fitted)]
    kept = [F.col(f"`{name}`") for name in rows.columns if name not in ("objective", "prediction")]
    return said.select(*kept, F.inline(F.array(*each)))


def predicted_date(anchor, prediction, unit_days: float):
    """The day a case is expected to resolve, rounded half to even."""
    return F.date_add(anchor, F.bround(prediction * unit_days).cast("int"))


#: What is kept beside a saved model; one without a backend is of the first kind.
META = "objective string, features array<string>, classes array<string>, backend string"


def save(fitted: Fitted, path: str) -> None:
    fitted.model.save(f"{path}/model")
    session = SparkSession.getActiveSession()
    session.createDataFrame([(fitted.objective, fitted.features, fitted.classes, fitted.backend)], META).write.mode("overwrite").json(f"{path}/meta")


def load(path: str) -> Fitted:
    meta = SparkSession.getActiveSession().read.schema(META).json(f"{path}/meta").first()
    return Fitted(meta["objective"], boosting.Boosted.load(f"{path}/model"), list(meta["features"]), list(meta["classes"] or []), meta["backend"] or "tabular")


#: Estimators by name; each takes rows, an objective and the names of the features and gives a ``Fitted``.
BACKENDS: dict[str, Callable[..., Fitted]] = {"tabular": fit_model}


def add_backend(name: str, fit: Callable[..., Fitted]) -> None:
    """Makes an estimator of the caller's known, or replaces one."""
    BACKENDS[name] = fit


def backend(name: str) -> Callable[..., Fitted]:
    if name not in BACKENDS:
        raise FitError(f"no estimator {name!r} among {sorted(BACKENDS)}")
    return BACKENDS[name]


def _of_map(features: str, names: list[str]) -> list[Column]:
    return [F.coalesce(F.element_at(features, F.lit(n)), F.lit(0.0)) for n in names]


def fit_maps(rows: DataFrame, label: str = "label", features: str = "features", estimator: str = "tabular", **settings) -> Fitted:
    """A classifier over maps of features, whatever their names; a feature that a row lacks counts as 0."""
    fit = backend(estimator)
    names = [r["k"] for r in rows.select(F.explode(F.map_keys(features)).alias("k")).distinct().orderBy("k").collect()]
    return replace(fit(rows, "softprob", names, y=label, columns=_of_map(features, names), **settings), backend=estimator)


def predict_maps(fitted: Fitted, rows: DataFrame, features: str = "features") -> DataFrame:
    return predict(fitted, rows, _of_map(features, fitted.features))
