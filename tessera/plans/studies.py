"""A supervised study: what is predicted, from which rows or bags, by which model, and how it is held out.

A Study is checked as a whole before anything runs; run() makes the table (single rows or bags of a
subject's rows, with shares of clusters if wanted), predicts each subject from models that saw none
of its rows, and scores the predictions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from typing import Any, NamedTuple, get_type_hints

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators import attention, bag_studies, learners, models

TASKS = ("classification", "regression")
STRATEGIES = ("rows", "bags", "attention")
EVALUATIONS = ("folds", "groups")


@dataclass(frozen=True)
class Study:
    """One supervised study; the fields' order is that in which they act."""

    label: str
    subject: str
    task: str = "classification"
    #: rows: each row is a case; bags: statistics of `bag_size` rows; attention: a subject is one bag, whose rows are weighed
    strategy: str = "rows"
    bags: int = 10
    bag_size: int = 30
    statistics: tuple[str, ...] = ("mean", "std", "median", "skew")
    #: shares of that many clusters of all rows become bag features; they are fitted without labels, but on all rows, held-out ones too
    bag_clusters: int | None = None
    #: share of rows that two bags of a subject may be expected to have in common before it is flagged
    overlap: float = 0.2
    #: selection of features on each fold's training rows
    methods: tuple[str, ...] = ()
    top: int = 20
    threshold: float = 0.95
    model: str = "RandomForest"
    #: folds: groups dealt into `folds`; groups: each held out once
    evaluation: str = "folds"
    #: column whose values stay together; None: the subject
    group: str | None = None
    folds: int = 5
    standardize: bool = False
    seed: int = 42

    def faults(self) -> list[str]:
        """What is wrong with it, in order of the fields; nothing if it can run."""
        out, hints = [], get_type_hints(type(self))
        for f in fields(self):
            kind, value = hints[f.name], getattr(self, f.name)
            allowed = {tuple[str, ...]: (tuple, list), str | None: (str, type(None)), int | None: (int, type(None)), float: (int, float)}.get(kind, kind)
            items = value if isinstance(value, (tuple, list)) else ()
            if not isinstance(value, allowed) or (isinstance(value, bool) and kind is not bool) or not all(isinstance(i, str) for i in items):
                out.append(f"{f.name}: {value!r} has the wrong type")
        if out:
            return out  # values of the wrong type can't be compared

        def one_of(name: str, known: Sequence[str]) -> None:
            if getattr(self, name) not in known:
                out.append(f"{name}: {getattr(self, name)!r} is none of {', '.join(known)}")

        def subset_of(name: str, known: Sequence[str]) -> None:
            if unknown := [x for x in getattr(self, name) if x not in known]:
                out.append(f"{name}: {unknown} are none of {', '.join(known)}")

        for name in ("label", "subject", "group"):
            if getattr(self, name) is not None and not getattr(self, name).strip():
                out.append(f"{name}: a column is needed")
        one_of("task", TASKS)
        one_of("strategy", STRATEGIES)
        for name, least in (("bags", 1), ("bag_size", 1), ("top", 1), ("folds", 2)):
            if getattr(self, name) < least:
                out.append(f"{name}: {getattr(self, name)} is less than {least}")
        subset_of("statistics", tuple(models.BAG_STATISTICS))
        if self.bag_clusters is not None and self.bag_clusters < 2:
            out.append("bag_clusters: shares need two clusters or more")
        if self.strategy == "bags" and not self.statistics and not self.bag_clusters:
            out.append("statistics: bags need statistics, shares of clusters, or both")
        for name in ("overlap", "threshold"):
            if not 0 < getattr(self, name) <= 1:
                out.append(f"{name}: {getattr(self, name)} isn't above 0 and at most 1")
        subset_of("methods", bag_studies.METHODS)
        one_of("evaluation", EVALUATIONS)
        if self.methods and (self.task, self.evaluation) != ("classification", "folds"):
            out.append("methods: features are selected for classes and in folds only")
        if self.strategy == "attention":
            if self.task != "classification" or self.evaluation != "folds" or self.methods or self.group:
                out.append("strategy: attention is for classes, in folds of subjects, without selection")
        else:
            one_of("model", learners.CLASSIFIERS if self.task == "classification" else learners.REGRESSORS)
        return out

    def check(self) -> None:
        if found := self.faults():
            raise ValueError("; ".join(found))

    @staticmethod
    def of(settings: dict[str, Any]) -> Study:
        """A checked study from a mapping; unknown and missing settings are errors like wrong ones."""
        known = {f.name for f in fields(Study)}
        wrong = [f"{k}: there is no such setting" for k in settings if k not in known]
        wrong += [f"{k}: is missing" for k in ("label", "subject") if k not in settings]
        if wrong:
            raise ValueError("; ".join(wrong))
        made = Study(**settings)
        made.check()
        return made


class Outcome(NamedTuple):
    """predictions: of each case or, with attention, subject; scores: one row; overlaps: of bags, by subject; chosen: rows (fold, feature)."""

    predictions: DataFrame
    scores: DataFrame
    features: list[str]
    overlaps: DataFrame | None = None
    chosen: DataFrame | None = None


def check_table(df: DataFrame, features: Sequence[str], study: Study) -> None:
    """Columns are there, features are numbers, and bags have one label and group for each subject."""
    needed = [study.label, study.subject, *([study.group] if study.group else [])]
    if absent := [c for c in [*needed, *features] if c not in df.columns]:
        raise ValueError(f"no such columns: {absent}")
    if not features:
        raise ValueError("no features")
    if text := [f for f in features if not isinstance(df.schema[f].dataType, NumericType)]:
        raise ValueError(f"features that aren't numbers: {text}")
    if inside := [f for f in features if f in needed]:
        raise ValueError(f"features that say what is asked: {inside}")
    if study.strategy != "rows":
        once = [c for c in dict.fromkeys([study.label, *([study.group] if study.group else [])]) if c != study.subject]
        several = df.groupBy(study.subject).agg(*[(F.min(c) != F.max(c)).alias(f"_{k}") for k, c in enumerate(once)])
        names = [r[0] for r in several.where(" or ".join(f"_{k}" for k in range(len(once)))).orderBy(study.subject).limit(5).collect()]
        if names:
            raise ValueError(f"subjects with several labels or groups, among them {names}")


def bag_table(df: DataFrame, features: Sequence[str], key: Sequence[str], study: Study) -> tuple[DataFrame, list[str]]:
    """Rows (subject, bag, label, group, bag features), and the names of the bag features."""
    own = [c for c in dict.fromkeys([study.label, *([study.group] if study.group else [])]) if c != study.subject]
    per = df.groupBy(study.subject).agg(*[F.max(c).alias(c) for c in own])
    made, names = None, []
    if study.statistics:
        made = models.bags(df, study.subject, features, study.bags, study.bag_size, key, study.statistics, study.seed)
        names += [f"{f}__{s}" for f in features for s in study.statistics]
    if study.bag_clusters:
        model = models.fit_clusters(df, features, study.bag_clusters, key, seed=study.seed)
        shares = bag_studies.cluster_shares(df, model, study.subject, study.bags, study.bag_size, key, study.seed)
        names += [f"cluster_{k + 1}__share" for k in range(study.bag_clusters)]
        made = shares if made is None else made.join(shares.drop("n_rows"), [study.subject, "bag"])
    return made.join(per, study.subject), names


def run(study: Study, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> Outcome:
    """The study on a table; key tells its rows apart.

    Rows without label, subject, group or a feature take no part. Rows of a group, or of a subject
    where there is none, are never both learnt from and predicted.
    """
    study.check()
    features = list(features)
    check_table(df, features, study)
    group = study.group or study.subject
    known = df.dropna(subset=list(dict.fromkeys([study.label, study.subject, group, *features])))
    if study.strategy == "attention":
        weights = attention.attention_weights(known, features, study.subject, study.label, key, study.folds, seed=study.seed)
        cases = weights.groupBy("subject").agg(*[F.first(c).alias(c) for c in ("label", "predicted", "score", "fold")])
        hit = (F.col("label") == F.col("predicted")).cast("double")
        return Outcome(cases, cases.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")), features)
    overlaps = bag_studies.bag_overlap(known, study.subject, study.bag_size, study.overlap) if study.strategy == "bags" else None
    cases, names = bag_table(known, features, key, study) if study.strategy == "bags" else (known, features)
    chosen = None
    if study.methods:
        got, chosen = bag_studies.held_out_selected(cases, names, study.label, group, study.methods, study.top, study.threshold, name=study.model, folds=study.folds, seed=study.seed)
    else:
        folds = study.folds if study.evaluation == "folds" else None
        got = learners.held_out_predictions(cases, names, study.label, group, study.model, study.task, folds, study.standardize, study.seed)
    scores = learners.class_scores(got) if study.task == "classification" else learners.subject_scores(got, study.subject)
    return Outcome(got, scores, names, overlaps, chosen)
