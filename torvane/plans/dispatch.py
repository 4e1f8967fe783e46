"""(model, phase) to the function that runs it."""

from __future__ import annotations

from collections.abc import Callable

from torvane.operators.models import logistic, naive_bayes, trees

MODELS: dict[tuple[str, str], Callable] = {
    ("logistic_regression", "learning"): logistic.learn,
    ("logistic_regression", "inference"): logistic.predict,
    ("naivebayes", "learning"): naive_bayes.learn,
    ("naivebayes", "inference"): naive_bayes.predict,
    ("randomforest", "learning"): trees.train_random_forest,
    ("randomforest", "inference"): trees.votes,
    ("extratrees", "learning"): trees.train_extra_trees,
    ("extratrees", "inference"): trees.votes,
}


def model(name: str, phase: str) -> Callable:
    if (name, phase) not in MODELS:
        raise ValueError(f"no such model and phase: {name}, {phase}")
    return MODELS[name, phase]
