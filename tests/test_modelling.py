"""Queries that fit pooled trees do so at the operators' defaults."""

import __spark_entry__ as entry
import pytest
from small_data import SMALL

from barloom.operators import models as ml


class Asked(Exception):
    pass


def _regressor(family, target, trees, depth):
    raise Asked(trees, depth)


def _classifier(**params):
    raise Asked(params["numTrees"], params["maxDepth"])


@pytest.mark.parametrize("name", ["fit_scores_trees_pooled", "fit_direction_pooled", "forward_scores"])
def test_queries_fit_all_trees(spark, monkeypatch, name):
    monkeypatch.setattr(ml, "_regressor", _regressor)
    monkeypatch.setattr(ml, "RandomForestClassifier", _classifier)
    with pytest.raises(Asked) as asked:
        entry.queries()[name](spark, SMALL)
    assert asked.value.args == (ml.TREES, 5) == (200, 5)
