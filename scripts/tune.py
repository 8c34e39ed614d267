"""Run a full search grid, a stack or a recipe of the reference and print its tables.

Usage: python scripts/tune.py NAME [sf_dir]     NAME: a key of GRIDS, STACKS or RECIPES in churnlab.operators.models
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnlab.operators import models as ml  # noqa: E402
from churnlab.session import get_spark  # noqa: E402
from churnlab.sources.fixture import policyholders  # noqa: E402


def main(name: str, sf_dir: str = "/root/testdata/sf0.01") -> None:
    table = policyholders(get_spark(), sf_dir)
    if name in ml.GRIDS:
        recipe, grid, folds, metric = ml.GRIDS[name]
        points, result = ml.cross_validate(recipe, table, grid, folds, metric)
        points.orderBy("mean_metric", ascending=False).show(1000, False)
    elif name in ml.STACKS:
        base, folds, threshold = ml.STACKS[name]
        result = ml.stacking(table, base, folds, threshold)
    else:
        result = ml.train_evaluate(ml.RECIPES[name], table)
    result.record.show(100, False)


if __name__ == "__main__":
    main(*sys.argv[1:])
