"""Registered queries against their SQL twins.

By default a few of the supply rankings stand for all of them, since they share their code;
``LARDERLINE_ALL=1`` runs every query and ``LARDERLINE_SF`` names another table folder.
"""

import os
import subprocess
import sys

import pytest
from compare import differences, duck

from larderline.plans.supply import REPORTS
from larderline.queries import REGISTRY

SF = os.environ.get("LARDERLINE_SF", "/root/testdata/sf0.001")
EVERYTHING = os.environ.get("LARDERLINE_ALL") == "1"
SHOWN = {
    "supply_protein_by_diet",
    "supply_lysine_of_top_protein_by_diet",
    "supply_reported_vegetarian_servings",
    "chart_digestible_lysine_by_diet",
    "chart_protein_population",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


def chosen() -> list[str]:
    reports = {f"{kind}_{name}" for name in REPORTS for kind in ("supply", "chart")}
    return [n for n in REGISTRY if EVERYTHING or n in SHOWN or n not in reports]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", chosen())
def test_same_result(spark, con, name):
    q = REGISTRY[name]
    assert differences(q.run(spark, SF), con.execute(q.sql)) == []


def test_entry_points(spark):
    import __spark_entry__ as entry_points

    assert set(REGISTRY) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


def test_entry_points_without_the_training_data_part():
    code = (
        "import sys; sys.modules['larderline.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; from larderline.queries import REGISTRY\n"
        "assert set(e.queries()) == set(e.oracle_sql()) == set(REGISTRY)"
    )
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-B", "-c", code], cwd=top, check=True)
