"""The fact of the given tables: yearly averages by window and by day, and how rows move for them."""

import re

from checks import binding
from helpers import facts


def test_yearly_averages_by_window_and_by_day_agree(spark):
    days = ["2023-01-01", "2023-12-31", "2024-01-01", "2024-01-01", None]
    rows = facts(spark, [{"competitor_id": 1 + i % 2, "date": days[i % 5], "seconds": None if i % 7 == 0 else i + 0.5} for i in range(30)])
    rows = rows.drop("avg_12m_text")
    both = [sorted(map(tuple, way(rows).select("entry_id", "avg_12m_text").collect()))
            for way in (binding._year_average, binding._year_average_by_day)]
    assert both[0] == both[1] and any(text for _, text in both[0])


def test_results_do_not_move_by_competitor_and_day(spark):
    plan = binding.build_fact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(competitor_id#\d+L?, date#", plan)
