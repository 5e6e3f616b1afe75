"""Files are read by one job, however many joins their rows feed."""

import pytest

from folio.plans import acts


@pytest.mark.parametrize("name", ["xml_parse", "html_parse", "page_nodes"])
def test_no_reader_is_left_in_the_plan(spark, name):
    plan = acts.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "MapInArrow" not in plan
