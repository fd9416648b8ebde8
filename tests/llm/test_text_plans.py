"""Plans of the text queries: native where asked for, no joins that multiply rows."""

import pytest

from agorametrics.llm import queries

SF = "/root/testdata/sf0.001"
NATIVE = ("op2_url_filter", "op7_quality_rules")


@pytest.mark.parametrize("name", ["op1_decontamination", *NATIVE, "op9_license_scan"])
def test_plans(spark, name):
    df = queries.QUERIES[name](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name in NATIVE:
        assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


def test_native_operators_use_no_python():
    from agorametrics.llm import quality_rules, url_filter

    for module in (quality_rules, url_filter):
        with open(module.__file__) as source:
            text = source.read()
        assert not any(w in text for w in ("pandas", "pyarrow", "mapIn", "applyIn", "udf(", ".rdd"))
