"""What plans and code must not have: Python under native operators, cross joins, local checkpoints, unbounded collects."""

import inspect
import re

import pytest

import lumenfold.llm as package
from lumenfold.llm import common, queries
from tests.llm.cases import frame, prose

NATIVE = ("op1_url_filter", "op2_quality_rules", "op3_source_mixing", "op4_decontamination", "op5_license_scan", "op10_pii")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, [prose(i, 60) for i in range(30)]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(1, 20))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.example.com/en/1", "<p>")], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", list(queries.queries()))
def test_plans(spark, folder, name, monkeypatch):
    plans = []
    write = common.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    for module in vars(queries).values():
        where = inspect.getmodule(module)
        if callable(module) and where and where.__name__.startswith("lumenfold.llm.") and hasattr(where, "written"):
            monkeypatch.setattr(where, "written", seen)
    plans.append(queries.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString())
    text = "\n".join(plans)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    if name in NATIVE:
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", text)
    assert "html" not in text  # columns that aren't needed aren't read


def test_code():
    for file in __import__("pathlib").Path(package.__file__).parent.glob("*.py"):
        code = file.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|toPandas|\.rdd\b|sample\(fraction", code), file
