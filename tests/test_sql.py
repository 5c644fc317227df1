from __future__ import annotations

import pytest

from tidelog.errors import SqlRejected
from tidelog.plans.sqlapi import COLUMNS, execute, plan_sql, result_schema, run_sql


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        ("", "exactly one"), ("SELECT 1 FROM executions", "column"), ("SELECT * FROM other", "unknown table"), ("DELETE FROM executions", "read-only"), ("SELECT nope FROM executions", "unknown column"),
        ("WITH x AS (SELECT 1) SELECT * FROM executions", "common table"), ("SELECT * FROM executions ORDER BY status", "ORDER BY"), ("SELECT DISTINCT status FROM executions", "DISTINCT"), ("SELECT status FROM executions GROUP BY status", "GROUP BY"),
        ("SELECT * FROM executions, executions", "one table"), ("SELECT * FROM executions JOIN executions", "join"), ("SELECT * FROM executions UNION SELECT * FROM executions", "set operations"), ("SELECT status AS s FROM executions", "alias"), ("SELECT count(*) FROM executions", "bare column"),
        ("SELECT * FROM executions WHERE status > 'a'", "equality"), ("SELECT * FROM executions WHERE terminal = 'true'", "status and execution_id"), ("SELECT * FROM executions WHERE status = running", "literal"), ("SELECT * FROM executions WHERE status = 'a' OR status = 'b'", "OR"),
        ("SELECT * FROM executions LIMIT ten", "integer"), ("SELECT * FROM executions LIMIT 5 OFFSET 2", "OFFSET"), ("SELECT * FROM executions; SELECT * FROM executions", "exactly one"), ("SELECT * FROM executions e", "expected"), ("SELECT * FROM executions WHERE (status = 'a'", "expected"), ("SELECT ? FROM executions", "unexpected character"),
    ],
)
def test_rejections(sql, reason):
    with pytest.raises(SqlRejected, match=reason):
        plan_sql(sql)


def test_plans():
    p = plan_sql("select STATUS, \"execution_id\", status from Executions where (status = 'a' and (execution_id = 'it''s')) and status = 'B' limit 5000;")
    assert p.columns == ("status", "execution_id", "status") and p.status == "B" and p.execution_id == "it's" and p.limit == 1000
    assert plan_sql("SELECT *, status FROM executions").columns == (*COLUMNS, "status") and plan_sql("SELECT * FROM executions").limit == 100
    assert plan_sql("SELECT * FROM executions LIMIT 0").limit == 0


def test_execution(spark):
    rows = spark.createDataFrame([("1", "COMPLETED", None, 2, 5, 9, 1, True, "x"), ("2", "running", "n", 1, 1, 1, 2, False, None), ("3", "completed", "n", 1, 7, 7, 3, True, "x")], result_schema(plan_sql("SELECT * FROM executions")))
    assert [r.execution_id for r in run_sql(rows, "SELECT execution_id FROM executions").collect()] == ["2", "1", "3"]
    assert [r.execution_id for r in run_sql(rows, "SELECT execution_id FROM executions WHERE status = 'Completed' LIMIT 2").collect()] == ["1"]
    assert run_sql(rows, "SELECT execution_id FROM executions LIMIT 0").collect() == []
    q = plan_sql("SELECT terminal, status FROM executions WHERE execution_id = '9'")
    assert execute(rows, q).collect() == [] and execute(rows, q).schema.names == result_schema(q).names
