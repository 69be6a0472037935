"""Registry of queries: a function of (session, folder) and, where SQL can say it, its twin for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The logs of ``caselake.plans.log`` as SQL, to be put before a twin's own tables.
LOGS = {
    "ev": "ev AS (SELECT user_id AS case_id, event_type AS activity, ts AS time, json_extract_string(props, '$.k') AS resource, value, event_id AS tie FROM events)",
    "sh": "sh AS (SELECT l_orderkey AS case_id, l_returnflag || l_linestatus AS activity, l_shipdate AS time, l_suppkey AS resource, l_partkey AS part, l_linenumber AS line, l_quantity AS quantity, l_extendedprice AS price FROM lineitem)",
    "od": "od AS (SELECT o_custkey AS case_id, o_orderpriority AS activity, o_orderdate AS time, o_orderstatus AS status, o_totalprice AS price, o_orderkey AS tie FROM orders)",
    "di": "di AS (SELECT conv_id AS case_id, role AS activity, turn FROM conversations)",
}
EV, SH, OD, DI = "WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)", "WINDOW w AS (PARTITION BY case_id ORDER BY time, line, part, resource, quantity, price)", "WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)", "WINDOW w AS (PARTITION BY case_id ORDER BY turn)"


def query(sql: str | None = None, *logs: str) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``logs`` names the logs that its SQL refers to."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(LOGS[x] for x in logs)
            body = sql.strip()
            if head:
                body = f"WITH RECURSIVE {head}, {body[15:]}" if body.startswith("WITH RECURSIVE ") else f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
            ORACLES[f.__name__] = body
        return f

    return add
