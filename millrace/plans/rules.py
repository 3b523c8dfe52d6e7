"""Rule groups: recording rules evaluated in order on the group's own grid, later rules seeing what earlier ones recorded.

A group is due at the times ``offset + k * interval``; the offset is a hash of
its name within the interval, so groups of one interval do not all fall due at
once. Groups are dealt over shards by a hash of tenant, namespace and name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.metric_queries import _SUM, END, START, STEP, samples
from millrace.plans.promql import Engine
from millrace.registry import query


def stable(*names: str) -> int:
    return int.from_bytes(hashlib.sha256("\0".join(names).encode()).digest()[:8], "big")


@dataclass(frozen=True)
class Rule:
    record: str
    expr: str


@dataclass(frozen=True)
class Group:
    name: str
    interval: int
    rules: tuple[Rule, ...]
    namespace: str = ""
    tenant: str = ""
    limit: int = 0

    def offset(self) -> int:
        return stable(self.tenant, self.namespace, self.name) % self.interval

    def due(self, after: int, until: int) -> list[int]:
        """The group's evaluation times in (after, until]."""
        first = (after - self.offset()) // self.interval + 1
        return list(range(first * self.interval + self.offset(), until + 1, self.interval))

    def owned_by(self, shard: int, shards: int) -> bool:
        """Shards count from 1."""
        if not 1 <= shard <= shards:
            raise ValueError(f"shard must be between 1 and {shards}")
        return stable(self.tenant, self.namespace, self.name) % shards == shard - 1


def evaluate(group: Group, data: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """labels, ts, value recorded by the group's rules at each time of the grid."""
    out = None
    for rule in group.rules:
        seen = data if out is None else data.select("labels", "ts", "value").unionByName(out)
        rows = Engine(seen, start, end, step).query(rule.expr)
        plain = F.map_filter("labels", lambda k, v: k != "__name__")
        rows = rows.select(F.map_concat(F.create_map(F.lit("__name__"), F.lit(rule.record)), plain).alias("labels"), F.col("step").alias("ts"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("rule_group", _SUM + """, a AS (SELECT step, event_type, sum(value) AS value FROM x GROUP BY ALL), t AS (SELECT step, sum(value) AS value FROM a GROUP BY ALL)
SELECT 'type:v:sum' AS name, step, event_type, round(value, 6) AS value FROM a UNION ALL SELECT 'type:v:share', a.step, event_type, round(a.value / t.value, 6) FROM a JOIN t USING (step)""")
def rule_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second rule reads what the first recorded."""
    group = Group("shares", STEP, (Rule("type:v:sum", "sum by (event_type) (sum_over_time(v[1d]))"), Rule("type:v:share", "type:v:sum / ignoring (event_type) group_left sum(type:v:sum)")))
    out = evaluate(group, samples(spark, sf_dir), START, END, STEP)
    return out.select(F.col("labels")["__name__"].alias("name"), F.col("ts").alias("step"), F.try_element_at("labels", F.lit("event_type")).alias("event_type"), F.round("value", 6).alias("value"))
