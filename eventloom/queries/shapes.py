"""The given tables as telemetry tables, and the registry of queries.

A shape is SQL text.  Spark runs it on the Parquet tables; the oracle puts the same text
(or the second one, where the dialects differ) in front of its query as a common table
expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_K = ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)")
_TS = ("cast(ts as timestamp)", "ts")


def _both(text: str, **pairs: tuple[str, str]) -> tuple[str, str]:
    spark, duck = text, text
    for k, (a, b) in pairs.items():
        spark, duck = spark.replace(f"<{k}>", a), duck.replace(f"<{k}>", b)
    return spark, duck


_EV = {"k": _K, "ts": _TS, "day": ("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"), "us": ("unix_micros(cast(ts as timestamp))", "epoch_us(ts)"), "mid": ("unix_micros(cast(date_trunc('day', ts) as timestamp))", "epoch_us(date_trunc('day', ts))")}
_ORD = {"us": ("unix_micros(cast(o_orderdate as timestamp))", "epoch_us(o_orderdate::timestamp)")}

SHAPES: dict[str, tuple[str, str]] = {
    "network_samples": _both("select event_id as sample_id, user_id as session_id, <us> as t_us, value as ping from events", **_EV),
    "state_samples": _both(
        "select event_id as sample_id, user_id as session_id, <day> as round_id, (<us> - <mid>) / 1000.0 as game_ms, value as x, cast(<k> as double) as y, value - 50 as vx, cast(<k> - 50 as double) as vy, event_type = 'error' as airborne, event_type = 'click' as rolling from events",
        **_EV,
    ),
    "combat_events": _both(
        "select event_id, <us> as t_us, <day> as round_id, case event_type when 'error' then 'player_death' when 'click' then 'player_damage' when 'view' then 'melee_action' else 'projectile_hit' end as event_type, user_id as attacker_id, <k> as victim_id, value as damage, event_type as weapon, value as distance from events",
        **_EV,
    ),
    "player_sessions": _both(
        "select o_orderkey as session_id, case when o_orderkey % 7 = 0 then null else o_custkey end as identity_id, <us> as joined_us, case when o_orderstatus = 'O' then null else <us> + (o_orderkey % 172800) * 1000000 end as left_us, o_orderkey % 10 = 0 as is_bot, o_orderstatus as reason, o_orderpriority as server, concat('C', cast(o_custkey as string)) as account_name, case when o_orderkey % 3 = 0 then concat('P', cast(o_orderkey as string)) end as character_name from orders",
        **_ORD,
    ),
    "rounds": _both("select o_orderkey as round_id, o_orderpriority as map, <us> as started_us, o_totalprice as duration_ms, o_orderkey % 8 as player_count, case o_orderstatus when 'F' then 'exact' when 'O' then 'derived' end as result_source from orders", **_ORD),
    "round_players": ("select distinct l_orderkey as round_id, l_suppkey as session_id, l_linenumber > 4 as late_join from lineitem",) * 2,
    "stat_snapshots": _both("select event_id, user_id as session_id, <day> as round_id, <us> as t_us, case event_type when 'signup' then 'round_start' else 'sample' end as checkpoint, cast(event_id as double) as shots, value as jumps from events", **_EV),
    "key_input": _both("select event_id, user_id as session_id, <us> as t_us, event_type as key, case when event_id % 3 = 0 then 'Pressed' when event_id % 3 = 1 then 'Released' else 'Held' end as transition from events", **_EV),
    "scene_interactions": _both(
        "select event_id as interaction_id, user_id as player_id, <day> as round_id, (<us> - <mid>) / 1000.0 as game_ms, event_type as interaction, value as x, cast(<k> as double) as y, <k> as target_id from events", **_EV
    ),
    "object_names": ("select p_partkey as object_id, p_name as name from part",) * 2,
    "envelopes": _both(
        "select event_id + 1 as seq, 'srv' as server, <day> as round_id, event_type, <us> as t_us, user_id as player_id, props as data, event_id from events where event_id % 50 <> 7 union all select event_id + 1, 'srv', <day>, event_type, <us>, user_id, props, event_id from events where event_id % 20 = 0 and event_id % 50 <> 7",
        **_EV,
    ),
    "chat_messages": ("select conv_id * 1000 + turn as chat_id, conv_id as round_id, role as player_id, text as message, conv_id * 1000 + turn as t_s from conversations",) * 2,
}


class Shapes:
    """Attribute access to the given tables and to the shapes, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        for t in used:
            text = re.sub(rf"\b{t}\b(?!\.)", "{" + t + "}", text)
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SHAPES:
            return self.sql(SHAPES[name][0])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_shapes(body: str) -> str:
    """The oracle's text with the shapes that it names in front."""
    body = body.strip()
    used = [f"{n} as ({SHAPES[n][1]})" for n in SHAPES if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    head = ", ".join(used)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(shapes) -> DataFrame`` under ``name``, with its DuckDB text if there is one."""

    def register(fn: Callable[[Shapes], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Shapes(spark, sf_dir))
        if sql:
            SQL[name] = with_shapes(sql)
        return fn

    return register
