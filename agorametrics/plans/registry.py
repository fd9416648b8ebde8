"""Where queries register themselves next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics.functions.metric import parse_window
from agorametrics.plans.fixtures import ORDERS_AS_OF, Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WIDER = {T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint",
          T.TimestampType: "timestamp_ntz", T.FloatType: "double"}


def stable_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and UTC timestamps without zone, the types DuckDB shows."""
    wide = {f.name: _WIDER.get(type(f.dataType)) for f in df.schema.fields}
    return df.select(*[F.col(f"`{n}`").cast(t).alias(n) if t else F.col(f"`{n}`") for n, t in wide.items()])


def query(name: str, oracle: str | None = None):
    """Register a function of fixtures under ``name``."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: stable_types(fn(Fixtures(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


# --- pieces of oracle SQL --------------------------------------------------------------------
def rd(expr: str, dp: int = 2) -> str:
    """Correctly rounded by DuckDB's number formatting, a way of its own."""
    return f"(cast(format('{{:.{dp}f}}', cast({expr} as double)) as double) + 0)"


def isum(expr: str) -> str:
    return f"cast(sum({expr}) as bigint)"


def ts(at: datetime | str) -> str:
    return f"timestamp '{at}'"


def bounds(as_of: str, window: str) -> tuple[str, str, str]:
    """Literals of the window's end, its start, and the start of the window before."""
    until, delta = datetime.fromisoformat(as_of), parse_window(window)
    return ts(until), ts(until - delta), ts(until - 2 * delta)


LATEST = f"""latest as (select * from fx_snapshots where captured_at <= timestamp '{ORDERS_AS_OF}'
 qualify row_number() over (partition by post_id order by captured_at desc) = 1)"""

POST_METRICS = f"""{LATEST}, pm as (
 select p.*, a.platform, a.handle, l.captured_at, coalesce(l.likes, 0) as likes,
  coalesce(l.comments_count, 0) as comments_count, coalesce(l.shares, 0) as shares,
  coalesce(l.saves, 0) as saves, l.reach, l.impressions, l.video_views, l.clicks,
  coalesce(l.likes, 0) + coalesce(l.comments_count, 0) + coalesce(l.shares, 0) + coalesce(l.saves, 0) as engagement,
  a.followers_count as followers
 from fx_posts p join latest l on l.post_id = p.post_id join fx_accounts a on a.account_id = p.account_id)"""

FACTS = f"""{POST_METRICS}, facts as (
 select *, case when reach > 0 then {rd('engagement / reach * 100')}
   when followers > 0 then {rd('engagement / followers * 100')} end as er,
  case when reach > 0 then 'err' when followers > 0 then 'erf' else 'none' end as er_basis,
  case when reach > 0 or followers > 0 then null when reach is null then 'reach_unavailable'
   else 'non_positive_denominator' end as er_reason from pm)"""


def rate_sql(num: str, den: str, missing: str, gate: tuple[str, str] | None = None) -> tuple[str, str]:
    """Value and reason of a guarded rate."""
    first = f"when {gate[0]} is null then '{gate[1]}' " if gate else ""
    reason = f"case {first}when {den} is null then '{missing}' when {den} <= 0 then 'non_positive_denominator' end"
    ok = f"{den} > 0" + (f" and {gate[0]} is not null" if gate else "")
    return f"case when {ok} then {rd(f'{num} / {den} * 100')} end", reason


KPI_SQL = {
    "engagement_rate_by_reach": rate_sql("engagement", "reach", "reach_unavailable"),
    "engagement_rate_by_followers": rate_sql("engagement", "followers", "followers_unavailable"),
    "engagement_rate_by_impressions": rate_sql("engagement", "impressions", "impressions_unavailable"),
    "amplification_rate": rate_sql("shares", "followers", "followers_unavailable"),
    "applause_rate": rate_sql("likes", "followers", "followers_unavailable"),
    "conversation_rate": rate_sql("comments_count", "followers", "followers_unavailable"),
    "save_rate": rate_sql("saves", "reach", "reach_unavailable"),
    "virality_rate": rate_sql("shares", "reach", "reach_unavailable"),
    "click_through_rate": rate_sql("clicks", "impressions", "impressions_unavailable",
                                   ("clicks", "clicks_unavailable")),
    "video_view_rate": rate_sql("video_views", "reach", "reach_unavailable",
                                ("video_views", "video_views_unavailable")),
}


def kpi_select(names=None) -> str:
    return ", ".join(f"{v} as {n}, {r} as {n}_reason" for n, (v, r) in KPI_SQL.items()
                     if names is None or n in names)


def basis_sql(n_err: str, n_erf: str) -> str:
    return f"case when {n_err} + {n_erf} = 0 then 'none' when {n_err} >= {n_erf} then 'err' else 'erf' end"


def delta_sql(cur: str, prev: str) -> tuple[str, str]:
    return (
        f"case when {cur} is not null and {prev} is not null and {prev} <> 0 "
        f"then {rd(f'({cur} - {prev}) / abs({prev}) * 100')} end",
        f"case when {cur} is null or {prev} is null then 'insufficient_data' "
        f"when {prev} = 0 then 'non_positive_denominator' end",
    )
