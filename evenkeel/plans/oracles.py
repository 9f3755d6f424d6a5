"""SQL texts for checking keyed compares: grouping, full join, CASE and sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from evenkeel.plans.fixtures import with_


def collapsed(name: str, relation: str, keys: Sequence[str], columns: Sequence[str]) -> str:
    values = "".join(f", any_value({c}) as {c}" for c in columns)
    known = " and ".join(f"{k} is not null" for k in keys)
    listed = ", ".join(keys)
    return f"{name} as (select {listed}, count(*) as n{values} from {relation} where {known} group by {listed})"


def statuses(
    source: str, target: str, keys: Sequence[str], equal: Mapping[str, str], columns: Sequence[str] | None = None
) -> str:
    """CTEs ``sk``, ``tk`` and ``j``: one row per key with counts, equalities and status."""
    columns = list(columns or equal)
    on = " and ".join(f"s.{k} = t.{k}" for k in keys)
    picked = ", ".join(f"coalesce(s.{k}, t.{k}) as {k}" for k in keys)
    marks = "".join(f", ({cond}) as eq_{c}" for c, cond in equal.items())
    every = " and ".join(f"eq_{c}" for c in equal) or "true"
    nulls = " or ".join(f"{k} is null" for k in keys)
    listed = ", ".join(keys)
    lone_marks = "".join(", true" for _ in equal)
    return f"""
    {collapsed("sk", source, keys, columns)},
    {collapsed("tk", target, keys, columns)},
    p as (select {picked}, coalesce(s.n, 0) as n_source, coalesce(t.n, 0) as n_target{marks}
          from sk s full outer join tk t on {on}),
    j as (select *, case when n_target = 0 then 'missing_in_target'
                         when n_source = 0 then 'missing_in_source'
                         when n_source <> 1 or n_target <> 1 then 'duplicate_key'
                         when {every} then 'match' else 'value_mismatch' end as row_status
          from p
          union all
          select {listed}, 1, 0{lone_marks}, 'missing_in_target' from {source} where {nulls}
          union all
          select {listed}, 0, 1{lone_marks}, 'missing_in_source' from {target} where {nulls})"""


def _sum(column: str, status: str | None = None) -> str:
    which = f" filter (where row_status = '{status}')" if status else ""
    return f"cast(coalesce(sum({column}){which}, 0) as bigint)"


COUNTS = f"""
    {_sum("n_source")} as total_rows_source,
    {_sum("n_target")} as total_rows_target,
    {_sum("n_source", "match")} as matching_rows,
    {_sum("n_source", "value_mismatch")} as mismatched_rows,
    {_sum("n_source", "missing_in_target")} as missing_in_target,
    {_sum("n_target", "missing_in_source")} as missing_in_source,
    {_sum("n_source", "duplicate_key")} as duplicate_rows_source,
    {_sum("n_target", "duplicate_key")} as duplicate_rows_target"""

SCORED = """
    case when matching_rows = total_rows_source and matching_rows = total_rows_target
         then 'identical' else 'mismatch' end as match_status,
    match_score,
    case when match_score >= 99 then 'Excellent' when match_score >= 95 then 'Good'
         when match_score >= 80 then 'Warning' else 'Critical' end as rating,
    case when match_score >= 95 then 'Pass' when match_score >= 80 then 'Warning' else 'Fail' end as outcome"""

SCORE = """case when greatest(total_rows_source, total_rows_target) > 0
    then round(100.0 * matching_rows / greatest(total_rows_source, total_rows_target), 2) else 0.0 end"""


def summary(
    relations: Sequence[str],
    source: str,
    target: str,
    keys: Sequence[str],
    equal: Mapping[str, str],
    extra: str = "",
) -> str:
    """The one-row summary; ``extra`` holds further CTEs that define the sides."""
    differing = " + ".join(
        f"cast(coalesce(bool_or(n_source = 1 and n_target = 1 and not eq_{c}), false) as integer)" for c in equal
    )
    return f"""
    {with_(*relations)}{"," + extra if extra else ""},
    {statuses(source, target, keys, equal)},
    c as (select {COUNTS}, {len(equal)} as columns_compared, {differing or 0} as columns_with_differences from j),
    m as (select *, {SCORE} as match_score from c)
    select total_rows_source, total_rows_target, matching_rows, mismatched_rows, missing_in_target,
           missing_in_source, duplicate_rows_source, duplicate_rows_target, columns_compared,
           columns_with_differences, {SCORED}
    from m"""


def same(*columns: str) -> dict[str, str]:
    return {c: f"s.{c} is not distinct from t.{c}" for c in columns}
