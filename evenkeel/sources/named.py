"""Named sources, JDBC tables and SQL texts as sides of a compare."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.normalize import lower_names

# JDBC addresses and drivers per database engine.
JDBC_URLS = {
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{service_name}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
}
JDBC_DRIVERS = {
    "oracle": "oracle.jdbc.OracleDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
}
FETCH_SIZE = 10_000


@dataclass(frozen=True)
class Partitioning:
    """Read a JDBC table in ``parts`` ranges of a numeric, date or time column.

    ``even`` asks the database how rows are spread and cuts ranges of about equally many, with rows without a value as a
    part of their own; else ranges are equally wide between the bounds, which the database is asked for if not given.
    """

    column: str
    parts: int
    lower: str | int | None = None
    upper: str | int | None = None
    even: bool = False


def resolve(name: str, sources: Mapping[str, Mapping[str, object]]) -> dict[str, str]:
    """Reader options of a named source: a ``format`` plus its options."""
    if name not in sources:
        raise KeyError(f"unknown source {name!r}; known sources: {', '.join(sorted(sources)) or 'none'}")
    entry = dict(sources[name])
    kind = str(entry.pop("type", ""))
    entry.pop("description", None)
    if kind in JDBC_URLS:
        options = {"format": "jdbc", "url": JDBC_URLS[kind].format(**entry), "driver": JDBC_DRIVERS[kind]}
        for field in ("user", "password"):
            if entry.get(field) is not None:
                options[field] = str(entry[field])
        return options
    if not kind:
        raise ValueError(f"source {name!r} has no type")
    return {"format": kind, **{k: str(v) for k, v in entry.items()}}


def statement(table: str | None = None, query: str | None = None) -> str:
    """What to read: a given query wins over a table name."""
    if query:
        return f"({query.strip().rstrip(';')}) q"
    if table:
        return table
    raise ValueError("give a table or a query")


def read_jdbc(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str | None = None,
    query: str | None = None,
    where: str | None = None,
    order_by: list[str] | None = None,
    limit: int | None = None,
    partition: Partitioning | None = None,
    fetch_size: int = FETCH_SIZE,
) -> DataFrame:
    """A table or query of a database with lower-case column names.

    Filters and columns used later are pushed to the database. ``partition`` reads
    ranges in parallel; missing bounds are asked from the database first.
    """
    what = statement(table, query)
    plain = {k: v for k, v in options.items() if k != "format"}

    def reader(relation: str):
        return spark.read.format("jdbc").options(**plain).option("dbtable", relation).option("fetchsize", fetch_size)

    if partition is None:
        rows = reader(what).load()
    elif partition.even:
        conditions = even_ranges(reader, what, partition)
        properties = {**{k: v for k, v in plain.items() if k != "url"}, "fetchsize": str(fetch_size)}
        rows = spark.read.jdbc(plain["url"], what, predicates=conditions, properties=properties)
    else:
        lower, upper = partition.lower, partition.upper
        if lower is None or upper is None:
            ends = reader(what).load().agg(F.min(partition.column), F.max(partition.column)).first()
            lower, upper = (ends[0] if lower is None else lower), (ends[1] if upper is None else upper)
        if lower is None or upper is None:
            rows = reader(what).load()
        else:
            rows = (
                reader(what)
                .option("partitionColumn", partition.column)
                .option("lowerBound", str(lower))
                .option("upperBound", str(upper))
                .option("numPartitions", partition.parts)
                .load()
            )
    rows = lower_names(rows)
    if where:
        rows = rows.where(where)
    if order_by:
        rows = rows.orderBy(*order_by)
    return rows if limit is None else rows.limit(limit)


#: Borders that one query counts the rows below of, and how often a range that holds too many is cut again.
_BORDERS = 64
_ROUNDS = 6


def _constant(value: object) -> str:
    """A border as database text; dates and times in the form that every JDBC driver translates."""
    if isinstance(value, datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
    return f"{{d '{value:%Y-%m-%d}'}}" if isinstance(value, date) else str(value)


def even_ranges(reader: Callable, what: str, partition: Partitioning) -> list[str]:
    """Conditions that cut a relation into about ``parts`` ranges of equally many rows, and one for NULLs.

    The database counts the rows below a few borders at a time; a range that holds more than its share is given borders
    of its own in the next query, so a skewed column takes a few queries more. A single value is never cut.
    """
    column = partition.column
    ends = reader(what).load().agg(F.min(column), F.max(column), F.count(column)).first()
    low, high, total = ends
    if low is None or partition.parts < 2 or low == high:
        return ["1 = 1"]
    step = timedelta(days=1) if type(low) is date else timedelta(microseconds=1) if isinstance(low, datetime) else type(low)(1)
    whole = not isinstance(low, float | Decimal)
    share = total / partition.parts
    below: dict[object, int] = {low: 0}  # rows below each border
    ranges = [(low, high)]
    for _ in range(_ROUNDS):
        wanted: list = []
        for begin, end in ranges:
            n = max(2, _BORDERS // len(ranges))
            cuts = {begin + (end - begin) * i // n if whole else begin + (end - begin) * i / n for i in range(1, n)}
            if whole:
                cuts.add(min(begin + step, end))
            wanted.extend(sorted(c for c in cuts if begin < c <= high and c not in below))
        wanted = wanted[: 4 * _BORDERS]
        if not wanted:
            break
        sums = ", ".join(f"SUM(CASE WHEN {column} < {_constant(c)} THEN 1 ELSE 0 END) AS B{i}" for i, c in enumerate(wanted))
        counts = reader(f"(SELECT {sums} FROM {what if what.startswith('(') else what + ' q'}) h").load().first()
        below.update({c: int(n) for c, n in zip(wanted, counts, strict=True)})
        borders = sorted(below)
        held = [(a, b, below[b] - below[a]) for a, b in zip(borders, borders[1:], strict=False)]
        held.append((borders[-1], high, total - below[borders[-1]]))
        ranges = [(a, b) for a, b, n in held if n > share / 4 and a < b and not (whole and b - a <= step)]
        if not ranges:
            break
    cuts, last = [], 0
    for border in sorted(below):
        following = next((b for b in sorted(below) if b > border), None)
        ahead = total if following is None else below[following]
        # The last border before a part would grow beyond its share ends it.
        if below[border] > last and ahead - last > share:
            cuts.append(border)
            last = below[border]
    ends = [None, *cuts, None]
    conditions = []
    for begin, end in zip(ends, ends[1:], strict=False):
        sides = ([] if begin is None else [f"{column} >= {_constant(begin)}"]) + ([] if end is None else [f"{column} < {_constant(end)}"])
        conditions.append(" AND ".join(sides) or f"{column} IS NOT NULL")
    return [*conditions, f"{column} IS NULL"]


def read_sql(spark: SparkSession, query: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """A SQL text over relations that it names plainly or in braces, as a side.

    Only the given names are taken as fields, so braces may stand in literals. The
    relations are seen by this text alone: views of the session keep their meaning.
    """
    held = {name: f"evenkeel_{uuid.uuid4().hex}" for name in views}
    text = query.strip().rstrip(";")
    for name, own in held.items():
        views[name].createOrReplaceTempView(own)
        text = text.replace("{" + name + "}", own)
    try:
        named = ", ".join(f"`{name}` as (select * from {own})" for name, own in held.items())
        # The line break ends a comment that the text may end with.
        return spark.sql(f"with {named} select * from (\n{text}\n)" if held else text)
    finally:
        for own in held.values():
            spark.catalog.dropTempView(own)


def read_named(
    spark: SparkSession, name: str, sources: Mapping[str, Mapping[str, object]], **how
) -> DataFrame:
    """Load a named source: a database, a catalog table, or files of a format."""
    options = resolve(name, sources)
    kind = options.pop("format")
    if kind == "jdbc":
        return read_jdbc(spark, options, **how)
    if kind == "table":
        return spark.table(options["name"])
    return lower_names(spark.read.format(kind).options(**options).load())
