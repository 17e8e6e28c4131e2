"""Relational stores by JDBC: reads in ranges of a key with filters pushed down, and a sink that writes once and as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def connection(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> Iterator:
    """A connection of the driver without automatic commits; what isn't committed is rolled back."""
    jvm = spark._jvm
    values = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        values.setProperty(k, v)
    held = jvm.java.sql.DriverManager.getConnection(url, values)
    held.setAutoCommit(False)
    try:
        yield held
    finally:
        held.rollback()
        held.close()


def execute(held, *statements: str) -> list[int]:
    """Runs statements and gives the number of rows that each changed."""
    out = []
    for sql in statements:
        statement = held.createStatement()
        try:
            out.append(statement.executeUpdate(sql))
        finally:
            statement.close()
    return out


def values_of(held, sql: str) -> list[list]:
    """The rows of a small result."""
    statement = held.createStatement()
    try:
        found, out = statement.executeQuery(sql), []
        n = found.getMetaData().getColumnCount()
        while found.next():
            out.append([found.getObject(k + 1) for k in range(n)])
        return out
    finally:
        statement.close()


def read_table(spark: SparkSession, url: str, table: str, key: str, rows_a_part: int = 100_000, properties: dict[str, str] | None = None) -> DataFrame:
    """A table in as many parts as its rows ask for, cut at equal ranges of a whole-number key (null keys are in the first part).

    Filters, columns, limits and aggregates that the store can do are pushed to it.
    """
    properties = properties or {}
    with connection(spark, url, properties) as held:
        low, high, n = values_of(held, f"select min({key}), max({key}), count(*) from {table}")[0]
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    parts = -(-int(n) // rows_a_part)
    if low is None or parts < 2 or low == high:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high)).option("numPartitions", parts).load()


def exists(held, table: str) -> bool:
    found = held.getMetaData().getTables(None, None, table.upper(), None)
    try:
        return found.next()
    finally:
        found.close()


def upsert(rows: DataFrame, url: str, table: str, key: list[str], write_id: str, properties: dict[str, str] | None = None, parts: int = 8) -> bool:
    """Rows in place of those with their keys, in one transaction; a write that was made before changes nothing and gives False.

    Tasks write to a table of their own first, so a task that runs twice, or a job that dies, leaves the target as it was. Then one transaction moves the rows and
    notes the write's name in WRITES_DONE. The target has to be there with the rows' columns; keys must not repeat (the transaction fails) nor be null.
    """
    spark, properties = rows.sparkSession, properties or {}
    with connection(spark, url, properties) as held:
        if not exists(held, "writes_done"):
            execute(held, "create table writes_done (name varchar(200) not null primary key)")
            held.commit()
        if values_of(held, f"select 1 from writes_done where name = '{_plain(write_id)}'"):
            return False
    staged = f"staged_{uuid.uuid4().hex[:12]}"
    rows.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", staged).options(**properties).mode("overwrite").save()
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    same = " and ".join(f't."{c}" = s."{c}"' for c in key)
    try:
        with connection(spark, url, properties) as held:
            execute(
                held,
                f"insert into writes_done values ('{_plain(write_id)}')",  # of two writers with one name the second fails here
                f"delete from {table} t where exists (select 1 from {staged} s where {same})",
                f"insert into {table} ({columns}) select {columns} from {staged}",
            )
            held.commit()
    finally:
        with connection(spark, url, properties) as held:
            execute(held, f"drop table {staged}")
            held.commit()
    return True


def _plain(name: str) -> str:
    if not name or not all(c.isalnum() or c in "-_.:" for c in name):
        raise ValueError("names of writes are letters, digits and -_.:")
    return name
