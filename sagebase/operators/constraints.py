"""Rules of uniqueness and reference, checked over whole tables: each table is read once, whatever the number of its rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unique:
    """No two rows of a table have the same values in these columns; rows with a null among them don't count."""

    table: str
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"unique {self.table}({', '.join(self.columns)})"


@dataclass(frozen=True)
class Reference:
    """The values in these columns occur in the other table's; rows with a null among them don't count."""

    table: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"reference {self.table}({', '.join(self.columns)}) -> {self.target}({', '.join(self.target_columns)})"


#: Keys of a task, about; parts that the rows of one key are counted in.
KEYS_A_TASK, SALTS = 500_000, 16


def keys(df: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """slot and key of each row for several sets of columns (by slot) in one pass: the column's text, or the columns' texts as JSON; keys with nulls are left out."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    key = lambda s: text(s[0]) if len(s) == 1 else F.when(~_any_null(s), F.to_json(F.array(*map(text, s))))
    wide = df.select(*[key(s).alias(slot) for slot, s in sets.items()])
    return wide.unpivot([], list(sets), "slot", "key").where("key is not null")


def _any_null(columns: tuple[str, ...]):
    out = F.lit(False)
    for c in columns:
        out = out | F.col(f"`{c}`").isNull()
    return out


def _families(rules: list[Unique | Reference]) -> list[list[tuple[str, tuple[str, ...]]]]:
    """Sets of columns (table, columns) that references connect."""
    out: list[list[tuple[str, tuple[str, ...]]]] = []
    for rule in rules:
        sides = [(rule.table, rule.columns), *([(rule.target, rule.target_columns)] if isinstance(rule, Reference) else [])]
        met = [f for f in out if any(s in f for s in sides)]
        out = [f for f in out if f not in met] + [list(dict.fromkeys([*(s for f in met for s in f), *sides]))]
    return out


def violations(tables: dict[str, DataFrame], rules: list[Unique | Reference], size: int = KEYS_A_TASK) -> DataFrame:
    """rule, key and n: a key that several rows have, and how many; or one that nothing refers to, and how many rows have it.

    Keys are compared as texts, so columns of two number types match. The sides of references meet by key in one aggregation, without a join. Keys are dealt to
    as many tasks as their number asks for, so that a task holds about `size`, however large the tables are; rows of one key are counted in parts first.
    """
    families = _families(rules)
    place = {s: (f, k) for f, family in enumerate(families) for k, s in enumerate(family)}
    rows, total = None, None
    for table in dict.fromkeys(t for t, _ in place):
        part = keys(tables[table], {f"{f}_{k}": columns for (t, columns), (f, k) in place.items() if t == table})
        held = tables[table].select(F.lit(sum(t == table for t, _ in place)).alias("n")).groupBy("n").count()
        rows, total = (part, held) if rows is None else (rows.unionByName(part), total.unionByName(held))
    n = max(1, -(-(total.select(F.sum(F.col("n") * F.col("count"))).first()[0] or 0) // size))
    at = F.split("slot", "_")
    dealt = rows.select(at[0].cast("int").alias("family"), at[1].cast("int").alias("side"), "key", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    counts = dealt.repartition(n, "family", "key", "salt").groupBy("family", "key", "salt", "side").agg(F.count("*").alias("n"))
    of = [F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(max(map(len, families)))]
    met = counts.repartition(n, "family", "key").groupBy("family", "key").agg(*of)
    found = []
    for rule in rules:
        f, own = place[rule.table, rule.columns]
        broken = F.col(f"n{own}") > (1 if isinstance(rule, Unique) else 0)
        if isinstance(rule, Reference):
            broken = broken & (F.col(f"n{place[rule.target, rule.target_columns][1]}") == 0)
        key = F.to_json(F.array("key")) if len(rule.columns) == 1 else F.col("key")
        found.append(F.when((F.col("family") == f) & broken, F.struct(F.lit(rule.name).alias("rule"), key.alias("key"), F.col(f"n{own}").alias("n"))))
    return met.select(F.inline(F.array_compact(F.array(*found))))
