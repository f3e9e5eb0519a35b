"""Constraint checks over the persisted tables: one row per constraint with its number of violations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CHECKS, FOREIGN_KEYS, UNIQUE


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, constraint_name, violations) of all constraints whose tables are given; nulls fulfil
    checks and keys, as in SQL.

    Every table is read once: a row becomes one entry (constraint, key, counts) per constraint that it takes part in,
    and one exchange of entries that are summed before it serves checks, unique keys and references alike, so a key
    that many rows share costs no task more than its partial sums.
    """
    named = [(t, name) for t in tables for name in CHECKS.get(t, {})]
    keys = [(t, "unique_" + "_".join(k), k) for t, df in tables.items() for k in UNIQUE.get(t, ()) if set(k) <= set(df.columns)]
    references = [(c, f"fk_{column}", column, p) for c, column, p in FOREIGN_KEYS if c in tables and p in tables]
    number = {x[:2]: i for i, x in enumerate([*named, *keys, *references])}
    if not number:
        raise ValueError("no constraint concerns these tables")

    def entry(of: tuple[str, str], key: Column | None = None, bad: Column | int = 0, own: int = 0, parent: int = 0) -> Column:
        count = lambda n, c: (n if isinstance(n, Column) else F.lit(n)).cast("long").alias(c)
        key = F.lit(None).cast("array<string>") if key is None else key
        return F.struct(F.lit(number[of]).alias("i"), key.alias("key"), count(bad, "bad"), count(own, "own"), count(parent, "parent"))

    def key_of(columns: tuple[str, ...]) -> Column:
        """The key's values, and null where one is."""
        return F.when(reduce(and_, [F.col(c).isNotNull() for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))

    found = []
    for t, df in tables.items():
        broken = [entry((t, name), bad=F.coalesce((~F.expr(rule)).cast("long"), F.lit(0))) for name, rule in CHECKS.get(t, {}).items()]
        made = [F.array(*broken)] if broken else []
        keyed = [entry(k[:2], key_of(k[2]), own=1) for k in keys if k[0] == t]
        keyed += [entry(r[:2], key_of((r[2],)), own=1) for r in references if r[0] == t] + [entry(r[:2], key_of(("id",)), parent=1) for r in references if r[3] == t]
        if keyed:
            made.append(F.filter(F.array(*keyed), lambda e: e["key"].isNotNull()))
        if made:
            found.append(df.select(F.explode(F.concat(*made)).alias("e")).select("e.*"))
    sums = reduce(DataFrame.unionByName, found).groupBy("i", "key").agg(*[F.sum(c).alias(c) for c in ("bad", "own", "parent")])
    is_reference, is_key = F.col("i") >= len(named) + len(keys), F.col("i") >= len(named)
    bad = F.when(is_reference, F.when(F.col("parent") == 0, F.col("own")).otherwise(0)).when(is_key, (F.col("own") > 1).cast("long")).otherwise(F.col("bad"))
    counted = sums.groupBy("i").agg(F.sum(bad).alias("n"))
    names = tables[next(iter(tables))].sparkSession.createDataFrame([(i, t, c) for (t, c), i in number.items()], "i int, table_name string, constraint_name string")
    return names.join(counted, "i", "left").select("table_name", "constraint_name", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Children whose parent does not exist."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def cascade(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents in ``deleted`` (column id) and all that depends on them; an invoice
    keeps its other references when its vendor goes, as that one is set to null."""
    kept = dict(tables)
    if "documents" in kept:
        kept["documents"] = kept["documents"].join(deleted.select("id"), "id", "left_anti")
    for child, column, parent in FOREIGN_KEYS:
        if child in kept and parent in kept and (child, column) != ("invoices", "vendor_id"):
            rows = kept[child]
            kept[child] = rows.join(kept[parent].select(F.col("id").alias(column)), column, "left_semi").select(*rows.columns)
    return kept
