"""Changes of keys through the whole graph of references: deletions that are refused while something refers to the row, and renames that reach every
child."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablero.operators.spread import spread_join
from tablero.operators.stored import stored
from tablero.schema import FOREIGN_KEYS, PRIMARY_KEYS
from tablero.sources.tables import Tables

#: Tables with few rows that many rows refer to.
CATALOGUES = ("conceptos", "habitos", "criterios_calificacion", "parametros")


def children_first() -> list[str]:
    """All tables, each after those that refer to it."""
    order: list[str] = []
    left = list(PRIMARY_KEYS)
    while left:
        free = [p for p in left if all(child in order for child, _, parent, _ in FOREIGN_KEYS if parent == p)]
        order += free
        left = [p for p in left if p not in free]
    return order


class Deleted(NamedTuple):
    """The tables after the deletion, the rows that went (tabla, clave) and those that stayed, with what refers to them in ``motivos``."""

    tables: Tables
    deleted: DataFrame
    rejected: DataFrame


def delete_restricted(t: Tables, batch: dict[str, DataFrame]) -> Deleted:
    """Deletes the listed rows (per table its primary key), unless a row that stays refers to them.

    A row may go together with everything that refers to it. References form no cycle between tables, so deciding the tables from the children
    up is the fixpoint: what is left of a child blocks its parents. References shrink to their different values before they meet the
    parents, so a parent with any number of children is one row. Listed keys that do not exist are ignored.
    """
    left: dict[str, DataFrame] = {}
    gone, kept = [], []
    for table in children_first():
        key = PRIMARY_KEYS[table]
        if table not in batch:
            continue
        rows = t[table].join(batch[table].select(key).distinct(), key, "left_semi")
        marks = []
        for child, column, parent, parent_column in FOREIGN_KEYS:
            if parent == table:
                mark = f"_por{len(marks)}"
                used = left.get(child, t[child]).select(F.col(column).alias(parent_column)).distinct().withColumn(mark, F.lit(f"{child}.{column}"))
                rows = rows.join(used, parent_column, "left")
                marks.append(mark)
        judged = stored(rows.select(key, F.concat_ws(",", *marks).alias("motivos")))
        accepted = judged.filter("motivos = ''").select(key)
        left[table] = t[table].join(accepted, key, "left_anti").select(*t[table].columns)
        name = [F.lit(table).alias("tabla"), F.col(key).cast("string").alias("clave")]
        gone.append(accepted.select(*name))
        kept.append(judged.filter("motivos <> ''").select(*name, "motivos"))
    return Deleted(t.replace(**left), reduce(DataFrame.unionByName, gone), reduce(DataFrame.unionByName, kept))


def composed(renames: DataFrame) -> DataFrame:
    """(tabla, columna, viejo, nuevo): where each name ends that steps of renames (tabla, columna, paso, viejo, nuevo) begin with.

    All renames of one step happen at once, so a swap is one step; steps follow each other, so a name may be renamed again under its new name.
    Every rename points to the next one of the name that it gives, and pointer jumping composes a path of 2^k steps in k rounds.
    """
    name = ["tabla", "columna"]
    rows = stored(renames.select(*name, F.col("paso").cast("long").alias("paso"), "viejo", "nuevo").distinct().withColumn("_id", F.monotonically_increasing_id()))
    # On the line of a name: it is given in some steps and taken in others; the first taking after a giving continues it.
    events = rows.select(*name, F.col("nuevo").alias("_n"), "paso", F.col("_id").alias("_da"), F.lit(None).cast("long").alias("_toma")).unionByName(
        rows.select(*name, F.col("viejo").alias("_n"), "paso", F.lit(None).cast("long").alias("_da"), F.col("_id").alias("_toma")))
    later = Window.partitionBy(*name, "_n").orderBy("paso").rangeBetween(1, Window.unboundedFollowing)
    taking = F.when(F.col("_toma").isNotNull(), F.struct("paso", F.col("_toma").alias("id")))
    line = events.withColumn("_sigue", F.min(taking).over(later)["id"])
    follow = line.filter(F.col("_da").isNotNull()).select(F.col("_da").alias("_id"), "_sigue")
    now = stored(rows.join(follow, "_id").select("_id", "nuevo", "_sigue"))
    while not now.filter(F.col("_sigue").isNotNull()).isEmpty():
        onward = now.select(F.col("_id").alias("_sigue"), F.col("nuevo").alias("_fin"), F.col("_sigue").alias("_lejos"))
        now = stored(now.join(onward, "_sigue", "left").select("_id", F.coalesce("_fin", "nuevo").alias("nuevo"), F.col("_lejos").alias("_sigue")))
    # A name that existed before starts with its first taking, unless it was given before.
    given = rows.groupBy(*name, F.col("nuevo").alias("viejo")).agg(F.min("paso").alias("_dado"))
    starts = rows.groupBy(*name, "viejo").agg(F.min(F.struct("paso", "_id")).alias("_m"))
    own = starts.join(given, [*name, "viejo"], "left").filter(F.col("_dado").isNull() | (F.col("_dado") >= F.col("_m.paso")))
    return own.select(*name, "viejo", F.col("_m._id").alias("_id")).join(now.select("_id", "nuevo"), "_id").select(*name, "viejo", "nuevo")


def rename_keys(t: Tables, renames: DataFrame) -> Tables:
    """All tables after renames of referred keys (tabla, columna, paso, viejo, nuevo): the parent's column and every column that refers to it.

    Steps are composed first (:func:`composed`); then each table is rewritten once, for all its columns.
    """
    ends = stored(composed(renames))
    keys = list(dict.fromkeys((parent, column) for _, _, parent, column in FOREIGN_KEYS))
    changed = {}
    for table in PRIMARY_KEYS:
        columns = {column: (table, column) for p, column in keys if p == table}
        columns |= {column: (parent, parent_column) for child, column, parent, parent_column in FOREIGN_KEYS if child == table}
        rows, new = t[table], {}
        for n, (column, (parent, parent_column)) in enumerate(columns.items()):
            own = ends.filter((F.col("tabla") == parent) & (F.col("columna") == parent_column))
            text: Column = F.col("viejo").cast(t[table].schema[column].dataType).alias(column)
            names = own.select(text, F.col("nuevo").cast(t[table].schema[column].dataType).alias(f"_nuevo{n}"))
            # A log has few catalogue entries, often one: a key alone would gather its rows, and one that Spark knows to be constant leaves no key at all.
            rows = spread_join(rows, names, [column], [PRIMARY_KEYS[table]], "left") if parent in CATALOGUES else rows.join(names, column, "left")
            new[column] = F.coalesce(f"_nuevo{n}", column)
        changed[table] = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in t[table].columns])
    return t.replace(**changed)
