"""Integrity rules as jobs that list violations: (rule, tabla, clave, detalle), all text.

Each rule reads the tables as they are and returns an empty list for sound ones. Conditions that are null are no violation, as
with check constraints. No rule forms pairs of rows.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.functions.dates import in_days, is_minor
from tablero.operators.overlap import overlap_counts, overlap_witness
from tablero.operators.spread import FEW_SLOTS, spread_join
from tablero.operators.stored import stored
from tablero.schema import (
    CEREMONY,
    ENUM_COLUMNS,
    ENUMS,
    FOREIGN_KEYS,
    FORMAT_RULES,
    LOG_CONCEPTS,
    PATTERNS,
    PRIMARY_KEYS,
    RATING_SCALE,
    SCHEMAS,
    UNIQUE_KEYS,
    WEIGHT_TABLES,
)
from tablero.sources.tables import Tables

COLUMNS = ["rule", "tabla", "clave", "detalle"]
MAX_HEIGHT = 2


def _text(*columns: str | Column) -> Column:
    """Key columns as one text; null parts show as NULL."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts])


def _key(table: str, df: DataFrame) -> Column:
    """The primary key of a row, or its unique key where the table has no identity column."""
    own = PRIMARY_KEYS.get(table)
    if own in df.columns:
        return _text(own)
    return _text(*next(cols for name, cols in UNIQUE_KEYS if name == table))


def _found(df: DataFrame, rule: str, table: str, detail: Column, key: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(table).alias("tabla"), (_key(table, df) if key is None else key).alias("clave"),
        detail.cast("string").alias("detalle"))


def _all(t: Tables, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return t.spark.createDataFrame([], "rule string, tabla string, clave string, detalle string")
    return reduce(DataFrame.unionByName, parts)


def dq_duplicates(t: Tables, *, tables: tuple[str, ...] | None = None, as_of: date | None = None) -> DataFrame:
    """Key values that occur more than once, with how often."""
    keys: dict[str, list[list[str]]] = {}
    for table, columns in [(table, [column]) for table, column in PRIMARY_KEYS.items()] + UNIQUE_KEYS:
        if tables is None or table in tables:
            keys.setdefault(table, []).append(columns)
    parts = []
    for table, sets in keys.items():
        # One pass over the table for all its keys: (rule, key values) are counted.
        values = F.array(*[
            F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]), F.struct(
                F.lit("dq_duplicates:" + ",".join(columns)).alias("rule"), F.array(*[F.col(c).cast("string") for c in columns]).alias("clave")))
            for columns in sets])
        counted = t[table].select(F.inline(F.filter(values, lambda v: v.isNotNull()))).groupBy("rule", "clave").agg(F.count(F.lit(1)).alias("_n"))
        parts.append(counted.filter("_n > 1").select(
            "rule", F.lit(table).alias("tabla"), F.concat_ws("|", "clave").alias("clave"), F.col("_n").cast("string").alias("detalle")))
    return _all(t, parts)


def dq_orphans(t: Tables, *, tables: tuple[str, ...] | None = None, as_of: date | None = None) -> DataFrame:
    """Rows that refer to a parent that does not exist, with the missing value. What is missing is found and written to the session's shared folder while
    this is called."""
    found = []
    for table in dict.fromkeys(rule[0] for rule in FOREIGN_KEYS):
        if tables is not None and table not in tables:
            continue
        # The child shrinks to its different references, one row per key and value however often it is used; few of them, if any, are missing.
        rules = [rule for rule in FOREIGN_KEYS if rule[0] == table]
        value = [F.struct(F.lit(n).alias("_regla"), F.col(column).cast("string").alias("detalle")) for n, (_, column, _, _) in enumerate(rules)]
        known = reduce(DataFrame.unionByName, [
            t[parent].select(F.lit(n).alias("_regla"), F.col(parent_column).cast("string").alias("detalle")) for n, (_, _, parent, parent_column) in enumerate(rules)])
        rows = t[table].select(_key(table, t[table]).alias("clave"), F.inline(F.filter(F.array(*value), lambda v: v.detalle.isNotNull())))
        lost = rows.select("_regla", "detalle").distinct().join(known, ["_regla", "detalle"], "left_anti").select(F.lit(table).alias("tabla"), "_regla", "detalle")
        names = F.array(*[F.lit(f"dq_orphans:{column}->{parent}") for _, column, parent, _ in rules])
        found.append((table, names, rows, lost))
    if not found:
        return _all(t, [])
    # What is missing is few values, but one of them, or a known one, may be named by most rows. As a table of its own its size is known: small, it is
    # broadcast and no row moves or is sorted; else both sides come straight from a shuffle, where Spark can divide a heavy key.
    missing = stored(reduce(DataFrame.unionByName, [lost for *_, lost in found]))
    return _all(t, [
        rows.join(missing.filter(F.col("tabla") == table).drop("tabla"), ["_regla", "detalle"]).select(names[F.col("_regla")].alias("rule"), F.lit(table).alias("tabla"), "clave", "detalle")
        for table, names, rows, _ in found])


def dq_nulls(t: Tables, *, tables: tuple[str, ...] | None = None, as_of: date | None = None) -> DataFrame:
    """Rows with null in a column that must have a value, one line per column. One pass per table."""
    parts = []
    for table, schema in SCHEMAS.items():
        if tables is not None and table not in tables:
            continue
        df = t[table]
        required = [f.name for f in schema if not f.nullable and f.name in df.columns]
        empty = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull())
        parts.append(_found(df.withColumn("_vacia", F.explode(empty)), "dq_nulls", table, F.col("_vacia")))
    return _all(t, parts)


def dq_weight_sum(t: Tables, *, tables: tuple[str, ...] | None = None, as_of: date | None = None) -> DataFrame:
    """Weights outside 0..1, and weight tables whose sum, to two decimals, exceeds 1. A sum below 1 is accepted."""
    parts = []
    for table, name, weight in WEIGHT_TABLES:
        if tables is not None and table not in tables:
            continue
        value = F.col(weight).cast("decimal(18,2)")
        parts.append(_found(
            t[table].filter(~F.col(weight).between(0, 1)), "dq_weight_sum:rango", table, value, _text(name)))
        total = t[table].agg(F.round(F.sum(weight), 2).cast("decimal(18,2)").alias("_suma")).filter("_suma > 1")
        parts.append(_found(total, "dq_weight_sum:suma", table, F.col("_suma"), F.lit("total")))
    return _all(t, parts)


def dq_format(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Names, users, phones and e-mail addresses that do not have the required form."""
    parts = []
    for table in dict.fromkeys(rule[0] for rule in FORMAT_RULES):
        rules = [(column, form) for name, column, form in FORMAT_RULES if name == table]
        wrong = F.array(*[
            F.when(~F.col(column).rlike(PATTERNS[form]), F.struct(F.lit(column).alias("_columna"), F.col(column).alias("_valor")))
            for column, form in rules])
        df = t[table].withColumn("_mal", F.explode(F.filter(wrong, lambda w: w.isNotNull())))
        parts.append(_found(df, "dq_format", table, F.concat(F.col("_mal._columna"), F.lit("="), F.col("_mal._valor"))))
    return _all(t, parts)


def dq_rating_range(t: Tables, *, as_of: date | None = None, escala: int = RATING_SCALE) -> DataFrame:
    """Ratings outside the scale."""
    rows = t.registros_calificaciones.filter(~F.col("calificacion").between(-escala, escala))
    return _found(rows, "dq_rating_range", "registros_calificaciones", F.col("calificacion"))


def dq_component(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Log rows booked under another component than that of their table."""
    return _all(t, [
        _found(t[table].filter(F.col("concepto") != concept), "dq_component", table, F.col("concepto"))
        for table, concept in LOG_CONCEPTS])


def dq_activity_overlap(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Activities that share an instant with another one of their challenge, with how many. Touching ends count."""
    counted = overlap_counts(t.actividades, "nombre_reto", "inicio", "fin")
    return _found(counted.filter("solapes > 0"), "dq_activity_overlap", "actividades", F.col("solapes"))


def activity_witness(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Activities that overlap another one of their challenge, with one such activity."""
    rows = t.actividades if reto is None else t.actividades.filter(F.col("nombre_reto") == reto)
    return overlap_witness(rows.select("id_actividad", "nombre_reto", "inicio", "fin"), "nombre_reto", "inicio", "fin", "id_actividad")


def dq_activity_range(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Activities, ceremonies aside, not wholly inside their challenge."""
    joined = spread_join(t.actividades, t.retos.select("nombre_reto", "fecha_ini", "fecha_fin_excl"), ["nombre_reto"], ["id_actividad"])
    inside = (F.col("inicio") >= F.col("fecha_ini").cast("timestamp_ntz")) & (
        F.col("fin") < F.col("fecha_fin_excl").cast("timestamp_ntz"))
    rows = joined.filter(~inside & (F.col("actividad") != CEREMONY))
    return _found(rows, "dq_activity_range", "actividades", F.date_format("fin", "yyyy-MM-dd HH:mm:ss"))


def habit_reasons(as_of: date) -> Column:
    """Why a habit row joined with its challenge may not be logged: a list, empty when it may."""
    inside = in_days(F.col("fecha_ocurrencia"), F.col("fecha_ini"), F.col("fecha_fin_excl"))
    reasons = F.array(
        F.when(~inside, F.lit("fuera_de_reto")), F.when(F.col("fecha_ocurrencia") > F.lit(as_of), F.lit("fecha_futura")))
    return F.filter(reasons, lambda r: r.isNotNull())


def with_challenge(t: Tables, logs: DataFrame) -> DataFrame:
    """Log rows with the days and the active flag of their challenge."""
    return logs.join(dated_people(t), "id_participacion")


def dated_people(t: Tables) -> DataFrame:
    """Participations with the days and the active flag of their challenge."""
    return spread_join(
        t.participacion.select("id_participacion", "nombre_reto"),
        t.retos.select("nombre_reto", "fecha_ini", "fecha_fin_excl", "reto_activo"), ["nombre_reto"], ["id_participacion"])


def dq_habit_range(t: Tables, *, as_of: date) -> DataFrame:
    """Habits dated outside their challenge or after the given day; a row can be both."""
    rows = with_challenge(t, t.registros_habitos).withColumn("_motivo", F.explode(habit_reasons(as_of)))
    detail = F.concat(F.col("_motivo"), F.lit("="), F.col("fecha_ocurrencia").cast("string"))
    return _found(rows, "dq_habit_range", "registros_habitos", detail)


def dq_attendance_reto(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Attendance of an activity of another challenge."""
    held = t.actividades.select("id_actividad", F.col("nombre_reto").alias("_reto_actividad"))
    people = t.participacion.select("id_participacion", "nombre_reto")
    attended = t.registros_actividades.join(people, "id_participacion")
    rows = spread_join(attended, held, ["id_actividad"], ["id_participacion"], slots=FEW_SLOTS).filter(F.col("_reto_actividad") != F.col("nombre_reto"))
    return _found(rows, "dq_attendance_reto", "registros_actividades", F.concat_ws(" <> ", "_reto_actividad", "nombre_reto"))


def _active_enrolments(t: Tables) -> DataFrame:
    """Distinct (challenge, challenger) over active challenges. Duplicates go first, while both columns share the work."""
    active = t.retos.filter("reto_activo").select("nombre_reto")
    members = t.participacion.select("nombre_reto", "nombre_retador").distinct()
    return spread_join(members, active, ["nombre_reto"], ["nombre_retador"])


def _multi_active(t: Tables) -> DataFrame:
    return _active_enrolments(t).groupBy("nombre_retador").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def dq_multi_active(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Challengers in more than one active challenge, with how many."""
    return _found(_multi_active(t), "dq_multi_active", "participacion", F.col("_n"), F.col("nombre_retador"))


def challenger_sets(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                    retador: str | None = None) -> DataFrame:
    """Members of each active challenge, one per row, and whether another active challenge shares them."""
    rows = _active_enrolments(t).join(_multi_active(t), "nombre_retador", "left").select(
        "nombre_reto", "nombre_retador", F.col("_n").isNotNull().alias("compartido"))
    if reto is not None:
        rows = rows.filter(F.col("nombre_reto") == reto)
    if retador is not None:
        rows = rows.filter(F.col("nombre_retador") == retador)
    return rows


#: Challenges of one person that meet each other in one task.
BLOCK = 256


def shared_pairs(t: Tables, *, as_of: date | None = None, reto: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of active challenges that share members, each once, with how many.

    A person with more than ``block`` challenges has them dealt into blocks, and each pair of blocks is a key of its own, so the pairs of such a
    person are formed by many tasks. They are counted before they are shuffled.
    """
    members = _active_enrolments(t)
    crowd = members.groupBy("nombre_retador").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_bloques")).filter("_bloques > 1")
    dealt = members.join(crowd, "nombre_retador", "left").withColumn("_bloques", F.coalesce("_bloques", F.lit(1)))
    own = dealt.withColumn("_mio", F.pmod(F.xxhash64("nombre_reto"), F.col("_bloques")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_bloques") - 1))
    one = own.select("nombre_retador", F.col("_mio").alias("_i"), every.alias("_j"), "nombre_reto")
    two = own.select("nombre_retador", every.alias("_i"), F.col("_mio").alias("_j"), F.col("nombre_reto").alias("otro_reto"))
    pairs = one.join(two, ["nombre_retador", "_i", "_j"]).filter("nombre_reto < otro_reto")
    if reto is not None:
        pairs = pairs.filter((F.col("nombre_reto") == reto) | (F.col("otro_reto") == reto))
    return pairs.groupBy("nombre_reto", "otro_reto").agg(F.count(F.lit(1)).alias("compartidos"))


def dq_shared_challengers(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Members an active challenge has in common with another active one."""
    rows = challenger_sets(t).filter("compartido")
    return _found(rows, "dq_shared_challengers", "retos", F.col("nombre_retador"), F.col("nombre_reto"))


#: Tables that may not change while their challenge is inactive.
FROZEN = ("participacion", "fotos", "actividades", "registros_actividades", "registros_habitos", "registros_calificaciones")


def dq_inactive(t: Tables, *, tables: tuple[str, ...] = FROZEN, as_of: date | None = None) -> DataFrame:
    """Rows that belong to inactive challenges, whose data must not change."""
    idle = t.retos.filter(~F.col("reto_activo")).select("nombre_reto")
    people = spread_join(t.participacion.select("id_participacion", "nombre_reto"), idle, ["nombre_reto"], ["id_participacion"])
    parts = []
    for table in tables:
        df = t[table]
        if "nombre_reto" in df.columns:
            rows = spread_join(df, idle, ["nombre_reto"], [PRIMARY_KEYS[table]])
        else:
            rows = df.join(people, "id_participacion")
        parts.append(_found(rows, "dq_inactive", table, F.col("nombre_reto")))
    return _all(t, parts)


def dq_height(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Heights, in metres, that cannot be."""
    rows = t.retadores.filter((F.col("talla") < 0) | (F.col("talla") > MAX_HEIGHT))
    return _found(rows, "dq_height", "retadores", F.col("talla"))


def dq_minor(t: Tables, *, as_of: date) -> DataFrame:
    """Challengers under age."""
    rows = t.retadores.filter(is_minor(F.col("fecha_nacimiento"), as_of))
    return _found(rows, "dq_minor", "retadores", F.col("fecha_nacimiento"))


def dq_domain(t: Tables, *, as_of: date | None = None) -> DataFrame:
    """Values outside the list of their enumerated column."""
    return _all(t, [
        _found(t[table].filter(~F.col(column).isin(ENUMS[domain])), f"dq_domain:{domain}", table, F.col(column))
        for table, column, domain in ENUM_COLUMNS])


def delete_blocked(t: Tables, *, parent: str | None = None, as_of: date | None = None, reto: str | None = None,
                   retador: str | None = None) -> DataFrame:
    """Rows of parent tables that still have children and so cannot be deleted."""
    parts = []
    for name in dict.fromkeys(rule[2] for rule in FOREIGN_KEYS):
        if parent is not None and name != parent:
            continue
        for column in dict.fromkeys(rule[3] for rule in FOREIGN_KEYS if rule[2] == name):
            used = reduce(DataFrame.union, [
                t[child].select(F.col(child_column).alias(column)).distinct()
                for child, child_column, p, p_column in FOREIGN_KEYS if (p, p_column) == (name, column)])
            held = t[name].join(used, column, "left_semi")
            parts.append(held.select(F.lit(name).alias("tabla"), _text(column).alias("clave")))
    return reduce(DataFrame.unionByName, parts)


RULES = {
    f.__name__: f
    for f in (
        dq_duplicates, dq_orphans, dq_nulls, dq_weight_sum, dq_format, dq_rating_range, dq_component, dq_activity_overlap,
        dq_activity_range, dq_habit_range, dq_attendance_reto, dq_multi_active, dq_shared_challengers, dq_inactive, dq_height,
        dq_minor, dq_domain)
}
