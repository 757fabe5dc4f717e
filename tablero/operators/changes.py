"""Row changes as table operators: (target, changes) -> new target.

No path is overwritten while it is read: each function returns the new table and the caller writes it to a new place with
:func:`tablero.sources.tables.save`. Keys are joined by shuffle or, for change sets that Spark measures as small, by broadcast;
nothing here fixes that choice.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.functions.dates import from_utc
from tablero.functions.text import challenge_name, rating_code
from tablero.operators.running import number_rows
from tablero.operators.spread import spread_join
from tablero.schema import ACTIVITIES, ADMIN, CHALLENGE_DAYS, HABITS, RATINGS


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like`` in its order and types; those that ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def _with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def _joined(
    target: DataFrame, changes: DataFrame, key: list[str], columns: list[str], order: list[str] | None = None
) -> DataFrame:
    """Target rows beside the new values of their key in ``_n_*``; ``_hay`` is true where there are any.

    Of several changes for one key the first in ``order`` counts, by default the one with the smallest values.
    """
    new = first_by(changes.select(*dict.fromkeys([*key, *columns, *(order or [])])), key, order or columns).select(
        *[F.col(c).alias(f"_k_{c}") for c in key], *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hay"))
    return target.join(new, reduce(and_, [F.col(c) == F.col(f"_k_{c}") for c in key]), "left")


def _replaced(target: DataFrame, columns: list[str], special: dict[str, Column] | None = None) -> list[Column]:
    """The target's columns after :func:`_joined`: new values where there are any, or the given expression."""
    special = special or {}
    return [
        (special[f.name] if f.name in special
         else F.when(F.col("_hay"), F.col(f"_n_{f.name}")).otherwise(F.col(f.name)) if f.name in columns
         else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in target.schema]


def insert_rows(
    target: DataFrame, new: DataFrame, id_col: str | None, key: list[str], defaults: dict[str, Column] | None = None
) -> DataFrame:
    """Target and new rows. New ids follow the largest one; ``key`` must tell the new rows apart.

    Only the new rows are numbered, in buckets of their key's digest, so a large batch does not pass through one task.
    """
    rows = _with_defaults(new, defaults or {})
    if id_col is not None:
        last = target.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
        rows = number_rows(rows.drop(id_col), key, id_col, after=last)
    return target.unionByName(_typed(rows, target))


def update_rows(
    target: DataFrame, changes: DataFrame, key: list[str], columns: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """New values for the rows whose key is in ``changes``; a null there is a new value too. Of repeated keys the first in
    ``order`` counts."""
    columns = columns or [c for c in changes.columns if c not in key]
    return _joined(target, changes, key, columns, order).select(*_replaced(target, columns))


def delete_rows(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return target.join(keys.select(*key), key, "left_anti").select(*target.columns)


def delete_keyset(
    target: DataFrame, keys: DataFrame, key: list[str], me: str | None = None, role: str = ADMIN
) -> DataFrame:
    """Removes every row that matches a listed key; without administrator rights only the user's own rows."""
    listed = keys.select(*key)
    if role == ADMIN:
        return delete_rows(target, listed, key)
    return delete_rows(target, listed.withColumn("nombre_coach", F.lit(me)), [*key, "nombre_coach"])


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``. Aggregated on the map side, so a key with many copies is no burden."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    picked = df.groupBy(*key).agg(F.min(ranked).alias("_fila"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_fila.{c}").alias(c) for c in df.columns])


def upsert_update(
    target: DataFrame,
    changes: DataFrame,
    key: list[str],
    columns: list[str],
    id_col: str | None = None,
    defaults: dict[str, Column] | None = None,
    stamp: tuple[str, Column] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Updates rows that match on ``key`` and inserts the others. Matched rows keep their id. Of several changes for one key the
    first in ``order`` counts, by default the one with the smallest values.

    ``stamp`` names a date column that is set on update when the coach stays the same.
    """
    special = {}
    if stamp is not None:
        name, today = stamp
        coach = F.col("_n_nombre_coach" if "nombre_coach" in columns else "_k_nombre_coach")
        special[name] = F.when(F.col("_hay") & (coach == F.col("nombre_coach")), today).otherwise(F.col(name))
    kept = _joined(target, changes, key, columns, order).select(*_replaced(target, columns, special))
    added = first_by(changes, key, order or columns).join(target.select(*key), key, "left_anti")
    return insert_rows(kept, added, id_col, key, defaults)


def upsert_measurements(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Saves measurements; rows without a first value are not saved."""
    key = ["id_participacion", "nombre_parametro"]
    return upsert_update(
        target, changes.dropna(subset=["valor_inicial"]), key, ["valor_inicial", "valor_final"], "id_registro_parametro")


def upsert_skip_existing(
    target: DataFrame,
    changes: DataFrame,
    key: list[str],
    id_col: str | None = None,
    order: list[str] | None = None,
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds the changes whose key is not there yet; of several with one key the first in ``order`` wins."""
    fresh = changes.join(target.select(*key), key, "left_anti")
    if order:
        fresh = first_by(fresh, key, order)
    return insert_rows(target, fresh, id_col, key, defaults)


def save_checklist(
    target: DataFrame, grid: DataFrame, key: list[str], id_col: str, concept: str, me: str, as_of: date, role: str = ADMIN
) -> DataFrame:
    """Saves an edited checklist (key columns and ``registro``): ticked rows are added if missing, unticked ones removed."""
    ticked = grid.filter("registro").select(*key).distinct().withColumn("nombre_coach", F.lit(me))
    saved = upsert_skip_existing(
        target, ticked, key, id_col, defaults={"concepto": F.lit(concept), "fecha_registro": F.lit(as_of)})
    return delete_keyset(saved, grid.filter(~F.col("registro")), key, me, role)


def save_habits(target: DataFrame, grid: DataFrame, me: str, as_of: date, role: str = ADMIN) -> DataFrame:
    """Checklist of habits by participation and day."""
    key = ["id_participacion", "fecha_ocurrencia", "nombre_habito"]
    return save_checklist(target, grid, key, "id_registro_habito", HABITS, me, as_of, role)


def save_attendance(target: DataFrame, grid: DataFrame, me: str, as_of: date, role: str = ADMIN) -> DataFrame:
    """Checklist of attendance by participation and activity."""
    key = ["id_participacion", "id_actividad"]
    return save_checklist(target, grid, key, "id_registro_actividad", ACTIVITIES, me, as_of, role)


def save_ratings(
    target: DataFrame,
    grid: DataFrame,
    as_of: date,
    strict_criterion: bool = False,
    id_col: str | None = "id_registro_calificacion",
) -> DataFrame:
    """Saves edited ratings (id_participacion, nombre_coach, criterio_calificacion, calificacion as a word or null).

    A blank criterion removes *all* ratings of that coach for that participation, the ones just saved included. With
    ``strict_criterion`` it removes only its own row.
    """
    key = ["id_participacion", "nombre_coach", "criterio_calificacion"]
    coded = grid.withColumn("calificacion", rating_code(F.col("calificacion")))
    saved = upsert_update(
        target, coded.dropna(subset=["calificacion"]).select(*key, "calificacion"), key, ["calificacion"], id_col,
        {"concepto": F.lit(RATINGS), "fecha_registro": F.lit(as_of)}, ("fecha_registro", F.lit(as_of)))
    blank = grid.filter(F.col("calificacion").isNull())
    return delete_rows(saved, blank, key if strict_criterion else key[:2])


def upsert_photos(target: DataFrame, changes: DataFrame, as_of: date) -> DataFrame:
    """Saves photos by participation, kind and state: bytes and coach are replaced, the date only if the coach is the same."""
    return upsert_update(
        target, changes, ["id_participacion", "tipo", "estado"], ["archivo", "nombre_coach"], "id_foto",
        {"fecha_registro": F.lit(as_of)}, ("fecha_registro", F.lit(as_of)))


def guarded_changes(changes: DataFrame, owners: DataFrame, key: str, me: str, role: str) -> DataFrame:
    """Changes marked as accepted or not: administrators may change all rows, others those of their own challengers."""
    owner = owners.select(key, F.col("nombre_coach").alias("_duenio"))
    allowed = F.lit(role == ADMIN) | F.coalesce(F.col("_duenio") == me, F.lit(False))
    return changes.join(owner, key, "left").select(
        *changes.columns, allowed.alias("aceptado"), F.when(~allowed, "registro de otro coach").alias("motivo"))


def cascade_rename(child: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    """Child rows under the new key of their parent; ``renames`` has (viejo, nuevo), each old key once."""
    names = renames.select(F.col("viejo").alias("_viejo"), F.col("nuevo").alias("_nuevo"))
    by = [c for c in child.columns if c != column]
    spread = spread_join(child.withColumn("_viejo", F.col(column)), first_by(names, ["_viejo"], ["_nuevo"]), ["_viejo"], by or [column], "left")
    return spread.select(*[
        F.coalesce("_nuevo", column).alias(column) if c == column else F.col(c) for c in child.columns])


def normalize_alerts(coaches: DataFrame) -> DataFrame:
    """No e-mail alerts for coaches without an address."""
    return coaches.withColumn("notificacion_correo", F.col("email_coach").isNotNull() & F.col("notificacion_correo"))


def challenge_rows(starts: DataFrame, days: int = CHALLENGE_DAYS) -> DataFrame:
    """New or re-dated challenges from their first day (``fecha_inicio``): name, days and, unless given, active."""
    active = F.col("reto_activo") if "reto_activo" in starts.columns else F.lit(True)
    kept = [c for c in starts.columns if c not in ("fecha_inicio", "reto_activo", "nombre_reto")]
    return starts.select(
        *kept, challenge_name(F.col("fecha_inicio"), days).alias("nombre_reto"), F.col("fecha_inicio").alias("fecha_ini"),
        F.date_add("fecha_inicio", days).alias("fecha_fin_excl"), active.alias("reto_activo"))


def activity_rows(entries: DataFrame) -> DataFrame:
    """Activities from form rows with ``inicio`` in UTC and ``duracion`` in minutes: both ends on the Lima clock."""
    start = from_utc(F.col("inicio"))
    end = F.timestamp_add("SECOND", F.round(F.col("duracion") * 60).cast("int"), start)
    kept = [c for c in entries.columns if c not in ("inicio", "duracion")]
    return entries.select(*kept, start.alias("inicio"), end.alias("fin"))
