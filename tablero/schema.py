"""Declared schemas and the fixed values of the domain.

No reader of this library infers a schema: every stored table has its columns, types and keys written down here, and the
integrity rules in :mod:`tablero.plans.quality` are generated from the same declarations.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------------------------------
CHALLENGE_DAYS = 21
RATING_SCALE = 3

ENUMS = {
    "permisos_coach": ["Administrador", "Coach", "Inactivo"],
    "sexos": ["Mujer", "Hombre"],
    "unidades": ["Kg", "cm", "%", "U"],
    "tipo_foto": ["Frente", "Perfil", "Posterior"],
    "estado_foto": ["Inicial", "Final"],
    "tipo_actividad": ["Ceremonia", "Charla Alimentación", "Charla Motivación", "Fit Camp"],
}

RATING_WORDS = {
    -3: "Mucho Peor",
    -2: "Peor",
    -1: "Ligeramente Peor",
    0: "Igual",
    1: "Ligeramente Mejor",
    2: "Mejor",
    3: "Mucho Mejor",
}

CONCEPT_WEIGHTS = [("Actividades", "0.10"), ("Habitos", "0.45"), ("Calificacion", "0.45")]
HABIT_WEIGHTS = [
    ("Desayuno", "0.12"),
    ("Media Mañana", "0.12"),
    ("Almuerzo", "0.12"),
    ("Media Tarde", "0.12"),
    ("Cena", "0.12"),
    ("Hidratación", "0.20"),
    ("Actividad Física", "0.20"),
]
CRITERION_WEIGHTS = [("Variación de Peso", "0.30"), ("Variación de Medidas", "0.30"), ("Apariencia Física", "0.40")]
PARAMETER_UNITS = [("Peso", "Kg"), ("Medida Cintura", "cm")]

PATTERNS = {
    "nombre": r"^.{3,}\s.{3}",
    "usuario": r'^[a-zA-Z0-9!¡/@#$¿?%^&*"\[\]\{\}<>\(\)=\-_´+`~:;,.€\|]{4,}$',
    "celular": r"^\d{9}$",
    "email": r"(?i)^[A-Za-z0-9._%-]+@[A-Za-z0-9.-]+[.][A-Za-z]+$",
}

CEREMONY = "Ceremonia"
INACTIVE = "Inactivo"
ADMIN = "Administrador"
HABITS, ACTIVITIES, RATINGS = "Habitos", "Actividades", "Calificacion"
# ----------------------------------------------------------------------------------------------------------------------

WEIGHT = T.DecimalType(3, 2)
_STR, _LONG, _INT, _DATE, _BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.BooleanType()
_NTZ, _DBL = T.TimestampNTZType(), T.DoubleType()


def _struct(*cols: tuple) -> T.StructType:
    """Columns as (name, type) or (name, type, True) when null is allowed."""
    return T.StructType([T.StructField(c[0], c[1], len(c) > 2) for c in cols])


SCHEMAS: dict[str, T.StructType] = {
    "coaches": _struct(
        ("id_coach", _LONG), ("nombre_coach", _STR), ("user_coach", _STR), ("num_celular_coach", _STR, True),
        ("email_coach", _STR, True), ("permiso", _STR), ("notificacion_correo", _BOOL)),
    "retadores": _struct(
        ("id_retador", _LONG), ("nombre_retador", _STR), ("fecha_nacimiento", _DATE, True), ("sexo", _STR, True),
        ("num_celular_retador", _STR), ("talla", WEIGHT, True), ("nombre_coach", _STR)),
    "retos": _struct(
        ("id_reto", _LONG), ("nombre_reto", _STR), ("fecha_ini", _DATE), ("fecha_fin_excl", _DATE), ("reto_activo", _BOOL)),
    "participacion": _struct(
        ("id_participacion", _LONG), ("nombre_reto", _STR), ("nombre_retador", _STR), ("objetivo_participacion", _STR, True)),
    "parametros": _struct(("id_parametro", _INT), ("nombre_parametro", _STR), ("unidad", _STR)),
    "registros_parametros": _struct(
        ("id_registro_parametro", _LONG), ("id_participacion", _LONG), ("nombre_parametro", _STR),
        ("valor_inicial", _DBL), ("valor_final", _DBL, True)),
    "fotos": _struct(
        ("id_foto", _LONG), ("id_participacion", _LONG), ("tipo", _STR), ("estado", _STR), ("archivo", _STR),
        ("fecha_registro", _DATE), ("nombre_coach", _STR)),
    "conceptos": _struct(("id_concepto", _INT), ("concepto", _STR), ("peso_concepto", WEIGHT)),
    "actividades": _struct(
        ("id_actividad", _LONG), ("actividad", _STR), ("inicio", _NTZ), ("fin", _NTZ), ("nombre_reto", _STR),
        ("tema_actividad", _STR), ("coach_expositor", _STR)),
    "registros_actividades": _struct(
        ("id_registro_actividad", _LONG), ("id_participacion", _LONG), ("id_actividad", _LONG), ("concepto", _STR),
        ("nombre_coach", _STR), ("fecha_registro", _DATE)),
    "habitos": _struct(("id_habito", _INT), ("nombre_habito", _STR), ("peso_habito", WEIGHT)),
    "registros_habitos": _struct(
        ("id_registro_habito", _LONG), ("id_participacion", _LONG), ("fecha_ocurrencia", _DATE), ("nombre_habito", _STR),
        ("concepto", _STR), ("nombre_coach", _STR), ("fecha_registro", _DATE)),
    "criterios_calificacion": _struct(
        ("id_criterio_calificacion", _INT), ("criterio_calificacion", _STR), ("peso_criterio", WEIGHT)),
    "registros_calificaciones": _struct(
        ("id_registro_calificacion", _LONG), ("id_participacion", _LONG), ("criterio_calificacion", _STR), ("nombre_coach", _STR), ("calificacion", _INT),
        ("concepto", _STR), ("fecha_registro", _DATE)),
}

PRIMARY_KEYS = {
    "coaches": "id_coach", "retadores": "id_retador", "retos": "id_reto", "participacion": "id_participacion",
    "parametros": "id_parametro", "registros_parametros": "id_registro_parametro", "fotos": "id_foto",
    "conceptos": "id_concepto", "actividades": "id_actividad", "registros_actividades": "id_registro_actividad",
    "habitos": "id_habito", "registros_habitos": "id_registro_habito",
    "criterios_calificacion": "id_criterio_calificacion", "registros_calificaciones": "id_registro_calificacion",
}

UNIQUE_KEYS = [
    ("coaches", ["nombre_coach"]),
    ("coaches", ["user_coach"]),
    ("retadores", ["nombre_retador"]),
    ("retadores", ["num_celular_retador"]),
    ("retos", ["nombre_reto"]),
    ("participacion", ["nombre_reto", "nombre_retador"]),
    ("parametros", ["nombre_parametro"]),
    ("registros_parametros", ["id_participacion", "nombre_parametro"]),
    ("fotos", ["id_participacion", "tipo", "estado"]),
    ("conceptos", ["concepto"]),
    ("registros_actividades", ["id_participacion", "id_actividad"]),
    ("habitos", ["nombre_habito"]),
    ("registros_habitos", ["id_participacion", "fecha_ocurrencia", "nombre_habito"]),
    ("criterios_calificacion", ["criterio_calificacion"]),
    ("registros_calificaciones", ["id_participacion", "criterio_calificacion", "nombre_coach"]),
]

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("retadores", "nombre_coach", "coaches", "nombre_coach"),
    ("participacion", "nombre_reto", "retos", "nombre_reto"),
    ("participacion", "nombre_retador", "retadores", "nombre_retador"),
    ("registros_parametros", "id_participacion", "participacion", "id_participacion"),
    ("registros_parametros", "nombre_parametro", "parametros", "nombre_parametro"),
    ("fotos", "id_participacion", "participacion", "id_participacion"),
    ("fotos", "nombre_coach", "coaches", "nombre_coach"),
    ("actividades", "nombre_reto", "retos", "nombre_reto"),
    ("actividades", "coach_expositor", "coaches", "nombre_coach"),
    ("registros_actividades", "id_participacion", "participacion", "id_participacion"),
    ("registros_actividades", "id_actividad", "actividades", "id_actividad"),
    ("registros_actividades", "concepto", "conceptos", "concepto"),
    ("registros_actividades", "nombre_coach", "coaches", "nombre_coach"),
    ("registros_habitos", "id_participacion", "participacion", "id_participacion"),
    ("registros_habitos", "nombre_habito", "habitos", "nombre_habito"),
    ("registros_habitos", "concepto", "conceptos", "concepto"),
    ("registros_habitos", "nombre_coach", "coaches", "nombre_coach"),
    ("registros_calificaciones", "id_participacion", "participacion", "id_participacion"),
    ("registros_calificaciones", "criterio_calificacion", "criterios_calificacion", "criterio_calificacion"),
    ("registros_calificaciones", "concepto", "conceptos", "concepto"),
    ("registros_calificaciones", "nombre_coach", "coaches", "nombre_coach"),
]

ENUM_COLUMNS = [
    ("coaches", "permiso", "permisos_coach"),
    ("retadores", "sexo", "sexos"),
    ("parametros", "unidad", "unidades"),
    ("fotos", "tipo", "tipo_foto"),
    ("fotos", "estado", "estado_foto"),
    ("actividades", "actividad", "tipo_actividad"),
]

WEIGHT_TABLES = [
    ("conceptos", "concepto", "peso_concepto"),
    ("habitos", "nombre_habito", "peso_habito"),
    ("criterios_calificacion", "criterio_calificacion", "peso_criterio"),
]

LOG_CONCEPTS = [
    ("registros_actividades", ACTIVITIES),
    ("registros_habitos", HABITS),
    ("registros_calificaciones", RATINGS),
]

FORMAT_RULES = [
    ("coaches", "nombre_coach", "nombre"),
    ("coaches", "user_coach", "usuario"),
    ("coaches", "num_celular_coach", "celular"),
    ("coaches", "email_coach", "email"),
    ("retadores", "nombre_retador", "nombre"),
    ("retadores", "num_celular_retador", "celular"),
]
