"""SQL for the checking engine, one text per query key, over the same Parquet tables.

The texts are written from the rules of the domain, step by step and with plain joins, and do not follow the plans of the
library: counts are taken per name, totals by window, overlaps by comparing activities with each other.
"""

from __future__ import annotations

from tablero.schema import (
    ENUM_COLUMNS,
    ENUMS,
    FOREIGN_KEYS,
    FORMAT_RULES,
    PATTERNS,
    PRIMARY_KEYS,
    RATING_WORDS,
    SCHEMAS,
    UNIQUE_KEYS,
)
from tablero.sources.testdata import duckdb_ctes

AS_OF = "DATE '2024-01-25'"

# Which raw view stands in for a table in the integrity rules.
RAW = {
    "retadores": "raw_retadores",
    "participacion": "raw_participacion",
    "actividades": "raw_actividades",
    "registros_habitos": "raw_habitos",
    "registros_actividades": "raw_registros_actividades",
    "registros_calificaciones": "raw_registros_calificaciones",
}


def _q(views: str, body: str, extra: str = "") -> str:
    """``WITH`` the named views, then further CTEs, then the query."""
    return duckdb_ctes(*views.split()) + (",\n" + extra.strip() if extra else "") + "\n" + body.strip()


def _raw(table: str) -> str:
    return RAW.get(table, table)


def _text(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in columns) + ")"


def _key(table: str) -> str:
    if table in PRIMARY_KEYS:
        return _text(PRIMARY_KEYS[table])
    return _text(*next(cols for name, cols in UNIQUE_KEYS if name == table))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _word(code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {v} THEN '{w}'" for v, w in RATING_WORDS.items()) + " END"


# Every log row with its worth: hundredths of a habit, stars times hundredths of a criterion, one for an attendance.
WORTH = """
programadas AS (SELECT nombre_reto, count(*) AS cuantas FROM actividades WHERE actividad <> 'Ceremonia' GROUP BY nombre_reto),
calificadores AS (SELECT CAST(count(*) AS DOUBLE) AS cuantos FROM coaches WHERE permiso <> 'Inactivo'),
valores AS (
  SELECT id_participacion, l.concepto, fecha_ocurrencia AS dia, CAST(100 * peso_habito AS BIGINT) AS valor
  FROM registros_habitos l JOIN habitos h ON h.nombre_habito = l.nombre_habito
  UNION ALL
  SELECT id_participacion, l.concepto, NULL, calificacion * CAST(100 * peso_criterio AS BIGINT)
  FROM registros_calificaciones l JOIN criterios_calificacion k ON k.criterio_calificacion = l.criterio_calificacion
  UNION ALL
  SELECT id_participacion, concepto, NULL, 1 FROM registros_actividades),
personas AS (
  SELECT p.nombre_reto, p.nombre_retador, v.concepto, v.dia, CAST(sum(v.valor) AS DOUBLE) AS valor
  FROM valores v JOIN participacion p ON p.id_participacion = v.id_participacion GROUP BY ALL),
puntos AS (
  SELECT x.nombre_reto, x.nombre_retador, x.concepto, x.dia, CAST(peso_concepto AS DOUBLE) * CASE x.concepto
      WHEN 'Habitos' THEN valor / 21
      WHEN 'Calificacion' THEN valor / (3 * (SELECT cuantos FROM calificadores))
      ELSE 100 * valor / cuantas END AS puntaje
  FROM personas x JOIN conceptos c ON c.concepto = x.concepto LEFT JOIN programadas n ON n.nombre_reto = x.nombre_reto
  WHERE x.concepto <> 'Actividades' OR cuantas > 0)"""

SCORES = WORTH + """,
puntajes AS (
  SELECT nombre_reto, nombre_retador, concepto, sum(puntaje) AS bruto, greatest(sum(puntaje), 0) AS puntaje FROM puntos
  GROUP BY nombre_reto, nombre_retador, concepto),
totales AS (
  SELECT nombre_reto, nombre_retador, round(sum(puntaje), 6) AS total FROM puntajes GROUP BY nombre_reto, nombre_retador),
tablero AS (
  SELECT p.*, total FROM puntajes p JOIN totales t ON t.nombre_reto = p.nombre_reto AND t.nombre_retador = p.nombre_retador)"""

# A slot that a person attends counts once, on the day it ends; ratings count on the last day.
DAYS = WORTH + """,
dias AS (
  SELECT nombre_reto, nombre_retador, concepto, dia AS fecha_ocurrencia, puntaje FROM puntos WHERE concepto = 'Habitos'
  UNION ALL
  SELECT p.nombre_reto, nombre_retador, concepto, CAST(fecha_fin_excl - 1 AS DATE), puntaje
  FROM puntos p JOIN retos r ON r.nombre_reto = p.nombre_reto WHERE concepto = 'Calificacion'
  UNION ALL
  SELECT s.nombre_reto, nombre_retador, 'Actividades', CAST(fin AS DATE), CAST(peso_concepto AS DOUBLE) * 100 / cuantas
  FROM (SELECT DISTINCT p.nombre_reto, nombre_retador, inicio, fin FROM registros_actividades l
        JOIN participacion p ON p.id_participacion = l.id_participacion JOIN actividades a ON a.id_actividad = l.id_actividad) s
    JOIN programadas n ON n.nombre_reto = s.nombre_reto JOIN conceptos c ON c.concepto = 'Actividades')"""

RATES = f"""
cifras AS (
  SELECT id_reto, nombre_reto, least({AS_OF} + 1, fecha_fin_excl) - fecha_ini AS dias,
    (SELECT count(*) FROM participacion p WHERE p.nombre_reto = r.nombre_reto) AS gente,
    (SELECT count(*) FROM actividades a WHERE a.nombre_reto = r.nombre_reto AND actividad <> 'Ceremonia'
       AND CAST(inicio AS DATE) <= {AS_OF}) AS sesiones,
    (SELECT nullif(count(*), 0) FROM registros_habitos l JOIN participacion p ON p.id_participacion = l.id_participacion
       WHERE p.nombre_reto = r.nombre_reto) AS marcas,
    (SELECT nullif(count(*), 0) FROM registros_actividades l JOIN participacion p ON p.id_participacion = l.id_participacion
       WHERE p.nombre_reto = r.nombre_reto) AS asistencias
  FROM retos r WHERE reto_activo),
tasas AS (
  SELECT id_reto, nombre_reto, dias, gente, CAST((20000 * marcas + tope) // (2 * tope) AS DOUBLE) / 10000 AS habitos,
    CAST((20000 * asistencias + plazas) // (2 * plazas) AS DOUBLE) / 10000 AS actividades
  FROM (SELECT *, nullif(gente * dias * (SELECT count(*) FROM habitos), 0) AS tope, nullif(gente * sesiones, 0) AS plazas
        FROM cifras WHERE gente > 0) q)"""

MEASURES = """
medidas AS (
  SELECT p.id_participacion, q.nombre_parametro AS parametro, r.valor_inicial AS inicial, r.valor_final AS final, q.unidad AS und
  FROM participacion p JOIN parametros q ON q.id_parametro > 0
    LEFT JOIN registros_parametros r ON r.id_participacion = p.id_participacion AND r.nombre_parametro = q.nombre_parametro)"""

NEW_IDS = "(SELECT coalesce(max({id}), 0) FROM {target}) + row_number() OVER (ORDER BY md5({key}))"


def _new_id(id_col: str, target: str, *key: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in key) + ")"
    return f"CAST({NEW_IDS.format(id=id_col, target=target, key=text)} AS BIGINT) AS {id_col}"


# What the triggers of the log tables refuse: reasons as (condition, name), over x (the change), p (participation) and r (challenge).
DAY_RULE = [
    ("x.registro AND NOT (x.fecha_ocurrencia >= r.fecha_ini AND x.fecha_ocurrencia < r.fecha_fin_excl)", "fuera_de_reto"),
    (f"x.registro AND r.nombre_reto IS NOT NULL AND x.fecha_ocurrencia > {AS_OF}", "fecha_futura"),
]
PLACE_RULE = [
    ("x.registro AND NOT EXISTS (SELECT 1 FROM actividades a WHERE a.id_actividad = x.id_actividad)", "actividad_desconocida"),
    ("x.registro AND EXISTS (SELECT 1 FROM actividades a WHERE a.id_actividad = x.id_actividad AND a.nombre_reto <> p.nombre_reto)",
     "actividad_de_otro_reto"),
]


def _judged(batch: str, rules: list[tuple[str, str]] | None = None) -> str:
    """CTEs ``juzgado`` (the batch with its reasons) and ``valido`` (what no rule refuses)."""
    every = [("r.nombre_reto IS NULL", "participacion_desconocida"), ("NOT r.reto_activo", "reto_inactivo"), *(rules or [])]
    reasons = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for condition, name in every)
    return f"""
juzgado AS (
  SELECT x.*, concat_ws(',', {reasons}) AS motivos FROM {batch} x
    LEFT JOIN participacion p ON p.id_participacion = x.id_participacion LEFT JOIN retos r ON r.nombre_reto = p.nombre_reto),
valido AS (SELECT * FROM juzgado WHERE motivos = '')"""


def _rules() -> dict[str, str]:
    """The integrity rules over the raw views."""
    everything = " ".join(dict.fromkeys([_raw(name) for name in SCHEMAS] + list(SCHEMAS)))
    duplicates, orphans, nulls, formats, domains = [], [], [], [], []
    for table, cols in [(name, [c]) for name, c in PRIMARY_KEYS.items()] + UNIQUE_KEYS:
        present = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        duplicates.append(
            f"SELECT 'dq_duplicates:{','.join(cols)}' AS rule, '{table}' AS tabla, {_text(*cols)} AS clave,"
            f" CAST(count(*) AS VARCHAR) AS detalle FROM {_raw(table)} WHERE {present} GROUP BY {', '.join(cols)} HAVING count(*) > 1")
    for table, column, parent, parent_column in FOREIGN_KEYS:
        orphans.append(
            f"SELECT 'dq_orphans:{column}->{parent}' AS rule, '{table}' AS tabla, {_key(table)} AS clave,"
            f" CAST({column} AS VARCHAR) AS detalle FROM {_raw(table)} WHERE {column} IS NOT NULL AND NOT EXISTS"
            f" (SELECT 1 FROM {_raw(parent)} x WHERE x.{parent_column} = {_raw(table)}.{column})")
    for table, schema in SCHEMAS.items():
        for f in schema:
            if not f.nullable:
                nulls.append(
                    f"SELECT 'dq_nulls' AS rule, '{table}' AS tabla, {_key(table)} AS clave, '{f.name}' AS detalle"
                    f" FROM {_raw(table)} WHERE {f.name} IS NULL")
    for table, column, form in FORMAT_RULES:
        formats.append(
            f"SELECT 'dq_format' AS rule, '{table}' AS tabla, {_key(table)} AS clave, concat('{column}=', {column}) AS detalle"
            f" FROM {_raw(table)} WHERE NOT regexp_matches({column}, {_quoted(PATTERNS[form])})")
    for table, column, domain in ENUM_COLUMNS:
        known = ", ".join(_quoted(v) for v in ENUMS[domain])
        domains.append(
            f"SELECT 'dq_domain:{domain}' AS rule, '{table}' AS tabla, {_key(table)} AS clave, {column} AS detalle"
            f" FROM {_raw(table)} WHERE {column} NOT IN ({known})")
    union = "\nUNION ALL\n"
    active_members = """
miembros AS (SELECT DISTINCT nombre_reto, nombre_retador FROM raw_participacion JOIN retos USING (nombre_reto) WHERE reto_activo)"""
    return {
        "dq_duplicates": _q(everything, union.join(duplicates)),
        "dq_orphans": _q(everything, union.join(orphans)),
        "dq_nulls": _q(everything, union.join(nulls)),
        "dq_format": _q("coaches raw_retadores", union.join(formats)),
        "dq_domain": _q("coaches raw_retadores parametros fotos raw_actividades", union.join(domains)),
        "dq_weight_sum": _q("raw_pesos conceptos criterios_calificacion", """
SELECT 'dq_weight_sum:rango' AS rule, 'habitos' AS tabla, nombre_habito AS clave, CAST(peso_habito AS VARCHAR) AS detalle
FROM raw_pesos WHERE peso_habito < 0 OR peso_habito > 1
UNION ALL
SELECT 'dq_weight_sum:suma', 'habitos', 'total', CAST(CAST(sum(peso_habito) AS DECIMAL(18,2)) AS VARCHAR) FROM raw_pesos
HAVING sum(peso_habito) > 1
UNION ALL
SELECT 'dq_weight_sum:rango', 'conceptos', concepto, CAST(peso_concepto AS VARCHAR) FROM conceptos
WHERE peso_concepto < 0 OR peso_concepto > 1
UNION ALL
SELECT 'dq_weight_sum:suma', 'conceptos', 'total', CAST(CAST(sum(peso_concepto) AS DECIMAL(18,2)) AS VARCHAR) FROM conceptos
HAVING sum(peso_concepto) > 1
UNION ALL
SELECT 'dq_weight_sum:rango', 'criterios_calificacion', criterio_calificacion, CAST(peso_criterio AS VARCHAR) FROM criterios_calificacion
WHERE peso_criterio < 0 OR peso_criterio > 1
UNION ALL
SELECT 'dq_weight_sum:suma', 'criterios_calificacion', 'total', CAST(CAST(sum(peso_criterio) AS DECIMAL(18,2)) AS VARCHAR)
FROM criterios_calificacion HAVING sum(peso_criterio) > 1"""),
        "dq_rating_range": _q("raw_registros_calificaciones", f"""
SELECT 'dq_rating_range' AS rule, 'registros_calificaciones' AS tabla, {_key('registros_calificaciones')} AS clave,
  CAST(calificacion AS VARCHAR) AS detalle
FROM raw_registros_calificaciones WHERE calificacion < -3 OR calificacion > 3"""),
        "dq_component": _q("raw_registros_actividades raw_habitos raw_registros_calificaciones", f"""
SELECT 'dq_component' AS rule, 'registros_actividades' AS tabla, {_key('registros_actividades')} AS clave, concepto AS detalle
FROM raw_registros_actividades WHERE concepto <> 'Actividades'
UNION ALL
SELECT 'dq_component', 'registros_habitos', {_key('registros_habitos')}, concepto FROM raw_habitos WHERE concepto <> 'Habitos'
UNION ALL
SELECT 'dq_component', 'registros_calificaciones', {_key('registros_calificaciones')}, concepto
FROM raw_registros_calificaciones WHERE concepto <> 'Calificacion'"""),
        "dq_activity_overlap": _q("raw_actividades", """
SELECT 'dq_activity_overlap' AS rule, 'actividades' AS tabla, CAST(a.id_actividad AS VARCHAR) AS clave,
  CAST(count(*) AS VARCHAR) AS detalle
FROM raw_actividades a JOIN raw_actividades b
  ON a.nombre_reto = b.nombre_reto AND a.id_actividad <> b.id_actividad AND a.inicio <= b.fin AND b.inicio <= a.fin
GROUP BY a.id_actividad"""),
        "dq_activity_range": _q("raw_actividades retos", """
SELECT 'dq_activity_range' AS rule, 'actividades' AS tabla, CAST(id_actividad AS VARCHAR) AS clave,
  strftime(fin, '%Y-%m-%d %H:%M:%S') AS detalle
FROM raw_actividades JOIN retos USING (nombre_reto)
WHERE actividad <> 'Ceremonia' AND (inicio < CAST(fecha_ini AS TIMESTAMP) OR fin >= CAST(fecha_fin_excl AS TIMESTAMP))"""),
        "dq_habit_range": _q("raw_habitos participacion retos", f"""
SELECT 'dq_habit_range' AS rule, 'registros_habitos' AS tabla, CAST(id_registro_habito AS VARCHAR) AS clave,
  concat('fuera_de_reto=', CAST(fecha_ocurrencia AS VARCHAR)) AS detalle
FROM raw_habitos JOIN participacion USING (id_participacion) JOIN retos USING (nombre_reto)
WHERE NOT (fecha_ocurrencia >= fecha_ini AND fecha_ocurrencia < fecha_fin_excl)
UNION ALL
SELECT 'dq_habit_range', 'registros_habitos', CAST(id_registro_habito AS VARCHAR),
  concat('fecha_futura=', CAST(fecha_ocurrencia AS VARCHAR))
FROM raw_habitos JOIN participacion USING (id_participacion) JOIN retos USING (nombre_reto)
WHERE fecha_ocurrencia > {AS_OF}"""),
        "dq_attendance_reto": _q("raw_registros_actividades raw_actividades participacion", """
SELECT 'dq_attendance_reto' AS rule, 'registros_actividades' AS tabla, CAST(id_registro_actividad AS VARCHAR) AS clave,
  concat(a.nombre_reto, ' <> ', p.nombre_reto) AS detalle
FROM raw_registros_actividades r JOIN raw_actividades a ON r.id_actividad = a.id_actividad
  JOIN participacion p ON r.id_participacion = p.id_participacion
WHERE a.nombre_reto <> p.nombre_reto"""),
        "dq_multi_active": _q("raw_participacion retos", """
SELECT 'dq_multi_active' AS rule, 'participacion' AS tabla, nombre_retador AS clave,
  CAST(count(DISTINCT nombre_reto) AS VARCHAR) AS detalle
FROM raw_participacion JOIN retos USING (nombre_reto) WHERE reto_activo
GROUP BY nombre_retador HAVING count(DISTINCT nombre_reto) > 1"""),
        "dq_shared_challengers": _q("raw_participacion retos", """
SELECT 'dq_shared_challengers' AS rule, 'retos' AS tabla, m.nombre_reto AS clave, m.nombre_retador AS detalle
FROM miembros m WHERE EXISTS (
  SELECT 1 FROM miembros o WHERE o.nombre_retador = m.nombre_retador AND o.nombre_reto <> m.nombre_reto)""", active_members),
        "challenger_sets": _q("raw_participacion retos", """
SELECT m.nombre_reto, m.nombre_retador, EXISTS (
  SELECT 1 FROM miembros o WHERE o.nombre_retador = m.nombre_retador AND o.nombre_reto <> m.nombre_reto) AS compartido
FROM miembros m""", active_members),
        "dq_inactive": _q(
            "raw_habitos raw_registros_actividades raw_registros_calificaciones raw_actividades fotos participacion retos",
            union.join(
                f"SELECT 'dq_inactive' AS rule, '{table}' AS tabla, CAST(x.{key} AS VARCHAR) AS clave, r.nombre_reto AS detalle FROM {view} x"
                + (" JOIN participacion p ON p.id_participacion = x.id_participacion" if person else "")
                + f" JOIN retos r ON r.nombre_reto = {'p' if person else 'x'}.nombre_reto WHERE NOT reto_activo"
                for table, view, key, person in (
                    ("participacion", "participacion", "id_participacion", False), ("fotos", "fotos", "id_foto", True),
                    ("actividades", "raw_actividades", "id_actividad", False),
                    ("registros_actividades", "raw_registros_actividades", "id_registro_actividad", True),
                    ("registros_habitos", "raw_habitos", "id_registro_habito", True),
                    ("registros_calificaciones", "raw_registros_calificaciones", "id_registro_calificacion", True)))),
        "dq_height": _q("raw_retadores", """
SELECT 'dq_height' AS rule, 'retadores' AS tabla, CAST(id_retador AS VARCHAR) AS clave, CAST(talla AS VARCHAR) AS detalle
FROM raw_retadores WHERE talla < 0 OR talla > 2"""),
        "dq_minor": _q("raw_retadores", f"""
SELECT 'dq_minor' AS rule, 'retadores' AS tabla, CAST(id_retador AS VARCHAR) AS clave, CAST(fecha_nacimiento AS VARCHAR) AS detalle
FROM raw_retadores WHERE ({AS_OF} - fecha_nacimiento) / 360.0 < 18"""),
    }


def _blocked() -> str:
    parts = []
    for parent, column in dict.fromkeys((rule[2], rule[3]) for rule in FOREIGN_KEYS):
        held = " OR ".join(
            f"{column} IN (SELECT {child_column} FROM {child})"
            for child, child_column, p, c in FOREIGN_KEYS if (p, c) == (parent, column))
        parts.append(f"SELECT '{parent}' AS tabla, {_text(column)} AS clave FROM {parent} WHERE {held}")
    return _q(" ".join(SCHEMAS), "\nUNION ALL\n".join(parts))


# The timetable, line by line: what is refused for itself, what meets a stored activity, and the walk from each admitted activity to the next.
TIMETABLE = """
mirado AS MATERIALIZED (
  SELECT l.*, row_number() OVER () AS fila, concat_ws(',',
    CASE WHEN r.nombre_reto IS NULL THEN 'reto_desconocido' END, CASE WHEN NOT r.reto_activo THEN 'reto_inactivo' END,
    CASE WHEN l.coach_expositor NOT IN (SELECT nombre_coach FROM coaches) THEN 'coach_desconocido' END,
    CASE WHEN l.inicio > l.fin THEN 'tiempo_invalido'
      WHEN l.actividad <> 'Ceremonia' AND (l.inicio < CAST(r.fecha_ini AS TIMESTAMP) OR l.fin >= CAST(r.fecha_fin_excl AS TIMESTAMP)) THEN 'fuera_de_reto' END) AS propios
  FROM lote_cronograma l LEFT JOIN retos r ON r.nombre_reto = l.nombre_reto),
sano AS MATERIALIZED (
  SELECT m.*, EXISTS (SELECT 1 FROM actividades a WHERE a.nombre_reto = m.nombre_reto AND a.inicio <= m.fin AND m.inicio <= a.fin) AS choca
  FROM mirado m WHERE propios = ''),
cabeza AS MATERIALIZED (
  SELECT nombre_reto, inicio, fin, fila FROM sano WHERE NOT choca
  QUALIFY row_number() OVER (PARTITION BY nombre_reto, inicio ORDER BY fin, actividad, tema_actividad, coach_expositor) = 1),
sigue AS MATERIALIZED (
  SELECT a.nombre_reto, a.inicio, b.inicio AS luego FROM cabeza a ASOF JOIN cabeza b ON b.nombre_reto = a.nombre_reto AND b.inicio > a.fin),
camino AS (
  SELECT nombre_reto, min(inicio) AS inicio FROM cabeza GROUP BY nombre_reto
  UNION ALL
  SELECT s.nombre_reto, s.luego FROM camino c JOIN sigue s ON s.nombre_reto = c.nombre_reto AND s.inicio = c.inicio),
admitido AS (SELECT fila FROM cabeza JOIN camino USING (nombre_reto, inicio))"""

ENROLMENTS = """
inscrito AS (SELECT p.nombre_reto, nombre_retador, reto_activo FROM participacion p JOIN retos r ON r.nombre_reto = p.nombre_reto),
mirado AS (
  SELECT l.*, concat_ws(',', CASE WHEN r.nombre_reto IS NULL THEN 'reto_desconocido' END, CASE WHEN NOT r.reto_activo THEN 'reto_inactivo' END,
    CASE WHEN l.nombre_retador NOT IN (SELECT nombre_retador FROM retadores) THEN 'retador_desconocido' END,
    CASE WHEN EXISTS (SELECT 1 FROM inscrito i WHERE i.nombre_reto = l.nombre_reto AND i.nombre_retador = l.nombre_retador) THEN 'ya_inscrito' END,
    CASE WHEN r.reto_activo AND EXISTS (SELECT 1 FROM inscrito i WHERE i.reto_activo AND i.nombre_reto <> l.nombre_reto AND i.nombre_retador = l.nombre_retador)
      THEN 'otro_reto_activo' END) AS propios
  FROM lote_altas l LEFT JOIN retos r ON r.nombre_reto = l.nombre_reto),
juzgada AS (
  SELECT *, CASE WHEN propios <> '' THEN propios
    WHEN row_number() OVER (PARTITION BY nombre_retador, propios = '' ORDER BY nombre_reto) > 1 THEN 'otra_inscripcion_del_lote' ELSE '' END AS motivos
  FROM mirado)"""

# Challenge by challenge in the order of their names, with the list of those activated so far.
ACTIVATIONS = """
dormido AS (
  SELECT nombre_reto, row_number() OVER (ORDER BY nombre_reto) AS turno FROM (SELECT DISTINCT l.nombre_reto FROM lote_activaciones l
    JOIN retos r ON r.nombre_reto = l.nombre_reto WHERE NOT reto_activo) d),
socio AS (SELECT DISTINCT p.nombre_reto, nombre_retador, reto_activo FROM raw_participacion p JOIN retos r ON r.nombre_reto = p.nombre_reto),
roce AS (SELECT DISTINCT a.nombre_reto, b.nombre_reto AS otro, b.reto_activo FROM socio a JOIN socio b ON a.nombre_retador = b.nombre_retador AND a.nombre_reto <> b.nombre_reto),
lista AS (
  SELECT d.nombre_reto, turno, coalesce(bool_or(roce.reto_activo), FALSE) AS preso, list(roce.otro) FILTER (roce.otro IS NOT NULL) AS vecinos
  FROM dormido d LEFT JOIN roce ON roce.nombre_reto = d.nombre_reto GROUP BY d.nombre_reto, turno),
paso AS (
  SELECT CAST(0 AS BIGINT) AS turno, CAST([] AS VARCHAR[]) AS van
  UNION ALL
  SELECT l.turno, CASE WHEN preso OR coalesce(list_has_any(vecinos, van), FALSE) THEN van ELSE list_append(van, l.nombre_reto) END
  FROM paso p JOIN lista l ON l.turno = p.turno + 1),
elegido AS (SELECT unnest(van) AS nombre_reto FROM (SELECT van FROM paso ORDER BY turno DESC LIMIT 1) f)"""


# Who leaves with everything that was logged; half of them keep ratings, and with them their enrolment and themselves.
LEAVING = {
    "registros_parametros": "id_participacion % 4 = 1", "fotos": "id_participacion % 4 = 1", "registros_actividades": "id_participacion % 4 = 1",
    "registros_habitos": "id_participacion % 4 = 1", "registros_calificaciones": "id_participacion % 8 = 1", "participacion": "id_participacion % 4 = 1",
    "retadores": "id_retador % 4 = 1", "retos": "id_reto > 4"}


def _departures(rejected: bool) -> str:
    """Rule by rule: a listed row stays if a row that stays refers to it; tables in the order in which they are decided."""
    ctes, parts = [], []
    for table, listed in LEAVING.items():
        key = PRIMARY_KEYS[table]
        reasons = []
        for child, column, parent, parent_column in FOREIGN_KEYS:
            if parent == table:
                source = f"queda_{child}" if child in LEAVING else child
                reasons.append(f"CASE WHEN EXISTS (SELECT 1 FROM {source} h WHERE h.{column} = x.{parent_column}) THEN '{child}.{column}' END")
        motive = f"concat_ws(',', {', '.join(reasons)})" if reasons else "''"
        ctes.append(f"juicio_{table} AS MATERIALIZED (SELECT x.*, {listed} AS pide, {motive} AS motivos FROM {table} x)")
        ctes.append(f"queda_{table} AS (SELECT * FROM juicio_{table} WHERE NOT pide OR motivos <> '')")
        parts.append(
            f"SELECT '{table}' AS tabla, CAST({key} AS VARCHAR) AS clave{', motivos' if rejected else ''} FROM juicio_{table}"
            f" WHERE pide AND motivos {'<>' if rejected else '='} ''")
    return _q(" ".join(SCHEMAS), "\nUNION ALL\n".join(parts), ",\n".join(ctes))


def _renamed() -> str:
    """The renames of the batch, written out by hand per kind of name."""
    final = {
        "retos": "CASE {c} WHEN 'Reto ASIA' THEN 'Reto EUROPE' WHEN 'Reto EUROPE' THEN 'Reto ASIA' WHEN 'Reto AFRICA' THEN 'Reto ASIA 2' ELSE {c} END",
        "retadores": "coalesce((SELECT concat({c}, CASE WHEN z.id_retador % 6 = 0 THEN ' III' WHEN z.id_retador % 3 = 0 THEN ' II' ELSE '' END)"
                     " FROM retadores z WHERE z.nombre_retador = x.{c}), {c})",
        "coaches": "coalesce((SELECT CASE WHEN z.id_coach % 2 = 0 THEN concat('Coach ', CAST(z.id_coach AS VARCHAR)) ELSE {c} END"
                   " FROM coaches z WHERE z.nombre_coach = x.{c}), {c})",
    }
    kind = {"nombre_reto": "retos", "nombre_retador": "retadores", "nombre_coach": "coaches", "coach_expositor": "coaches"}
    parts = [
        f"SELECT '{table}' AS tabla, '{f.name}' AS columna, {final[kind[f.name]].format(c=f.name)} AS nombre, count(*) AS n FROM {table} x GROUP BY ALL"
        for table, schema in SCHEMAS.items() for f in schema if f.name in kind]
    return _q(" ".join(SCHEMAS), "\nUNION ALL\n".join(parts))


def _in_turn(views: str, body: str, extra: str) -> str:
    """As :func:`_q`, with CTEs that refer to themselves."""
    return _q(views, body, extra).replace("WITH", "WITH RECURSIVE", 1)


def _admission() -> dict[str, str]:
    """Batches whose rows exclude each other."""
    timetable = "coaches retos actividades lote_cronograma"
    people = "participacion retos retadores lote_altas"
    groups = "raw_participacion retos lote_activaciones"
    return {
        "delete_restricted": _departures(False),
        "delete_restricted_rejected": _departures(True),
        "rename_keys": _renamed(),
        "shared_pairs": _q("raw_participacion retos", """
SELECT a.nombre_reto, b.nombre_reto AS otro_reto, count(*) AS compartidos FROM miembros a JOIN miembros b ON a.nombre_retador = b.nombre_retador
WHERE a.nombre_reto < b.nombre_reto GROUP BY ALL""", """
miembros AS (SELECT DISTINCT nombre_reto, nombre_retador FROM raw_participacion JOIN retos USING (nombre_reto) WHERE reto_activo)"""),
        "save_activities": _in_turn(timetable, f"""
SELECT id_actividad, actividad, inicio, fin, nombre_reto, tema_actividad, coach_expositor FROM actividades
UNION ALL
SELECT {_new_id('id_actividad', 'actividades', 'nombre_reto', 'inicio')}, actividad, inicio, fin, nombre_reto, tema_actividad, coach_expositor
FROM sano WHERE fila IN (SELECT fila FROM admitido)""", TIMETABLE),
        "save_activities_rejected": _in_turn(timetable, """
SELECT m.actividad, m.inicio, m.fin, m.nombre_reto, m.tema_actividad, m.coach_expositor,
  CASE WHEN propios <> '' THEN propios WHEN s.choca THEN 'solapa_guardada' ELSE 'solapa_lote' END AS motivos
FROM mirado m LEFT JOIN (SELECT fila, choca FROM sano) s ON s.fila = m.fila WHERE m.fila NOT IN (SELECT fila FROM admitido)""", TIMETABLE),
        "save_enrolments": _q(people, f"""
SELECT id_participacion, nombre_reto, nombre_retador, objetivo_participacion FROM participacion
UNION ALL
SELECT {_new_id('id_participacion', 'participacion', 'nombre_reto', 'nombre_retador')}, nombre_reto, nombre_retador, objetivo_participacion
FROM juzgada WHERE motivos = ''""", ENROLMENTS),
        "save_enrolments_rejected": _q(people, """
SELECT nombre_reto, nombre_retador, objetivo_participacion, motivos FROM juzgada WHERE motivos <> ''""", ENROLMENTS),
        "activate_challenges": _in_turn(groups, """
SELECT id_reto, nombre_reto, fecha_ini, fecha_fin_excl, reto_activo OR nombre_reto IN (SELECT nombre_reto FROM elegido) AS reto_activo FROM retos""", ACTIVATIONS),
        "activate_challenges_rejected": _in_turn(groups, """
SELECT l.nombre_reto, CASE WHEN r.nombre_reto IS NULL THEN 'reto_desconocido' ELSE 'retadores_compartidos' END AS motivos
FROM lote_activaciones l LEFT JOIN retos r ON r.nombre_reto = l.nombre_reto
WHERE r.nombre_reto IS NULL OR (NOT r.reto_activo AND l.nombre_reto NOT IN (SELECT nombre_reto FROM elegido))""", ACTIVATIONS),
    }


def _changes() -> dict[str, str]:
    """Results of the table operators on the change batches."""
    habit_cols = "id_registro_habito, id_participacion, fecha_ocurrencia, nombre_habito, concepto, nombre_coach, fecha_registro"
    return {
        "insert_rows": _q("participacion lote_inscripciones", f"""
SELECT id_participacion, nombre_reto, nombre_retador, objetivo_participacion FROM participacion
UNION ALL
SELECT {_new_id('id_participacion', 'participacion', 'nombre_reto', 'nombre_retador')}, nombre_reto, nombre_retador, NULL
FROM lote_inscripciones"""),
        "update_rows": _q("participacion lote_objetivos", """
SELECT p.id_participacion, nombre_reto, nombre_retador,
  CASE WHEN l.id_participacion IS NOT NULL THEN l.objetivo_participacion ELSE p.objetivo_participacion END AS objetivo_participacion
FROM participacion p LEFT JOIN lote_objetivos l ON p.id_participacion = l.id_participacion"""),
        "delete_rows": _q("participacion lote_bajas", """
SELECT id_participacion, nombre_reto, nombre_retador, objetivo_participacion FROM participacion
WHERE id_participacion NOT IN (SELECT id_participacion FROM lote_bajas)"""),
        "upsert_measurements": _q("registros_parametros lote_medidas", f"""
SELECT r.id_registro_parametro, r.id_participacion, r.nombre_parametro,
  CASE WHEN l.id_participacion IS NOT NULL THEN l.valor_inicial ELSE r.valor_inicial END AS valor_inicial,
  CASE WHEN l.id_participacion IS NOT NULL THEN l.valor_final ELSE r.valor_final END AS valor_final
FROM registros_parametros r LEFT JOIN lote l
  ON r.id_participacion = l.id_participacion AND r.nombre_parametro = l.nombre_parametro
UNION ALL
SELECT {_new_id('id_registro_parametro', 'registros_parametros', 'id_participacion', 'nombre_parametro')}, id_participacion,
  nombre_parametro, valor_inicial, valor_final
FROM lote WHERE NOT EXISTS (SELECT 1 FROM registros_parametros r
  WHERE r.id_participacion = lote.id_participacion AND r.nombre_parametro = lote.nombre_parametro)""",
            "lote AS (SELECT * FROM lote_medidas WHERE valor_inicial IS NOT NULL)"),
        "upsert_skip_existing": _q("base_habitos raw_habitos", f"""
SELECT {habit_cols} FROM base_habitos
UNION ALL
SELECT {_new_id('id_registro_habito', 'base_habitos', 'id_participacion', 'fecha_ocurrencia', 'nombre_habito')},
  id_participacion, fecha_ocurrencia, nombre_habito, concepto, nombre_coach, fecha_registro
FROM nuevas WHERE rn = 1""", """
nuevas AS (
  SELECT *, row_number() OVER (
    PARTITION BY id_participacion, fecha_ocurrencia, nombre_habito ORDER BY id_registro_habito) AS rn
  FROM raw_habitos h WHERE NOT EXISTS (SELECT 1 FROM base_habitos b WHERE b.id_participacion = h.id_participacion
    AND b.fecha_ocurrencia = h.fecha_ocurrencia AND b.nombre_habito = h.nombre_habito))"""),
        "delete_keyset": _q("registros_habitos lote_bajas", f"""
SELECT {habit_cols} FROM registros_habitos WHERE id_participacion NOT IN (SELECT id_participacion FROM lote_bajas)"""),
        "delete_keyset_own": _q("registros_habitos lote_bajas", f"""
SELECT {habit_cols} FROM registros_habitos
WHERE NOT (nombre_coach = 'Supplier#000000001' AND id_participacion IN (SELECT id_participacion FROM lote_bajas))"""),
        "save_ratings": _q("registros_calificaciones lote_calificaciones participacion retos", f"""
SELECT id_registro_calificacion, id_participacion, criterio_calificacion, nombre_coach, calificacion, concepto, fecha_registro FROM (
  SELECT r.id_registro_calificacion, r.id_participacion, r.criterio_calificacion, r.nombre_coach, coalesce(l.codigo, r.calificacion) AS calificacion,
    r.concepto, CASE WHEN l.codigo IS NOT NULL THEN {AS_OF} ELSE r.fecha_registro END AS fecha_registro
  FROM registros_calificaciones r LEFT JOIN lote l ON r.id_participacion = l.id_participacion
    AND r.nombre_coach = l.nombre_coach AND r.criterio_calificacion = l.criterio_calificacion
  UNION ALL
  SELECT {_new_id('id_registro_calificacion', 'registros_calificaciones', 'id_participacion', 'nombre_coach', 'criterio_calificacion')},
    id_participacion, criterio_calificacion, nombre_coach, codigo, 'Calificacion', {AS_OF} FROM lote
  WHERE NOT EXISTS (SELECT 1 FROM registros_calificaciones r WHERE r.id_participacion = lote.id_participacion
    AND r.nombre_coach = lote.nombre_coach AND r.criterio_calificacion = lote.criterio_calificacion)) s
WHERE NOT EXISTS (SELECT 1 FROM valido b WHERE b.calificacion IS NULL
  AND b.id_participacion = s.id_participacion AND b.nombre_coach = s.nombre_coach)""", _judged("lote_calificaciones") + """,
lote AS (
  SELECT id_participacion, nombre_coach, criterio_calificacion, CAST(CASE calificacion """
            + " ".join(f"WHEN '{w}' THEN {v}" for v, w in RATING_WORDS.items())
            + """ END AS INTEGER) AS codigo
  FROM valido WHERE calificacion IS NOT NULL)"""),
        "save_ratings_rejected": _q("lote_calificaciones participacion retos", """
SELECT id_participacion, nombre_coach, criterio_calificacion, calificacion, motivos FROM juzgado WHERE motivos <> ''""",
            _judged("lote_calificaciones")),
        "save_habits_rejected": _q("lote_checklist participacion retos", """
SELECT id_participacion, fecha_ocurrencia, nombre_habito, registro, motivos FROM juzgado WHERE motivos <> ''""", _judged("lote_checklist", DAY_RULE)),
        "save_attendance_rejected": _q("lote_asistencia participacion retos actividades", """
SELECT id_participacion, id_actividad, registro, motivos FROM juzgado WHERE motivos <> ''""", _judged("lote_asistencia", PLACE_RULE)),
        "upsert_photos_rejected": _q("lote_fotos participacion retos", """
SELECT id_participacion, tipo, estado, archivo, nombre_coach, motivos FROM juzgado WHERE motivos <> ''""", _judged("lote_fotos")),
        "save_habits": _q("registros_habitos lote_checklist participacion retos", f"""
SELECT {habit_cols} FROM (
  SELECT {habit_cols} FROM registros_habitos
  UNION ALL
  SELECT {_new_id('id_registro_habito', 'registros_habitos', 'id_participacion', 'fecha_ocurrencia', 'nombre_habito')},
    id_participacion, fecha_ocurrencia, nombre_habito, 'Habitos', 'Supplier#000000001', {AS_OF}
  FROM valido c WHERE registro AND NOT EXISTS (SELECT 1 FROM registros_habitos h
    WHERE h.id_participacion = c.id_participacion AND h.fecha_ocurrencia = c.fecha_ocurrencia
      AND h.nombre_habito = c.nombre_habito)) s
WHERE NOT (nombre_coach = 'Supplier#000000001' AND EXISTS (SELECT 1 FROM valido c WHERE NOT registro
  AND c.id_participacion = s.id_participacion AND c.fecha_ocurrencia = s.fecha_ocurrencia AND c.nombre_habito = s.nombre_habito))""",
            _judged("lote_checklist", DAY_RULE)),
        "save_attendance": _q("registros_actividades lote_asistencia participacion retos actividades", f"""
SELECT id_registro_actividad, id_participacion, id_actividad, concepto, nombre_coach, fecha_registro FROM (
  SELECT id_registro_actividad, id_participacion, id_actividad, concepto, nombre_coach, fecha_registro FROM registros_actividades
  UNION ALL
  SELECT {_new_id('id_registro_actividad', 'registros_actividades', 'id_participacion', 'id_actividad')},
    id_participacion, id_actividad, 'Actividades', 'Supplier#000000001', {AS_OF}
  FROM valido c WHERE registro AND NOT EXISTS (SELECT 1 FROM registros_actividades r
    WHERE r.id_participacion = c.id_participacion AND r.id_actividad = c.id_actividad)) s
WHERE NOT EXISTS (SELECT 1 FROM valido c WHERE NOT registro
  AND c.id_participacion = s.id_participacion AND c.id_actividad = s.id_actividad)""", _judged("lote_asistencia", PLACE_RULE)),
        "challenge_rows": _q("lote_inicios", """
SELECT concat('Reto del ', strftime(fecha_inicio, '%d/%m/%Y'), ' al ', strftime(CAST(fecha_inicio + 20 AS DATE), '%d/%m/%Y'))
    AS nombre_reto, fecha_inicio AS fecha_ini, CAST(fecha_inicio + 21 AS DATE) AS fecha_fin_excl, TRUE AS reto_activo
FROM lote_inicios"""),
        "activity_rows": _q("lote_actividades", """
SELECT id_actividad, tema_actividad, inicio - INTERVAL 5 HOUR AS inicio,
  inicio - INTERVAL 5 HOUR + INTERVAL 1 MINUTE * duracion AS fin FROM lote_actividades"""),
        "upsert_photos": _q("fotos lote_fotos participacion retos", f"""
SELECT f.id_foto, f.id_participacion, f.tipo, f.estado, coalesce(l.archivo, f.archivo) AS archivo,
  CASE WHEN l.nombre_coach = f.nombre_coach THEN {AS_OF} ELSE f.fecha_registro END AS fecha_registro,
  coalesce(l.nombre_coach, f.nombre_coach) AS nombre_coach
FROM fotos f LEFT JOIN valido l ON f.id_participacion = l.id_participacion AND f.tipo = l.tipo AND f.estado = l.estado
UNION ALL
SELECT {_new_id('id_foto', 'fotos', 'id_participacion', 'tipo', 'estado')}, id_participacion, tipo, estado, archivo, {AS_OF},
  nombre_coach
FROM valido l WHERE NOT EXISTS (SELECT 1 FROM fotos f WHERE f.id_participacion = l.id_participacion AND f.tipo = l.tipo
  AND f.estado = l.estado)""", _judged("lote_fotos")),
        "cascade_rename": _q("participacion lote_nombres", """
SELECT id_participacion, coalesce(nuevo, nombre_reto) AS nombre_reto, nombre_retador, objetivo_participacion
FROM participacion LEFT JOIN lote_nombres ON nombre_reto = viejo"""),
        "normalize_alerts": _q("coaches", """
SELECT id_coach, nombre_coach, user_coach, num_celular_coach, email_coach, permiso,
  CASE WHEN email_coach IS NULL THEN FALSE ELSE notificacion_correo END AS notificacion_correo FROM coaches"""),
        "guarded_changes": _q("lote_celulares retadores", """
SELECT l.id_retador, l.num_celular_retador, r.nombre_coach = 'Supplier#000000001' AS aceptado,
  CASE WHEN r.nombre_coach = 'Supplier#000000001' THEN NULL ELSE 'registro de otro coach' END AS motivo
FROM lote_celulares l LEFT JOIN retadores r ON l.id_retador = r.id_retador"""),
    }


def _listed() -> dict[str, str]:
    """Reports with the position that their printed order gives each row."""
    def placed(order: str, hidden: str = "") -> str:
        return f"SELECT *{hidden}, row_number() OVER (ORDER BY {', '.join(f'{c} NULLS LAST' for c in order.split())}) AS posicion FROM filas"

    logs = "registros_habitos participacion"
    return {
        "scores_listed": _q(
            "registros_habitos registros_calificaciones registros_actividades habitos criterios_calificacion participacion conceptos actividades coaches",
            placed("nombre_reto nombre_retador concepto"),
            SCORES + ", filas AS (SELECT nombre_reto, nombre_retador, concepto, round(puntaje, 6) AS puntaje, total FROM tablero)"),
        "habit_counts_listed": _q(f"{logs} habitos", placed("nombre_reto nombre_retador id_habito", " EXCLUDE (id_habito)"), """
filas AS (
  SELECT nombre_reto, nombre_retador, l.nombre_habito, id_habito, count(*) AS n FROM registros_habitos l JOIN participacion p USING (id_participacion)
  JOIN habitos h ON h.nombre_habito = l.nombre_habito GROUP BY ALL)"""),
        "habit_days_listed": _q(f"{logs} habitos coaches", placed("nombre_reto nombre_retador id_habito fecha", " EXCLUDE (id_habito)"), """
filas AS (
  SELECT nombre_reto, nombre_retador, fecha_ocurrencia AS fecha, l.nombre_habito, id_habito, max(user_coach) AS user_coach, count(*) AS n
  FROM registros_habitos l JOIN participacion p USING (id_participacion) JOIN coaches USING (nombre_coach)
  JOIN habitos h ON h.nombre_habito = l.nombre_habito GROUP BY ALL)"""),
        "attendance_listed": _q("registros_actividades participacion actividades", placed(
            "nombre_reto inicio retador actividad registrador", " EXCLUDE (inicio)"), """
filas AS (
  SELECT p.nombre_reto, concat(coalesce(actividad, 'NA'), ' ', coalesce(strftime(inicio, '%d/%m/%Y'), 'NA')) AS actividad,
    nombre_retador AS retador, nombre_coach AS registrador, CAST(inicio AS DATE) AS inicio
  FROM registros_actividades r JOIN participacion p USING (id_participacion) LEFT JOIN actividades a ON r.id_actividad = a.id_actividad)"""),
        "ratings_listed": _q("registros_calificaciones participacion retos", placed("nombre_reto retador calificador criterio"), f"""
filas AS (
  SELECT nombre_reto, nombre_retador AS retador, nombre_coach AS calificador, criterio_calificacion AS criterio, {_word('calificacion')} AS calificacion
  FROM registros_calificaciones JOIN participacion USING (id_participacion) JOIN retos USING (nombre_reto))"""),
    }


def _refreshed() -> dict[str, str]:
    """Scores and indicators counted anew over the three saved logs."""
    saves = {"registros_habitos": "save_habits", "registros_actividades": "save_attendance", "registros_calificaciones": "save_ratings"}
    changes = _changes()
    after = ",\n".join(f"tras_{log} AS ({changes[save]})" for log, save in saves.items())

    def over_saved(text: str) -> str:
        for log in saves:
            text = text.replace(f"FROM {log}", f"FROM tras_{log}")
        return text

    def numbers(prefix: str) -> str:
        sign = 1 if prefix else -1
        return f"""
  SELECT id_participacion, 0 AS a, {sign} * CAST(100 * peso_habito AS BIGINT) AS h, 0 AS c, 0 AS na, {sign} AS nh, 0 AS nc
  FROM {prefix}registros_habitos l JOIN habitos x ON x.nombre_habito = l.nombre_habito
  UNION ALL
  SELECT id_participacion, {sign}, 0, 0, {sign}, 0, 0 FROM {prefix}registros_actividades
  UNION ALL
  SELECT id_participacion, 0, 0, {sign} * calificacion * CAST(100 * peso_criterio AS BIGINT), 0, 0, {sign}
  FROM {prefix}registros_calificaciones l JOIN criterios_calificacion k ON k.criterio_calificacion = l.criterio_calificacion"""

    scores = "registros_habitos registros_calificaciones registros_actividades habitos criterios_calificacion participacion conceptos actividades coaches"
    return {
        "score_deltas": _q(scores, """
SELECT id_participacion, CAST(sum(a) AS BIGINT) AS _actividades, CAST(sum(h) AS BIGINT) AS _habitos, CAST(sum(c) AS BIGINT) AS _calificacion,
  CAST(sum(na) AS BIGINT) AS _n_actividades, CAST(sum(nh) AS BIGINT) AS _n_habitos, CAST(sum(nc) AS BIGINT) AS _n_calificacion
FROM cambios GROUP BY id_participacion HAVING sum(a) <> 0 OR sum(h) <> 0 OR sum(c) <> 0 OR sum(na) <> 0 OR sum(nh) <> 0 OR sum(nc) <> 0""",
            f"{after},\ncambios AS ({numbers('')} UNION ALL {numbers('tras_')})"),
        "scoreboard_refreshed": _q(scores, """
SELECT nombre_reto, nombre_retador, concepto, round(puntaje, 6) AS puntaje, total FROM tablero""", f"{after},\n{over_saved(SCORES).strip()}"),
        "kpis_refreshed": _q("retos participacion actividades registros_habitos registros_actividades habitos",
            "SELECT id_reto, nombre_reto, gente AS retadores, habitos, actividades FROM tasas", f"{after},\n{over_saved(RATES).strip()}"),
    }


def oracle_sql() -> dict[str, str]:
    habits = "habitos conceptos registros_habitos participacion"
    attended = "conceptos actividades registros_actividades participacion"
    rated = "conceptos criterios_calificacion coaches registros_calificaciones participacion"
    scores = f"{habits} {attended} {rated}"
    rates = "habitos retos participacion actividades registros_habitos registros_actividades"
    wide = ", ".join(
        f"max(CASE WHEN nombre_habito = '{h}' THEN {{v}} END) AS \"{h}\""
        for h in ["Desayuno", "Media Mañana", "Almuerzo", "Media Tarde", "Cena", "Hidratación", "Actividad Física"])
    other = "nombre_habito NOT IN ('Desayuno', 'Media Mañana', 'Almuerzo', 'Media Tarde', 'Cena', 'Hidratación', 'Actividad Física')"
    ical = """strftime({c} + INTERVAL 5 HOUR, '%Y%m%dT%H%M%SZ')"""

    def fold(line: str) -> str:
        """Pieces of 74 characters, or 18 where some take more than one byte, if the line has more than 75 bytes."""
        width = f"(CASE WHEN strlen({line}) = length({line}) THEN 74 ELSE 18 END)"
        pieces = f"list_transform(range((length({line}) + {width} - 1) // {width}), lambda i: substr({line}, 1 + i * {width}, {width}))"
        return f"CASE WHEN strlen({line}) <= 75 THEN {line} ELSE array_to_string({pieces}, chr(13) || chr(10) || ' ') END"

    folded = ", ".join(fold(line) for line in ["uid", "l_stamp", "l_start", "l_end", "l_summary", "l_description", "l_location"])
    result = {
        "scan_coaches": _q("coaches", "SELECT * FROM coaches"),
        "active_coaches": _q("coaches", "SELECT id_coach, nombre_coach FROM coaches WHERE permiso <> 'Inactivo'"),
        "challenges": _q("retos", """
SELECT id_reto, nombre_reto, fecha_ini AS fecha_inicio, CAST(fecha_fin_excl - 1 AS DATE) AS fecha_fin, reto_activo FROM retos"""),
        "active_challenges": _q("retos", """
SELECT id_reto, nombre_reto, fecha_ini AS fecha_inicio, CAST(fecha_fin_excl - 1 AS DATE) AS fecha_fin, reto_activo FROM retos
WHERE reto_activo"""),
        "challenge_names": _q("retos", """
SELECT id_reto, concat('Reto del ', strftime(fecha_ini, '%d/%m/%Y'), ' al ', strftime(CAST(fecha_ini + 20 AS DATE), '%d/%m/%Y'))
  AS nombre FROM retos"""),
        "all_logs": _q("registros_habitos registros_actividades registros_calificaciones", """
SELECT id_participacion, concepto, nombre_coach, fecha_registro FROM registros_habitos UNION ALL
SELECT id_participacion, concepto, nombre_coach, fecha_registro FROM registros_actividades UNION ALL
SELECT id_participacion, concepto, nombre_coach, fecha_registro FROM registros_calificaciones"""),
        "domain_values": _q("coaches retadores parametros fotos actividades", """
SELECT coalesce(e.variable, u.variable) AS variable, coalesce(e.valor, u.valor) AS valor, orden, coalesce(usos, 0) AS usos
FROM etiquetas e FULL JOIN (SELECT variable, valor, count(*) AS usos FROM en_uso GROUP BY variable, valor) u
  ON e.variable = u.variable AND e.valor = u.valor""", "etiquetas AS (SELECT * FROM (VALUES " + ", ".join(
            f"('{d}', '{v}', {n})" for d, values in ENUMS.items() for n, v in enumerate(values, 1)) + ") v(variable, valor, orden)),\nen_uso AS ("
            + " UNION ALL ".join(f"SELECT '{d}' AS variable, {c} AS valor FROM {tb} WHERE {c} IS NOT NULL" for tb, c, d in ENUM_COLUMNS) + ")"),
        "participation_lookup": _q("participacion retadores", """
SELECT id_participacion, nombre_reto, nombre_retador, CAST(talla AS DOUBLE) AS talla, nombre_coach, objetivo_participacion
FROM participacion JOIN retadores USING (nombre_retador)"""),
        "roster": _q("participacion retadores", """
SELECT id_participacion, nombre_reto, nombre_retador, objetivo_participacion, nombre_coach, num_celular_retador,
  concat(nombre_retador, ' - ', num_celular_retador) AS lista
FROM participacion JOIN retadores USING (nombre_retador)"""),
        "roster_visible": _q("participacion retadores", """
SELECT id_participacion, nombre_reto, nombre_retador, objetivo_participacion, nombre_coach, num_celular_retador,
  concat(nombre_retador, ' - ', num_celular_retador) AS lista
FROM participacion JOIN retadores USING (nombre_retador) WHERE nombre_coach = 'Supplier#000000001'"""),
        "activities": _q("raw_actividades", """
SELECT id_actividad, nombre_reto, actividad, inicio, fin,
  CAST(date_diff('microsecond', inicio, fin) AS DOUBLE) / 60000000 AS duracion, tema_actividad,
  coach_expositor, strftime(inicio, '%d/%m/%Y %I:%M %p') AS inicio_mostrar, strftime(fin, '%d/%m/%Y %I:%M %p') AS fin_mostrar
FROM raw_actividades"""),
        "activity_labels": _q("raw_actividades", """
SELECT id_actividad, nombre_reto, concat(actividad, ' ', strftime(inicio, '%d/%m/%Y')) AS etiqueta
FROM raw_actividades WHERE actividad <> 'Ceremonia'"""),
        "blank_to_null": _q("raw_formularios", """
SELECT id_formulario, nullif(nombre_retador, '') AS nombre_retador, nullif(objetivo_participacion, '') AS objetivo_participacion,
  nullif(edad, 0) AS edad, nullif(talla, 0) AS talla FROM raw_formularios"""),
        "rating_labels": _q("registros_calificaciones", f"""
SELECT id_participacion, criterio_calificacion, nombre_coach, {_word('calificacion')} AS calificacion
FROM registros_calificaciones"""),
        "rating_codes": _q("registros_calificaciones", """
SELECT id_participacion, criterio_calificacion, nombre_coach, calificacion FROM registros_calificaciones"""),
        "measurements_dense": _q("participacion parametros registros_parametros", "SELECT * FROM medidas", MEASURES),
        "measurement_deltas": _q("participacion parametros registros_parametros retadores", """
SELECT id_participacion, parametro, inicial, final, round(final - inicial, 6) AS variacion,
  round((final - inicial) / inicial, 6) AS var_pct, printf('%.2f%%', round_even((final - inicial) / inicial / 0.0001, 0) / 100) AS var_pct_text, und
FROM (
  SELECT * FROM medidas
  UNION ALL
  SELECT m.id_participacion, 'IMC', round(inicial / (t * t), 2), round(final / (t * t), 2), ''
  FROM medidas m JOIN (SELECT id_participacion, CAST(talla AS DOUBLE) AS t FROM participacion JOIN retadores USING (nombre_retador)) h
    ON m.id_participacion = h.id_participacion
  WHERE parametro = 'Peso') u""", MEASURES),
        "challenger_age": _q("retadores", """
SELECT id_retador, anios, meses, dias, trim(concat(
  CASE WHEN anios <> 0 THEN concat(anios, ' Años ') ELSE '' END,
  CASE WHEN meses = 1 THEN '1 Mes ' WHEN meses <> 0 THEN concat(meses, ' Meses ') ELSE '' END,
  CASE WHEN dias = 1 THEN '1 day' WHEN dias <> 0 THEN concat(dias, ' Días') ELSE '' END)) AS edad
FROM edades""", f"""
edades AS (
  SELECT id_retador, CAST(datepart('year', e) AS INTEGER) AS anios, CAST(datepart('month', e) AS INTEGER) AS meses,
    CAST(datepart('day', e) AS INTEGER) AS dias
  FROM (SELECT id_retador, age(CAST({AS_OF} AS TIMESTAMP), CAST(fecha_nacimiento AS TIMESTAMP)) AS e FROM retadores) x)"""),
        "habit_checklist": _q("participacion retos habitos registros_habitos", """
SELECT g.id_participacion, g.fecha, g.nombre_habito, count(h.id_registro_habito) <> 0 AS registro, h.nombre_coach
FROM (
  SELECT id_participacion, CAST(unnest(generate_series(fecha_ini, fecha_fin_excl - 1, INTERVAL 1 DAY)) AS DATE) AS fecha, nombre_habito
  FROM participacion JOIN retos USING (nombre_reto) JOIN habitos ON id_habito > 0) g
LEFT JOIN registros_habitos h ON h.id_participacion = g.id_participacion AND h.fecha_ocurrencia = g.fecha
  AND h.nombre_habito = g.nombre_habito
GROUP BY g.id_participacion, g.fecha, g.nombre_habito, h.nombre_coach"""),
        "attendance_checklist": _q("participacion actividades registros_actividades lote_asistencia", """
SELECT a.id_actividad, p.id_participacion, p.nombre_retador, count(r.id_registro_actividad) <> 0 AS registro, r.nombre_coach
FROM participacion p JOIN actividades a ON p.nombre_reto = a.nombre_reto
  LEFT JOIN registros_actividades r ON r.id_actividad = a.id_actividad AND r.id_participacion = p.id_participacion
WHERE a.id_actividad IN (SELECT id_actividad FROM lote_asistencia)
GROUP BY a.id_actividad, p.id_participacion, p.nombre_retador, r.nombre_coach"""),
        "ratings_dense": _q("participacion criterios_calificacion registros_calificaciones", f"""
SELECT p.id_participacion, k.criterio_calificacion, {_word('r.calificacion')} AS calificacion
FROM participacion p JOIN criterios_calificacion k ON k.id_criterio_calificacion > 0
  LEFT JOIN registros_calificaciones r ON r.id_participacion = p.id_participacion
    AND r.criterio_calificacion = k.criterio_calificacion AND r.nombre_coach = 'Supplier#000000001'"""),
        "habit_counts": _q(habits, """
SELECT nombre_reto, nombre_retador, nombre_habito, count(*) AS n
FROM registros_habitos l JOIN participacion p ON p.id_participacion = l.id_participacion
GROUP BY nombre_reto, nombre_retador, nombre_habito"""),
        "rating_means": _q(rated, """
SELECT nombre_reto, nombre_retador, criterio_calificacion,
  round(sum(calificacion) / (SELECT CAST(count(*) AS DOUBLE) FROM coaches WHERE permiso <> 'Inactivo'), 6) AS prom
FROM registros_calificaciones l JOIN participacion p ON p.id_participacion = l.id_participacion
GROUP BY nombre_reto, nombre_retador, criterio_calificacion"""),
        "score_habits": _q(scores, """
SELECT nombre_reto, nombre_retador, concepto, round(bruto, 6) AS puntaje FROM puntajes WHERE concepto = 'Habitos'""", SCORES),
        "score_activities": _q(scores, """
SELECT nombre_reto, nombre_retador, concepto, round(bruto, 6) AS puntaje FROM puntajes WHERE concepto = 'Actividades'""", SCORES),
        "score_ratings": _q(scores, """
SELECT nombre_reto, nombre_retador, concepto, round(bruto, 6) AS puntaje FROM puntajes WHERE concepto = 'Calificacion'""", SCORES),
        "scoreboard": _q(scores, """
SELECT nombre_reto, nombre_retador, concepto, round(puntaje, 6) AS puntaje, total FROM tablero""", SCORES),
        "scoreboard_report": _q(scores, """
SELECT nombre_reto AS "Reto", nombre_retador AS "Retador", concepto AS "Concepto", round(puntaje, 6) AS "Puntaje",
  total AS "Total" FROM tablero""", SCORES),
        "ranking": _q(scores, """
SELECT nombre_reto, nombre_retador, total, rank() OVER (PARTITION BY nombre_reto ORDER BY total DESC) AS puesto
FROM (SELECT DISTINCT nombre_reto, nombre_retador, total FROM tablero) d""", SCORES),
        "daily_habits": _q(f"{scores} retos", """
SELECT nombre_reto, nombre_retador, concepto, fecha_ocurrencia, round(puntaje, 6) AS puntaje FROM dias
WHERE concepto = 'Habitos'""", DAYS),
        "daily_activities": _q(f"{scores} retos", """
SELECT nombre_reto, nombre_retador, concepto, fecha_ocurrencia, round(puntaje, 6) AS puntaje FROM dias
WHERE concepto = 'Actividades'""", DAYS),
        "daily_ratings": _q(f"{scores} retos", """
SELECT nombre_reto, nombre_retador, concepto, fecha_ocurrencia, round(puntaje, 6) AS puntaje FROM dias
WHERE concepto = 'Calificacion'""", DAYS),
        "daily_scoreboard": _q(f"{scores} retos", """
SELECT nombre_reto, nombre_retador, concepto, fecha_ocurrencia, round(greatest(puntaje, 0), 6) AS puntaje,
  round(sum(greatest(puntaje, 0)) OVER (PARTITION BY nombre_reto, nombre_retador, fecha_ocurrencia), 6) AS total FROM dias""", DAYS),
        "challenge_progress": _q(rates, """
SELECT id_reto, nombre_reto, gente AS num_retadores, CAST(dias AS BIGINT) AS num_dias FROM tasas""", RATES),
        "kpis": _q(rates, "SELECT id_reto, nombre_reto, gente AS retadores, habitos, actividades FROM tasas", RATES),
        "kpis_display": _q(rates, """
SELECT nombre_reto, gente AS retadores, printf('%.2f%%', habitos * 100) AS habitos, printf('%.2f%%', actividades * 100) AS actividades
FROM tasas""", RATES),
        "calendar_feed": _q("retos raw_actividades", """
SELECT id_reto AS calendar_id, nombre_reto AS title, NULL AS body, CAST(fecha_ini AS TIMESTAMP) + INTERVAL 5 HOUR AS start,
  CAST(fecha_fin_excl - 1 AS TIMESTAMP) + INTERVAL 29 HOUR AS "end", 'time' AS category FROM retos WHERE reto_activo
UNION ALL
SELECT id_reto, actividad, concat(tema_actividad, ' - (', coach_expositor, ')'), inicio + INTERVAL 5 HOUR,
  fin + INTERVAL 5 HOUR, 'time' FROM raw_actividades JOIN retos USING (nombre_reto) WHERE reto_activo"""),
        "activity_calendar": _q("raw_actividades", """
SELECT nombre_reto, actividad AS calendar_id, actividad AS title, concat(tema_actividad, ' - (', coach_expositor, ')') AS body,
  inicio + INTERVAL 5 HOUR AS start, fin + INTERVAL 5 HOUR AS "end", 'time' AS category,
  dense_rank() OVER (PARTITION BY nombre_reto ORDER BY actividad) AS slot,
  greatest(n, 3) AS n_slots
FROM raw_actividades JOIN (SELECT nombre_reto, count(DISTINCT actividad) AS n FROM raw_actividades GROUP BY nombre_reto) x USING (nombre_reto)"""),
        "hidden_calendars": _q("retos", "SELECT id_reto AS calendar_id FROM retos WHERE reto_activo AND id_reto <> 1"),
        "group_slots": _q("retos", """
SELECT id_reto AS calendar_id, row_number() OVER (ORDER BY id_reto) AS slot,
  greatest((SELECT count(*) FROM retos WHERE reto_activo), 3) AS n_slots
FROM retos WHERE reto_activo"""),
        "ical_events": _q("retos raw_actividades", f"""
SELECT id_reto, actividad AS summary, concat(nombre_reto, '\\n - ', tema_actividad, '\\n - ', coach_expositor) AS description,
  {ical.format(c='inicio')} AS dtstart, {ical.format(c='fin')} AS dtend, 'Zoom' AS location,
  concat(nombre_reto, '-', actividad, '-', strftime(inicio, '%Y-%m-%d %H:%M:%S')) AS uid
FROM raw_actividades JOIN retos USING (nombre_reto) WHERE reto_activo"""),
        "calendar_parts": _q("retos raw_actividades", f"""
SELECT id_reto, posicion, concat(
    CASE WHEN posicion = min(posicion) OVER (PARTITION BY id_reto) THEN concat_ws(fin, 'BEGIN:VCALENDAR', 'PRODID:-//tablero//ES', 'VERSION:2.0', '') ELSE '' END,
    value,
    CASE WHEN posicion = max(posicion) OVER (PARTITION BY id_reto) THEN concat(fin, 'END:VCALENDAR') ELSE '' END) AS value
FROM (
  SELECT *, concat_ws(fin, 'BEGIN:VEVENT', {folded}, 'END:VEVENT') AS value, row_number() OVER (ORDER BY id_reto, dtstart, uid, value) AS posicion
  FROM eventos)""", f"""
eventos AS (
  SELECT id_reto, concat(chr(13), chr(10)) AS fin, {ical.format(c='inicio')} AS dtstart, concat('UID:', nombre_reto, '-', actividad, '-', strftime(inicio, '%Y-%m-%d %H:%M:%S')) AS uid,
    concat('DTSTAMP:', {ical.format(c='inicio')}) AS l_stamp, concat('DTSTART:', {ical.format(c='inicio')}) AS l_start, concat('DTEND:', {ical.format(c='fin')}) AS l_end,
    concat('SUMMARY:', actividad) AS l_summary, 'LOCATION:Zoom' AS l_location,
    concat('DESCRIPTION:', nombre_reto, '\\n - ', tema_actividad, '\\n - ', coach_expositor) AS l_description
  FROM raw_actividades JOIN retos USING (nombre_reto) WHERE reto_activo)"""),
        "pivot_habit_counts": _q(habits, f"""
SELECT nombre_reto, nombre_retador, {wide.format(v='n')}, CAST(coalesce(sum(CASE WHEN {other} THEN n END), 0) AS BIGINT) AS otros
FROM (SELECT nombre_reto, nombre_retador, nombre_habito, count(*) AS n FROM registros_habitos JOIN participacion USING (id_participacion)
      GROUP BY ALL) c
GROUP BY nombre_reto, nombre_retador"""),
        "habit_days": _q("registros_habitos participacion coaches", """
SELECT nombre_reto, nombre_retador, fecha_ocurrencia AS fecha, nombre_habito, max(user_coach) AS user_coach, count(*) AS n
FROM registros_habitos JOIN participacion USING (id_participacion) JOIN coaches USING (nombre_coach)
GROUP BY nombre_reto, nombre_retador, fecha_ocurrencia, nombre_habito"""),
        "pivot_habit_days": _q("registros_habitos participacion coaches", f"""
SELECT nombre_reto, nombre_retador, fecha_ocurrencia AS fecha, {wide.format(v='user_coach')},
  CAST(count(*) FILTER (WHERE {other}) AS BIGINT) AS otros
FROM registros_habitos JOIN participacion USING (id_participacion) JOIN coaches USING (nombre_coach)
GROUP BY nombre_reto, nombre_retador, fecha_ocurrencia"""),
        "photos_decoded": _q("fotos", """
SELECT id_foto, id_participacion, tipo, estado, octet_length(unhex(archivo)) AS n_bytes, md5(unhex(archivo)) AS md5 FROM fotos"""),
        "pivot_photos": _q("fotos", """
SELECT id_participacion, tipo, max(CASE WHEN estado = 'Inicial' THEN md5(unhex(archivo)) END) AS inicial,
  max(CASE WHEN estado = 'Final' THEN md5(unhex(archivo)) END) AS final
FROM fotos GROUP BY id_participacion, tipo"""),
        "attendance_report": _q("registros_actividades participacion actividades", """
SELECT p.nombre_reto, concat(coalesce(actividad, 'NA'), ' ', coalesce(strftime(inicio, '%d/%m/%Y'), 'NA')) AS actividad,
  nombre_retador AS retador, nombre_coach AS registrador
FROM registros_actividades r JOIN participacion p USING (id_participacion) LEFT JOIN actividades a ON r.id_actividad = a.id_actividad"""),
        "ratings_report": _q("registros_calificaciones participacion retos", f"""
SELECT nombre_reto, nombre_retador AS retador, nombre_coach AS calificador, criterio_calificacion AS criterio,
  {_word('calificacion')} AS calificacion
FROM registros_calificaciones JOIN participacion USING (id_participacion) JOIN retos USING (nombre_reto)"""),
        "report_names": _q("participacion retos", """
SELECT concat('Reto del ', strftime(fecha_ini, '%d/%m/%Y'), ' al ', strftime(CAST(fecha_ini + 20 AS DATE), '%d/%m/%Y')) AS nombre_reto,
  nombre_retador, concat('detalle_reto_', strftime(fecha_ini, '%Y-%m-%d'), '.html') AS archivo_reto,
  concat('detalle_reto_', strftime(fecha_ini, '%Y-%m-%d'), '_', replace(nombre_retador, ' ', '_'), '.html') AS archivo_retador
FROM participacion JOIN retos USING (nombre_reto)"""),
        "delete_blocked": _blocked(),
        "activity_witness": _q("raw_actividades", """
SELECT id_actividad, nombre_reto, inicio, fin, testigo FROM (
  SELECT a.*, b.id_actividad AS testigo, row_number() OVER (PARTITION BY a.id_actividad ORDER BY
      CASE WHEN b.inicio = a.inicio THEN 0 WHEN b.inicio < a.inicio THEN 1 ELSE 2 END,
      CASE WHEN b.inicio < a.inicio THEN b.fin END DESC, CASE WHEN b.inicio > a.inicio THEN b.inicio END,
      CASE WHEN b.inicio = a.inicio AND b.id_actividad > a.id_actividad AND NOT EXISTS (
        SELECT 1 FROM raw_actividades c WHERE c.nombre_reto = a.nombre_reto AND c.inicio = a.inicio AND c.id_actividad < a.id_actividad)
        THEN -b.id_actividad ELSE b.id_actividad END) AS lugar
  FROM raw_actividades a JOIN raw_actividades b
    ON a.nombre_reto = b.nombre_reto AND a.id_actividad <> b.id_actividad AND a.inicio <= b.fin AND b.inicio <= a.fin) x
WHERE lugar = 1"""),
        "intake_batch": _q("registros_habitos participacion retos", """
SELECT l.* FROM registros_habitos l JOIN participacion p ON p.id_participacion = l.id_participacion
  JOIN retos r ON r.nombre_reto = p.nombre_reto WHERE reto_activo"""),
    }
    result.update(_rules())
    result.update(_changes())
    result.update(_admission())
    result.update(_refreshed())
    result.update(_listed())
    return result
