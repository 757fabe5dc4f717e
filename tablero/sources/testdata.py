"""Domain tables derived from the star-schema test Parquet, over whole tables.

Each view is one SQL text that both Spark and the checking engine run, so the two sides start from the same rows. The ``raw_*``
views break the integrity rules on purpose; the others satisfy them. ``{name}`` stands for another view or a Parquet table,
``{TS}`` for the timestamp type without zone of the engine.
"""

from __future__ import annotations

from functools import cache
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from tablero.sources.tables import Tables

# Columns of the Parquet tables, declared so that opening one reads no file.
PARQUET = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}

# The challenge of a customer, and of an order: half of them belong to the challenge of a region, the others to one of the suppliers'; there
# are 15 customers and 150 orders per supplier at every scale.
_RETO_PERSONA = "CASE WHEN c_custkey % 2 = 0 THEN n_regionkey ELSE 1000 + CAST(FLOOR(c_custkey / 15) AS BIGINT) END"
_RETO_ORDEN = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 ELSE 1000 + CAST(FLOOR(o_orderkey / 150) AS BIGINT) END"

# Columns of the activity an order stands for.
_ACTIVITY = """o_orderkey AS id_actividad,
  CASE o_orderkey % 12 WHEN 0 THEN 'Ceremonia' WHEN 1 THEN 'Charla Alimentación' WHEN 2 THEN 'Charla Motivación'
    ELSE 'Fit Camp' END AS actividad,
  CAST(fecha_ini AS {TS})
    + INTERVAL '1' HOUR * CAST(24 * (CAST(FLOOR(o_orderkey / 5) AS BIGINT) % 23) + 8 + o_orderkey % 10 AS INT) AS inicio,
  CAST(fecha_ini AS {TS})
    + INTERVAL '1' HOUR * CAST(24 * (CAST(FLOOR(o_orderkey / 5) AS BIGINT) % 23) + 13 + o_orderkey % 10 AS INT) AS fin,
  nombre_reto, concat('Tema ', CAST(o_orderkey % 7 AS STRING)) AS tema_actividad,
  concat('Supplier#', lpad(CAST(o_orderkey % 10 AS STRING), 9, '0')) AS coach_expositor"""

# A measurement with one decimal from the balance of a customer, by whole-number arithmetic so that engines agree on it.
_PESO = "(550 + CAST(FLOOR(round(abs(c_acctbal) * 100) / 10) AS BIGINT) % 500) / CAST(10 AS DOUBLE)"
_CINTURA = "(700 + CAST(FLOOR(round(abs(c_acctbal) * 100) / 10) AS BIGINT) % 500) / CAST(10 AS DOUBLE)"

VIEWS: dict[str, str] = {
    "coaches": """
SELECT s_suppkey AS id_coach, s_name AS nombre_coach, concat('user', CAST(s_suppkey AS STRING)) AS user_coach,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE lpad(CAST(s_suppkey AS STRING), 9, '9') END AS num_celular_coach,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('user', CAST(s_suppkey AS STRING), '@example.org') END AS email_coach,
  CASE WHEN s_suppkey % 10 = 0 THEN 'Administrador' WHEN s_suppkey % 10 = 9 THEN 'Inactivo' ELSE 'Coach' END AS permiso,
  s_suppkey % 2 = 0 AS notificacion_correo
FROM {supplier}""",
    "retadores": """
SELECT c_custkey AS id_retador, c_name AS nombre_retador,
  CAST(DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INT) AS DATE) AS fecha_nacimiento,
  CASE WHEN c_custkey % 2 = 0 THEN 'Mujer' ELSE 'Hombre' END AS sexo, lpad(CAST(c_custkey AS STRING), 9, '0') AS num_celular_retador,
  CAST(1.45 + (c_custkey % 50) / 100.0 AS DECIMAL(3,2)) AS talla,
  concat('Supplier#', lpad(CAST(c_custkey % 10 AS STRING), 9, '0')) AS nombre_coach
FROM {customer}""",
    "retos": """
SELECT CAST(r_regionkey AS BIGINT) AS id_reto, concat('Reto ', r_name) AS nombre_reto,
  CAST(DATE '2024-01-01' + 2 * r_regionkey AS DATE) AS fecha_ini,
  CAST(DATE '2024-01-22' + 2 * r_regionkey AS DATE) AS fecha_fin_excl, r_regionkey <> 4 AS reto_activo
FROM {region}
UNION ALL
SELECT 1000 + s_suppkey, concat('Reto ', s_name), CAST(DATE '2024-01-01' + CAST(s_suppkey % 10 AS INT) AS DATE),
  CAST(DATE '2024-01-22' + CAST(s_suppkey % 10 AS INT) AS DATE), s_suppkey % 3 <> 0
FROM {supplier}""",
    "participacion": f"""
SELECT c_custkey AS id_participacion, nombre_reto, c_name AS nombre_retador, c_mktsegment AS objetivo_participacion
FROM (SELECT c_custkey, c_name, c_mktsegment, {_RETO_PERSONA} AS reto FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey) c
  JOIN {{retos}} ON id_reto = reto""",
    # Participations with the days of their challenge.
    "participacion_dias": """
SELECT id_participacion, p.nombre_reto, fecha_ini, fecha_fin_excl
FROM {participacion} p JOIN {retos} r ON p.nombre_reto = r.nombre_reto""",
    "habitos": """
SELECT * FROM (VALUES
  (1, 'Desayuno', CAST(0.12 AS DECIMAL(3,2))), (2, 'Media Mañana', CAST(0.12 AS DECIMAL(3,2))),
  (3, 'Almuerzo', CAST(0.12 AS DECIMAL(3,2))), (4, 'Media Tarde', CAST(0.12 AS DECIMAL(3,2))),
  (5, 'Cena', CAST(0.12 AS DECIMAL(3,2))), (6, 'Hidratación', CAST(0.20 AS DECIMAL(3,2))),
  (7, 'Actividad Física', CAST(0.20 AS DECIMAL(3,2)))) AS v(id_habito, nombre_habito, peso_habito)""",
    "conceptos": """
SELECT * FROM (VALUES
  (1, 'Actividades', CAST(0.10 AS DECIMAL(3,2))), (2, 'Habitos', CAST(0.45 AS DECIMAL(3,2))),
  (3, 'Calificacion', CAST(0.45 AS DECIMAL(3,2)))) AS v(id_concepto, concepto, peso_concepto)""",
    "criterios_calificacion": """
SELECT * FROM (VALUES
  (1, 'Variación de Peso', CAST(0.30 AS DECIMAL(3,2))), (2, 'Variación de Medidas', CAST(0.30 AS DECIMAL(3,2))),
  (3, 'Apariencia Física', CAST(0.40 AS DECIMAL(3,2)))) AS v(id_criterio_calificacion, criterio_calificacion, peso_criterio)""",
    "parametros": """
SELECT * FROM (VALUES (1, 'Peso', 'Kg'), (2, 'Medida Cintura', 'cm')) AS v(id_parametro, nombre_parametro, unidad)""",
    "raw_habitos": """
SELECT event_id AS id_registro_habito, user_id AS id_participacion, CAST(ts AS DATE) AS fecha_ocurrencia, nombre_habito,
  'Habitos' AS concepto, concat('Supplier#', lpad(CAST(event_id % 10 AS STRING), 9, '0')) AS nombre_coach,
  CAST(ts AS DATE) AS fecha_registro
FROM {events} JOIN {habitos} ON id_habito = event_id % 7 + 1""",
    # The first registration of a (person, day, habit) wins; days outside the challenge or still to come are dropped.
    "registros_habitos": """
SELECT id_registro_habito, q.id_participacion, fecha_ocurrencia, nombre_habito, 'Habitos' AS concepto,
  concat('Supplier#', lpad(CAST(id_registro_habito % 10 AS STRING), 9, '0')) AS nombre_coach,
  fecha_ocurrencia AS fecha_registro
FROM (SELECT min(id_registro_habito) AS id_registro_habito, id_participacion, fecha_ocurrencia, nombre_habito
      FROM {raw_habitos} GROUP BY id_participacion, fecha_ocurrencia, nombre_habito) q
  JOIN {participacion_dias} i ON q.id_participacion = i.id_participacion
WHERE fecha_ocurrencia >= fecha_ini AND fecha_ocurrencia < fecha_fin_excl AND fecha_ocurrencia <= DATE '2024-01-25'""",
    "raw_actividades": f"""
SELECT {_ACTIVITY} FROM (SELECT o_orderkey, {_RETO_ORDEN} AS reto FROM {{orders}}) o JOIN {{retos}} ON id_reto = reto""",
    # One slot per challenge and day (ceremonies also after its end): the activity registered first keeps it, as the overlap
    # rule would have it.
    "actividades": f"""
SELECT {_ACTIVITY}
FROM (SELECT min(o_orderkey) AS o_orderkey, reto
      FROM (SELECT o_orderkey, {_RETO_ORDEN} AS reto, CAST(FLOOR(o_orderkey / 5) AS BIGINT) % 23 AS dia,
              CASE o_orderkey % 12 WHEN 0 THEN 'Ceremonia' ELSE 'Otra' END AS clase
            FROM {{orders}}) o
      WHERE clase = 'Ceremonia' OR dia < 21
      GROUP BY reto, dia) q
  JOIN {{retos}} ON id_reto = reto""",
    "registros_actividades": """
SELECT min(o_orderkey) AS id_registro_actividad, p.id_participacion, a.id_actividad, 'Actividades' AS concepto,
  concat('Supplier#', lpad(CAST(min(o_orderkey) % 10 AS STRING), 9, '0')) AS nombre_coach,
  min(CAST(a.inicio AS DATE)) AS fecha_registro
FROM {orders} o JOIN {participacion_dias} p ON p.id_participacion = o.o_custkey
  JOIN {actividades} a ON a.nombre_reto = p.nombre_reto
    AND CAST(a.inicio AS DATE) = CAST(p.fecha_ini + CAST(CAST(FLOOR(o.o_orderkey / 12) AS BIGINT) % 23 AS INT) AS DATE)
GROUP BY p.id_participacion, a.id_actividad""",
    # A coach rates a person and criterion anew with each order line; the last line counts (its number carries the quantity,
    # so that repeated line numbers are settled too).
    "registros_calificaciones": """
SELECT (id_participacion * 3 + id_criterio - 1) * 10000000 + l_suppkey AS id_registro_calificacion, id_participacion,
  criterio_calificacion, s_name AS nombre_coach, CAST(ultima % 100 AS INT) % 7 - 3 AS calificacion,
  'Calificacion' AS concepto, fecha_registro
FROM (SELECT o_custkey AS id_participacion, l_linenumber % 3 + 1 AS id_criterio, l_suppkey,
        max((l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)) AS ultima,
        max(CAST(l_shipdate AS DATE)) AS fecha_registro
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
      GROUP BY o_custkey, l_linenumber % 3 + 1, l_suppkey) q
  JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {criterios_calificacion} ON id_criterio = id_criterio_calificacion""",
    "registros_parametros": f"""
SELECT c_custkey * 2 AS id_registro_parametro, c_custkey AS id_participacion, 'Peso' AS nombre_parametro,
  {_PESO} AS valor_inicial,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_PESO} - c_custkey % 7 + 2 END AS valor_final
FROM {{customer}}
UNION ALL
SELECT c_custkey * 2 + 1, c_custkey, 'Medida Cintura', {_CINTURA},
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_CINTURA} - c_custkey % 7 + 2 END
FROM {{customer}} WHERE c_mktsegment <> 'MACHINERY'""",
    "fotos": """
SELECT page_id AS id_foto, CAST(FLOOR(page_id / 6) AS BIGINT) AS id_participacion,
  CASE page_id % 3 WHEN 0 THEN 'Frente' WHEN 1 THEN 'Perfil' ELSE 'Posterior' END AS tipo,
  CASE CAST(FLOOR(page_id / 3) AS BIGINT) % 2 WHEN 0 THEN 'Inicial' ELSE 'Final' END AS estado, hex(html) AS archivo,
  DATE '2024-01-01' AS fecha_registro, concat('Supplier#', lpad(CAST(page_id % 10 AS STRING), 9, '0')) AS nombre_coach
FROM {pages}""",
    # Second enrolments in other challenges and enrolments in a challenge that does not exist.
    "raw_participacion": """
SELECT id_participacion, nombre_reto, nombre_retador, objetivo_participacion FROM {participacion}
UNION ALL
SELECT 1000000000000 + c_custkey, r.nombre_reto, c_name, c_mktsegment
FROM {customer} JOIN {retos} r ON r.id_reto = c_custkey % 5 WHERE c_acctbal < 0
UNION ALL
SELECT 2000000000000 + c_custkey, 'Reto inexistente', c_name, c_mktsegment FROM {customer} WHERE c_acctbal > 9900
UNION ALL
SELECT 3000000000000 + c_custkey, r.nombre_reto, c_name, c_mktsegment
FROM {customer} JOIN {retos} r ON r.id_reto = 1000 + CAST(FLOOR(c_custkey * 3 / 15) AS BIGINT) WHERE c_acctbal > 9000""",
    "raw_retadores": """
SELECT id_retador, nombre_retador,
  CASE WHEN id_retador % 43 = 0 THEN DATE '2010-06-15' ELSE fecha_nacimiento END AS fecha_nacimiento,
  CASE WHEN id_retador % 53 = 0 THEN 'Otro' ELSE sexo END AS sexo,
  CASE WHEN id_retador % 47 = 0 THEN '12345' WHEN id_retador % 59 = 0 THEN NULL ELSE num_celular_retador END AS num_celular_retador,
  CASE WHEN id_retador % 41 = 0 THEN CAST(2.10 AS DECIMAL(3,2)) ELSE talla END AS talla, nombre_coach
FROM {retadores}""",
    "raw_registros_actividades": """
SELECT o_orderkey AS id_registro_actividad, o_custkey AS id_participacion, o_orderkey AS id_actividad,
  CASE o_orderstatus WHEN 'P' THEN 'Habitos' ELSE 'Actividades' END AS concepto,
  concat('Supplier#', lpad(CAST(o_orderkey % 10 AS STRING), 9, '0')) AS nombre_coach, CAST(o_orderdate AS DATE) AS fecha_registro
FROM {orders}""",
    "raw_registros_calificaciones": """
SELECT l_orderkey * 10 + l_linenumber AS id_registro_calificacion, o_custkey AS id_participacion,
  concat('Criterio ', CAST(l_linenumber AS STRING)) AS criterio_calificacion,
  s_name AS nombre_coach, CAST(l_quantity AS INT) - 25 AS calificacion, 'Calificacion' AS concepto,
  CAST(l_shipdate AS DATE) AS fecha_registro
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    # A catalogue of proposed habits, one per part, whose weights add up to far more than 1.
    "raw_pesos": """
SELECT CAST(p_partkey AS BIGINT) AS id_habito, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS nombre_habito,
  CAST(p_size * 0.04 AS DECIMAL(3,2)) AS peso_habito
FROM {part}""",
    # Form rows as typed in: empty texts and zeros stand for missing values.
    "raw_formularios": """
SELECT c_custkey + 1 AS id_formulario, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS nombre_retador,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE c_mktsegment END AS objetivo_participacion,
  c_nationkey AS edad, CASE WHEN c_acctbal > 9000 THEN 0.0 ELSE c_acctbal END AS talla
FROM {customer}""",
    # Change batches for the table operators.
    "base_habitos": """
SELECT id_registro_habito, id_participacion, fecha_ocurrencia, nombre_habito, concepto, nombre_coach, fecha_registro
FROM {registros_habitos} WHERE fecha_ocurrencia < DATE '2024-01-15'""",
    "lote_inscripciones": """
SELECT r.nombre_reto, c_name AS nombre_retador FROM {customer} JOIN {retos} r ON r.id_reto = c_custkey % 5 WHERE c_acctbal < 0""",
    "lote_objetivos": """
SELECT c_custkey AS id_participacion, CASE WHEN c_acctbal < 0 THEN NULL ELSE concat(c_mktsegment, ' 2') END AS objetivo_participacion
FROM {customer} WHERE c_acctbal < 5000""",
    "lote_bajas": """
SELECT c_custkey AS id_participacion FROM {customer} WHERE c_mktsegment = 'BUILDING'""",
    "lote_medidas": f"""
SELECT c_custkey AS id_participacion, 'Medida Cintura' AS nombre_parametro,
  CASE WHEN c_acctbal > 9500 THEN NULL ELSE {_CINTURA} END AS valor_inicial,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE {_CINTURA} - 1 END AS valor_final
FROM {{customer}}
UNION ALL
SELECT c_custkey, 'Peso', {_PESO}, {_PESO} - 1 FROM {{customer}}""",
    "lote_calificaciones": """
SELECT c_custkey AS id_participacion, 'Supplier#000000001' AS nombre_coach, 'Variación de Peso' AS criterio_calificacion,
  CASE WHEN c_acctbal < 0 THEN 'Peor' ELSE 'Mucho Mejor' END AS calificacion FROM {customer}
UNION ALL
SELECT c_custkey, 'Supplier#000000001', 'Variación de Medidas', 'Igual' FROM {customer}
UNION ALL
SELECT c_custkey, 'Supplier#000000001', 'Apariencia Física', CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'Mejor' END
FROM {customer}""",
    "lote_fotos": """
SELECT id_participacion, tipo, 'Final' AS estado, max(hex(url)) AS archivo,
  concat('Supplier#', lpad(CAST(CASE WHEN tipo = 'Frente' THEN min(page_id) ELSE max(page_id) END % 10 AS STRING), 9, '0'))
    AS nombre_coach
FROM {pages} JOIN {fotos} ON page_id = id_foto GROUP BY id_participacion, tipo""",
    "lote_nombres": """
SELECT nombre_reto AS viejo, concat(nombre_reto, ' 2') AS nuevo FROM {retos} WHERE fecha_ini < DATE '2024-01-06'""",
    "lote_checklist": """
SELECT user_id AS id_participacion, CAST(ts AS DATE) AS fecha_ocurrencia, nombre_habito, bool_or(event_type <> 'error') AS registro
FROM {events} JOIN {habitos} ON id_habito = (event_id + 3) % 7 + 1 GROUP BY user_id, CAST(ts AS DATE), nombre_habito""",
    "lote_asistencia": """
SELECT id_participacion, id_actividad, bool_or(o_orderstatus <> 'F') AS registro
FROM {orders} JOIN {participacion} p ON id_participacion = o_custkey JOIN {actividades} a ON p.nombre_reto = a.nombre_reto
  AND CAST(FLOOR(o_orderkey / 7) AS BIGINT) % 23 = extract(DAY FROM a.inicio) - 1
GROUP BY id_participacion, id_actividad
UNION ALL
SELECT o_custkey, 3000000000000 + o_orderkey, TRUE FROM {orders} WHERE o_orderstatus = 'P'
UNION ALL
SELECT DISTINCT o_custkey, primera, TRUE
FROM {orders} JOIN {participacion} p ON p.id_participacion = o_custkey JOIN {retos} r ON r.nombre_reto = p.nombre_reto
  JOIN (SELECT id_reto, min(id_actividad) AS primera FROM {actividades} a JOIN {retos} s ON a.nombre_reto = s.nombre_reto
        GROUP BY id_reto) m ON m.id_reto = (r.id_reto + 1) % 5
WHERE o_orderstatus = 'F'""",
    "lote_inicios": """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS fecha_inicio FROM {orders}""",
    "lote_actividades": """
SELECT event_id AS id_actividad, event_type AS tema_actividad, ts AS inicio, CAST(FLOOR(value * 10) AS BIGINT) AS duracion
FROM {events}""",
    # A timetable with a line per order line: unknown challenges and coaches, times outside the challenge or turned round, and many that meet.
    "lote_cronograma": """
SELECT CASE l_linenumber WHEN 1 THEN 'Ceremonia' WHEN 2 THEN 'Charla Motivación' ELSE 'Fit Camp' END AS actividad,
  CAST(coalesce(fecha_ini, DATE '2024-01-01') AS {TS})
    + INTERVAL '1' MINUTE * CAST(1440 * (l_orderkey % 23) + (l_partkey * 7 + l_linenumber * 45) % 1440 AS INT) AS inicio,
  CAST(coalesce(fecha_ini, DATE '2024-01-01') AS {TS})
    + INTERVAL '1' MINUTE * CAST(1440 * (l_orderkey % 23) + (l_partkey * 7 + l_linenumber * 45) % 1440 + CAST(l_quantity AS BIGINT) - 2 AS INT) AS fin,
  concat('Reto ', CASE WHEN l_partkey % 2 = 0 THEN r_name ELSE concat('Supplier#', lpad(CAST(l_suppkey AS STRING), 9, '0')) END) AS nombre_reto,
  concat('Línea ', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING), '.', CAST(l_partkey AS STRING)) AS tema_actividad,
  concat('Supplier#', lpad(CAST(l_partkey % 11 AS STRING), 9, '0')) AS coach_expositor
FROM {lineitem} JOIN {region} ON r_regionkey = l_suppkey % 5
  LEFT JOIN {retos} ON nombre_reto = concat('Reto ', CASE WHEN l_partkey % 2 = 0 THEN r_name ELSE concat('Supplier#', lpad(CAST(l_suppkey AS STRING), 9, '0')) END)""",
    # Enrolments asked for: some persons twice, some unknown, some challenges unknown or over.
    "lote_altas": """
SELECT r.nombre_reto, c_name AS nombre_retador, c_mktsegment AS objetivo_participacion
FROM {customer} JOIN {retos} r ON r.id_reto = 1000 + c_custkey % 7
UNION ALL
SELECT CASE WHEN c_acctbal > 9500 THEN 'Reto inexistente' ELSE r.nombre_reto END, CASE WHEN c_acctbal < 0 THEN concat(c_name, ' II') ELSE c_name END, c_mktsegment
FROM {customer} JOIN {retos} r ON r.id_reto = c_custkey % 5""",
    "lote_activaciones": """
SELECT nombre_reto FROM {retos}
UNION ALL
SELECT concat(nombre_reto, ' bis') FROM {retos} WHERE id_reto % 7 = 0""",
    # Renames in steps: a swap of two, a chain of three, and plain ones.
    "lote_renombres": """
SELECT 'retos' AS tabla, 'nombre_reto' AS columna, 1 AS paso, 'Reto ASIA' AS viejo, 'Reto EUROPE' AS nuevo FROM {region} WHERE r_regionkey = 0
UNION ALL SELECT 'retos', 'nombre_reto', 1, 'Reto EUROPE', 'Reto ASIA' FROM {region} WHERE r_regionkey = 0
UNION ALL SELECT 'retos', 'nombre_reto', n, CASE n WHEN 1 THEN 'Reto AFRICA' WHEN 2 THEN 'Reto del Sur' ELSE 'Reto del Norte' END,
  CASE n WHEN 1 THEN 'Reto del Sur' WHEN 2 THEN 'Reto del Norte' ELSE 'Reto ASIA 2' END
FROM (SELECT r_regionkey AS n FROM {region} WHERE r_regionkey BETWEEN 1 AND 3) q
UNION ALL SELECT 'retadores', 'nombre_retador', 1, nombre_retador, concat(nombre_retador, ' II') FROM {retadores} WHERE id_retador % 3 = 0
UNION ALL SELECT 'retadores', 'nombre_retador', 2, concat(nombre_retador, ' II'), concat(nombre_retador, ' III') FROM {retadores} WHERE id_retador % 6 = 0
UNION ALL SELECT 'coaches', 'nombre_coach', 5, nombre_coach, concat('Coach ', CAST(id_coach AS STRING)) FROM {coaches} WHERE id_coach % 2 = 0""",
    "lote_celulares": """
SELECT c_custkey AS id_retador, lpad(CAST(c_custkey AS STRING), 9, '8') AS num_celular_retador FROM {customer}""",
}

SPARK_TYPES = {"TS": "TIMESTAMP_NTZ"}
DUCKDB_TYPES = {"TS": "TIMESTAMP"}


@cache
def needs(view: str) -> tuple[str, ...]:
    """The views and Parquet tables a view reads, in order of first use."""
    names = [field for _, field, _, _ in Formatter().parse(VIEWS[view]) if field]
    return tuple(dict.fromkeys(n for n in names if n not in SPARK_TYPES))


def tables_from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """The domain tables over ``sf_dir/*.parquet``; each view is analysed when first used."""

    def opener(name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            for token, sql_type in SPARK_TYPES.items():
                text = text.replace("{" + token + "}", sql_type)
            return spark.sql(text, **{dep: tables[dep] for dep in needs(name)})
        if name in PARQUET:
            return spark.read.schema(PARQUET[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        raise KeyError(name)

    tables = Tables(spark, opener)
    return tables


def duckdb_ctes(*views: str) -> str:
    """``WITH`` clause that defines the given views and all they need, over tables of the Parquet names."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in PARQUET or name in ordered:
            return
        for dep in needs(name):
            visit(dep)
        ordered.append(name)

    for view in views:
        visit(view)
    plain = {name: name for name in [*PARQUET, *VIEWS]} | DUCKDB_TYPES
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name].format(**plain)})" for name in ordered)
