"""Calendar feeds, palette slots and the iCalendar export."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.functions.dates import last_day, to_utc
from tablero.operators.positions import parts, positioned
from tablero.operators.running import value_ranks
from tablero.operators.spread import spread_join
from tablero.plans.kpi import selected
from tablero.plans.views import _only
from tablero.schema import ENUMS
from tablero.sources.tables import Tables

FEED = ["calendar_id", "title", "body", "start", "end", "category"]
MIN_SLOTS = 3
ID_STEP = 65_536
ICAL_STAMP = "yyyyMMdd'T'HHmmss'Z'"


def _body(topic: str, speaker: str) -> Column:
    def shown(c: str) -> Column:
        return F.coalesce(c, F.lit("NA"))

    return F.concat(shown(topic), F.lit(" - ("), shown(speaker), F.lit(")"))


def _active(t: Tables, reto: str | None = None) -> DataFrame:
    return _only(t.retos.filter("reto_activo"), reto)


def calendar_feed(t: Tables, *, reto: str | None = None) -> DataFrame:
    """Active challenges as bars over their days and their activities as events, all in UTC."""
    active = _active(t, reto)
    first, last = F.col("fecha_ini").cast("timestamp_ntz"), last_day(F.col("fecha_fin_excl")).cast("timestamp_ntz")
    bars = active.select(
        F.col("id_reto").alias("calendar_id"), F.col("nombre_reto").alias("title"), F.lit(None).cast("string").alias("body"),
        to_utc(first).alias("start"), to_utc(last + F.expr("INTERVAL 1 DAY")).alias("end"), F.lit("time").alias("category"))
    events = spread_join(t.actividades, active.select("id_reto", "nombre_reto"), ["nombre_reto"], ["id_actividad"]).select(
        F.col("id_reto").alias("calendar_id"), F.col("actividad").alias("title"),
        _body("tema_actividad", "coach_expositor").alias("body"), to_utc(F.col("inicio")).alias("start"),
        to_utc(F.col("fin")).alias("end"), F.lit("time").alias("category"))
    return bars.unionByName(events)


def activity_calendar(t: Tables, *, reto: str | None = None) -> DataFrame:
    """Activities of each challenge, active or not, as events with one calendar and palette slot per kind of activity."""
    kinds = ENUMS["tipo_actividad"]
    number = F.array_position(F.array(*[F.lit(k) for k in sorted(kinds)]), F.col("actividad"))
    rows = _only(t.actividades, reto).withColumn("_tipo", number)
    in_use = rows.groupBy("nombre_reto").agg(F.sort_array(F.collect_set("_tipo")).alias("_tipos"))  # at most one per kind
    return spread_join(rows, in_use, ["nombre_reto"], ["id_actividad"]).select(
        "nombre_reto", F.col("actividad").alias("calendar_id"), F.col("actividad").alias("title"),
        _body("tema_actividad", "coach_expositor").alias("body"), to_utc(F.col("inicio")).alias("start"),
        to_utc(F.col("fin")).alias("end"), F.lit("time").alias("category"),
        F.array_position("_tipos", F.col("_tipo")).alias("slot"),
        F.greatest(F.size("_tipos"), F.lit(MIN_SLOTS)).cast("long").alias("n_slots"))


def group_slots(t: Tables, *, reto: str | None = None) -> DataFrame:
    """Palette slot of each calendar in the feed and the size of the palette. Ids are cut four times over, so that no window holds
    more than ``ID_STEP`` rows even where ids are sparse."""
    ids = _active(t, reto).select(F.col("id_reto").alias("calendar_id")).distinct()
    n = F.greatest(ids.agg(F.count("calendar_id")).scalar(), F.lit(MIN_SLOTS))
    return value_ranks(ids, [], "calendar_id", ID_STEP, coarser=(ID_STEP, ID_STEP)).select(
        "calendar_id", F.col("denso").alias("slot"), n.cast("long").alias("n_slots"))


def hidden_calendars(t: Tables, *, selected: Iterable[int] = (), reto: str | None = None) -> DataFrame:
    """Active challenges that are not selected."""
    ids = _active(t, reto).select(F.col("id_reto").alias("calendar_id")).distinct()
    picked = list(selected)
    return ids.filter(~F.col("calendar_id").isin(picked)) if picked else ids


def _ical(t: Tables, ids: Iterable[int] | DataFrame | None, reto: str | None) -> DataFrame:
    active = _active(t, reto).select("id_reto", "nombre_reto")
    return spread_join(t.actividades, selected(active, ids), ["nombre_reto"], ["id_actividad"])


def _escaped(value: Column | str) -> Column:
    """A text as a calendar file writes it: backslash, semicolon, comma and line ends escaped."""
    text = F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"([\\;,])", r"\\$1")
    return F.regexp_replace(text, r"\r\n|\r|\n", r"\\n")


def _folded(line: Column) -> Column:
    """A content line in pieces of at most 75 octets; a continuation starts with a blank. Text beyond ASCII is cut by characters
    of up to four octets."""
    plain = F.octet_length(line) == F.length(line)
    return F.when(F.octet_length(line) <= 75, line).when(plain, F.regexp_replace(line, "(.{74})(?=.)", "$1\r\n ")).otherwise(
        F.regexp_replace(line, "(.{18})(?=.)", "$1\r\n "))


def ical_events(t: Tables, *, ids: Iterable[int] | DataFrame | None = None, reto: str | None = None) -> DataFrame:
    """Activities of the selected active challenges with the escaped texts of a calendar file, times in UTC."""
    step = F.lit("\\n - ")
    return _ical(t, ids, reto).select(
        "id_reto", _escaped("actividad").alias("summary"),
        F.concat(_escaped("nombre_reto"), step, _escaped("tema_actividad"), step, _escaped("coach_expositor")).alias("description"),
        F.date_format(to_utc(F.col("inicio")), ICAL_STAMP).alias("dtstart"),
        F.date_format(to_utc(F.col("fin")), ICAL_STAMP).alias("dtend"), F.lit("Zoom").alias("location"),
        _escaped(F.concat("nombre_reto", F.lit("-"), "actividad", F.lit("-"), F.date_format("inicio", "yyyy-MM-dd HH:mm:ss"))).alias("uid"))


HEAD = ["BEGIN:VCALENDAR", "PRODID:-//tablero//ES", "VERSION:2.0"]
TAIL = "END:VCALENDAR"


def _event() -> Column:
    def line(name: str, value: Column) -> Column:
        return _folded(F.concat(F.lit(f"{name}:"), value))

    return F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), line("UID", F.col("uid")), line("DTSTAMP", F.col("dtstart")), line("DTSTART", F.col("dtstart")),
        line("DTEND", F.col("dtend")), line("SUMMARY", F.col("summary")), line("DESCRIPTION", F.col("description")),
        line("LOCATION", F.col("location")), F.lit("END:VEVENT"))


def ical_text(events: DataFrame) -> DataFrame:
    """Each event as a calendar object of its own; any sequence of such objects is a valid calendar stream."""
    return events.select("id_reto", "dtstart", F.concat_ws("\r\n", *map(F.lit, HEAD), _event(), F.lit(TAIL)).alias("value"))


def write_ical(events: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> None:
    """Write calendar files, one folder per challenge, events in order of time within each file."""
    text = ical_text(events).repartitionByRange("id_reto", "dtstart").sortWithinPartitions("id_reto", "dtstart")
    (text.select("id_reto", "value").write.mode("errorifexists").option("lineSep", "\r\n")
     .option("maxRecordsPerFile", max_records_per_file).partitionBy("id_reto").text(path))


def calendar_parts(events: DataFrame) -> DataFrame:
    """One calendar object per challenge, cut into its events: ``value`` of all rows of a challenge by ``posicion`` is the object, head and tail included.

    Positions run through all challenges in order of challenge, time and text and are computed in jobs that run while this is called. The two ends of a
    challenge are found by their positions, each of which one row has, so a challenge with very many events is no burden.
    """
    order = ["id_reto", "dtstart", "uid", "value"]
    placed = positioned(events.withColumn("value", _event()).select(*order), [F.col(c).asc_nulls_first() for c in order]).drop("dtstart", "uid")
    reach = placed.groupBy("id_reto").agg(F.min("posicion").alias("desde"), F.max("posicion").alias("hasta"))
    ends = reach.select(F.explode(F.array("desde", "hasta")).alias("posicion"), "desde", "hasta").distinct()
    opens, closes = F.col("posicion") == F.col("desde"), F.col("posicion") == F.col("hasta")
    return placed.repartition(parts(events.sparkSession), "posicion").join(ends, "posicion", "left").select(
        "id_reto", "posicion",
        F.concat_ws("\r\n", *(F.when(opens, F.lit(line)) for line in HEAD), F.col("value"), F.when(closes, F.lit(TAIL))).alias("value"))


def write_calendars(parts: DataFrame, path: str) -> None:
    """Writes one folder per challenge (``id_reto=...``) whose files, put together by name, are its calendar file. Tasks take ranges of positions, so several
    write a large calendar, and file names follow the ranges; merging them is a plain copy, for example by ``hdfs dfs -getmerge``."""
    ranged = parts.repartitionByRange("posicion").sortWithinPartitions("id_reto", "posicion")
    ranged.select("id_reto", "value").write.mode("errorifexists").option("lineSep", "\r\n").partitionBy("id_reto").text(path)
