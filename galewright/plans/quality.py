"""Queries of the data-quality problems over the turbine and search tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewright.operators.gridding import regular_grid
from galewright.operators.imputation import fill_category, fill_numbers, text_or_null
from galewright.operators.spikes import Field, implausible_values
from galewright.operators.orphans import Reference, apply_deltas, change_deltas, current_orphans, orphan_references, report_per_month
from galewright.operators.timestamps import with_instant
from galewright.operators.topn import top_n_per_group
from galewright.session import epoch_seconds, table

NAME = "wind_turbine_name"
#: What the sensors can read at all: degrees, degrees Celsius, kilovar.
LIMITS = {"ba_avg": (-180.0, 180.0), "rt_avg": (-90.0, 150.0), "q_avg": (-20_000.0, 20_000.0)}
REFERENCES = [
    Reference("cnn_genome", "exact_id", "exact_search"),
    Reference("cnn_node", "genome_id", "cnn_genome"),
    Reference("cnn_edge", "genome_id", "cnn_genome"),
    Reference("cnn_edge", "input_node_innovation_number", "cnn_node", columns=("genome_id", "input_node_innovation_number"), target_columns=("genome_id", "innovation_number"), target_end=None),
]


#: Power is held against the torque, in shares of the turbine's full power; wind and temperature against their second sensor.
CHECKED = [
    Field("p_avg", ("cm_avg",), least=0.1, low=-0.2, high=1.3, scaled=True, relative=True),
    Field("ws_avg", ("ws2_avg", "ws1_avg"), least=3.0, low=0.0, high=50.0),
    Field("db1t_avg", ("db2t_avg",), least=4.0, low=-45.0, high=130.0),
]


def named_readings(df: DataFrame) -> DataFrame:
    """The readings with the turbine's name filled from its file."""
    return fill_category(df, NAME, [["source_file"]], F.nullif(F.regexp_extract("source_file", r"turbine_([^_]+)_", 1), F.lit("")))


def filled_readings(df: DataFrame) -> DataFrame:
    """The readings with names, pitch angle, hub temperature and reactive power filled and marked."""
    timed = with_instant(named_readings(df), "date_time", "__utc", received="received_at")
    at = F.coalesce(F.col("__utc"), epoch_seconds(timed, "received_at"))
    keyed = timed.withColumns({"__hour": F.floor(at / 3600), "__day": F.floor(at / 86400)})
    levels = [[NAME, "__hour"], [NAME, "__day"], [NAME], ["__day"], []]
    return fill_numbers(keyed, LIMITS, levels).drop("__utc", "__hour", "__day")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = sorted({f.name for f in CHECKED} | {c for f in CHECKED for c in f.companion})
    df = table(spark, sf_dir, "turbine_readings").select("rec_id", NAME, "date_time", "received_at", "source_file", *signals)
    named = named_readings(df)
    named = named.withColumn("__arrived", epoch_seconds(named, "received_at") - 300)
    timed = with_instant(named, "date_time", "__utc", received="received_at")
    return implausible_values(timed, "rec_id", NAME, "__utc", CHECKED, "__arrived")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible values counted per turbine file and field."""
    files = table(spark, sf_dir, "turbine_readings").select("rec_id", "source_file")
    return p1_found(spark, sf_dir).join(files, "rec_id").groupBy("source_file", "field").agg(F.count("*").alias("n"))


def _search_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("exact_search", "cnn_genome", "cnn_node", "cnn_edge")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphan_references(_search_tables(spark, sf_dir), REFERENCES)
    return found.select("table_name", F.col("row_id").cast("int").alias("row_id"), "ref_field").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_per_month(orphan_references(_search_tables(spark, sf_dir), REFERENCES))


def p2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that live rows refer to and no live row has, kept up from two increments: what was inserted or deleted up to the middle of 2020, and after."""
    deltas = change_deltas(_search_tables(spark, sf_dir), REFERENCES)
    cut = F.col("at") < 1_593_561_600_000_000
    state = apply_deltas(apply_deltas(None, deltas.where(cut)), deltas.where(~cut))
    return current_orphans(state, REFERENCES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["rec_id", NAME, "date_time", "received_at", "source_file", *LIMITS]
    filled = filled_readings(table(spark, sf_dir, "turbine_readings").select(*columns))
    fields = [*LIMITS, NAME]
    found = F.filter(F.array(*[F.when(F.col(f"{c}_missing") & ~F.coalesce(F.col(f"{c}_fill_level") == 0, F.lit(False)), F.lit(c)) for c in fields]), lambda c: c.isNotNull())
    return filled.select("rec_id", F.explode(found).alias("field"))


def p3_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["rec_id", NAME, "date_time", "received_at", "source_file", *LIMITS]
    return filled_readings(table(spark, sf_dir, "turbine_readings").select(*columns)).drop("date_time", "received_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_n_per_group(table(spark, sf_dir, "cnn_genome"), "exact_id", "best_validation_error", "id", 5, heavy_rows=1_000)
    return top.select("exact_id", F.col("id").alias("genome_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "turbine_readings").select("rec_id", "date_time", "received_at")
    return with_instant(df, "date_time", "utc_s", received="received_at").where("utc_s IS NOT NULL").select("rec_id", "utc_s")


def gridded(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    df = table(spark, sf_dir, "turbine_readings").select(NAME, "date_time", "received_at", "source_file", *values)
    timed = with_instant(named_readings(df), "date_time", "utc_s", received="received_at")
    return regular_grid(timed, NAME, "utc_s", values)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots inside which the kernel has no weight."""
    return gridded(spark, sf_dir, []).where("is_empty").select(NAME, "slot_s")


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 3).alias(c)  # noqa: E731  # sums in another order differ in later places
    grid = gridded(spark, sf_dir, ["p_avg", "ws_avg"])
    return grid.select(NAME, "slot_s", "n", "is_empty", r("support"), *[c for v in ("p_avg", "ws_avg") for c in (r(v), r(f"{v}_support"), f"{v}_missing")])


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_report, p2_current, p3_found, p3_filled, p4_found, p5_found, p6_found, p6_grid)}


def _orphans(source: str, field: str, target: str, on: str, deletes: bool = True) -> str:
    live = "t.inserted_at <= r.inserted_at" + (" AND (t.deleted_at IS NULL OR t.deleted_at > r.inserted_at)" if deletes else "")
    now = "t.deleted_at IS NULL" if deletes else "TRUE"
    given = f"r.genome_id IS NOT NULL AND r.{field} IS NOT NULL" if "innovation" in field else f"r.{field} IS NOT NULL"
    return f"""SELECT DISTINCT '{source}' AS table_name, r.id AS row_id, '{field}' AS ref_field, strftime(r.inserted_at, '%Y-%m') AS month FROM {source} r
    WHERE {given} AND (NOT EXISTS (SELECT 1 FROM {target} t WHERE {on} AND {live}) OR NOT EXISTS (SELECT 1 FROM {target} t WHERE {on} AND {now}))"""


_ORPHANS = " UNION ALL ".join(
    [
        _orphans("cnn_genome", "exact_id", "exact_search", "t.id = r.exact_id"),
        _orphans("cnn_node", "genome_id", "cnn_genome", "t.id = r.genome_id"),
        _orphans("cnn_edge", "genome_id", "cnn_genome", "t.id = r.genome_id"),
        _orphans("cnn_edge", "input_node_innovation_number", "cnn_node", "t.genome_id = r.genome_id AND t.innovation_number = r.input_node_innovation_number", False),
    ]
)

_CURRENT = """WITH k AS (SELECT 'exact_search(id)' AS kind, CAST(exact_id AS VARCHAR) AS key, 0 AS e, 1 AS r FROM cnn_genome WHERE exact_id IS NOT NULL AND deleted_at IS NULL
UNION ALL SELECT 'cnn_genome(id)', CAST(genome_id AS VARCHAR), 0, 1 FROM cnn_node WHERE genome_id IS NOT NULL UNION ALL SELECT 'cnn_genome(id)', CAST(genome_id AS VARCHAR), 0, 1 FROM cnn_edge WHERE genome_id IS NOT NULL
UNION ALL SELECT 'cnn_node(genome_id,innovation_number)', concat(genome_id, ':', input_node_innovation_number), 0, 1 FROM cnn_edge WHERE genome_id IS NOT NULL AND input_node_innovation_number IS NOT NULL
UNION ALL SELECT 'exact_search(id)', CAST(id AS VARCHAR), 1, 0 FROM exact_search WHERE id IS NOT NULL AND deleted_at IS NULL UNION ALL SELECT 'cnn_genome(id)', CAST(id AS VARCHAR), 1, 0 FROM cnn_genome WHERE id IS NOT NULL AND deleted_at IS NULL
UNION ALL SELECT 'cnn_node(genome_id,innovation_number)', concat(genome_id, ':', innovation_number), 1, 0 FROM cnn_node WHERE genome_id IS NOT NULL AND innovation_number IS NOT NULL)
SELECT kind, key, CAST(sum(r) AS BIGINT) AS refs FROM k GROUP BY kind, key HAVING sum(r) > 0 AND sum(e) = 0"""

_NUMBER_MISSING = "({c} IS NULL OR isnan({c}) OR {c} IN (-9999.0, -999.99, -999.0, 9999.0, 32767.0))"

_CLOCK = r"(?P<h>\d{1,2}):(?P<n>\d{2})(?::(?P<s>\d{2})(?:\.\d+)?)?"


def _format_sql(pattern: str, zone: str, month: str = "x.m", hour: str = "TRY_CAST(x.h AS INT)") -> str:
    """Rows of one format: the wall clock and its offset in minutes (null without zone)."""
    named = re.findall(r"\?P<(\w+)>", pattern)
    plain = re.sub(r"\?P<\w+>", "", pattern)
    text = f"concat_ws('-', x.y, {month}, x.d) || ' ' || concat_ws(':', {hour}, x.n, coalesce(nullif(x.s, ''), '00'))"
    return f"""SELECT rec_id, r, try_strptime({text}, '%Y-%m-%d %H:%M:%S') AS w, {zone} AS z
    FROM (SELECT rec_id, r, regexp_extract(t, '^{plain}$', {named}) AS x FROM src WHERE regexp_full_match(t, '{plain}'))"""


_SIGNED = "CASE WHEN x.z IN ('', 'Z', 'UTC') THEN CASE WHEN x.z <> '' THEN 0 END ELSE (CASE WHEN x.z[1] = '-' THEN -1 ELSE 1 END) * (TRY_CAST(x.z[2:3] AS INT) * 60 + TRY_CAST(right(x.z, 2) AS INT)) END"
_MONTH = "lpad(CAST((position(x.m IN 'JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC') + 2) // 3 AS VARCHAR), 2, '0')"
# The European rule: summer time from the last Sunday of March to that of October, 01:00 UTC.
_INSTANTS = "src AS (SELECT rec_id, epoch(received_at) AS r, upper(trim(date_time, ' ' || chr(9))) AS t FROM turbine_readings), wall AS (" + " UNION ALL ".join(
    [
        _format_sql(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})[T ]" + _CLOCK + r" ?(?P<z>Z|UTC|[+-]\d{2}:?\d{2})?", _SIGNED),
        _format_sql(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<n>\d{2})(?P<s>\d{2})(?P<z>[+-]\d{4})", _SIGNED),
        _format_sql(r"(?P<m>\d{2})/(?P<d>\d{2})/(?P<y>\d{4}) " + _CLOCK + r" (?P<a>[AP])M", "NULL", hour="TRY_CAST(x.h AS INT) % 12 + CASE WHEN x.a = 'P' THEN 12 ELSE 0 END"),
        _format_sql(r"(?P<d>\d{2})[./](?P<m>\d{2})[./](?P<y>\d{4}) " + _CLOCK, "NULL"),
        _format_sql(r"(?P<d>\d{2})-(?P<m>[A-Z]{3})-(?P<y>\d{4}) " + _CLOCK + r" (?P<z>CES?T)", "CASE WHEN x.z = 'CET' THEN 60 ELSE 120 END", month=_MONTH),
    ]
) + """), turns AS (SELECT rec_id, r, z, CAST(epoch(w) AS BIGINT) AS l, CAST(epoch(make_date(year(w), 3, 31) - CAST(dayofweek(make_date(year(w), 3, 31)) AS INT)) AS BIGINT) + 3600 AS a,
CAST(epoch(make_date(year(w), 10, 31) - CAST(dayofweek(make_date(year(w), 10, 31)) AS INT)) AS BIGINT) + 3600 AS b FROM wall WHERE w IS NOT NULL),
instants AS (SELECT rec_id, l - z * 60 AS utc_s FROM turns WHERE z IS NOT NULL
UNION ALL SELECT rec_id, CASE WHEN (l - 3600 < a OR l - 3600 >= b) AND (l - 3600 <= r OR NOT (l - 7200 >= a AND l - 7200 < b)) THEN l - 3600 WHEN l - 7200 >= a AND l - 7200 < b THEN l - 7200 END FROM turns WHERE z IS NULL
UNION ALL SELECT rec_id, TRY_CAST(t AS BIGINT) // CASE WHEN length(t) > 11 THEN 1000 ELSE 1 END FROM src WHERE regexp_full_match(t, '\\d{9,14}'))"""

ORACLES = {
    "p5_found": f"WITH {_INSTANTS} SELECT rec_id, utc_s FROM instants WHERE utc_s IS NOT NULL",
    "p6_found": f"""WITH {_INSTANTS}, f AS (SELECT DISTINCT regexp_extract(source_file, 'turbine_([^_]+)_', 1) AS wind_turbine_name, utc_s - utc_s % 600 AS slot_s FROM instants JOIN turbine_readings USING (rec_id) WHERE utc_s IS NOT NULL),
    g AS (SELECT wind_turbine_name, unnest(range(min(slot_s), max(slot_s) + 1, 600)) AS slot_s FROM f GROUP BY wind_turbine_name) SELECT * FROM g ANTI JOIN f USING (wind_turbine_name, slot_s)""",
    "p2_found": f"SELECT DISTINCT table_name, row_id, ref_field FROM ({_ORPHANS})",
    "p2_report": f"SELECT table_name, ref_field, month, count(DISTINCT row_id) AS n_rows FROM ({_ORPHANS}) GROUP BY ALL",
    "p2_current": _CURRENT,
    "p3_found": " UNION ALL ".join([f"SELECT rec_id, '{c}' AS field FROM turbine_readings WHERE {_NUMBER_MISSING.format(c=c)}" for c in LIMITS]
    + ["SELECT rec_id, 'wind_turbine_name' AS field FROM turbine_readings WHERE wind_turbine_name IS NULL OR lower(trim(wind_turbine_name)) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'unknown', '-', '?')"]),
    "p4_found": """SELECT exact_id, id AS genome_id FROM (SELECT exact_id, id, row_number() OVER (PARTITION BY exact_id ORDER BY e, id) AS r FROM
    (SELECT exact_id, id, min(best_validation_error) AS e FROM cnn_genome WHERE exact_id IS NOT NULL AND id IS NOT NULL AND best_validation_error IS NOT NULL
     AND NOT isnan(best_validation_error) GROUP BY exact_id, id)) WHERE r <= 5""",
}
