"""Missing values filled from similar records, with marks (problem 3).

Hierarchical group statistics: the finest group with enough support gives the value, its median for numbers and its
mode for categories; coarser groups are asked where the finer one is too thin. Statistics are partial aggregates over
all rows; only the rows that miss something are joined with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewright.session import cut_lineage

# Numbers that loggers write for "no value".
STAND_IN_NUMBERS = [-99999.0, -32768.0, -9999.0, -999.99, -999.9, -999.0, 999.99, 999.9, 9999.0, 32767.0, 65535.0, 99999.0, 2147483647.0]
# Texts that stand for "no value", in lower case.
STAND_IN_TEXTS = ["", "-", "--", "?", "n/a", "na", "n.a.", "nan", "nil", "none", "not set", "null", "tbd", "unknown", "undefined", "missing"]


BLANKS = " \t\n\r\u000b\u000c\u00a0\u2003\u3000\ufeff"


def number_or_null(name: str, low: float, high: float) -> Column:
    """The number, or null where it is null, NaN, a stand-in or outside what the sensor can read."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c) & c.between(low, high) & ~c.isin(STAND_IN_NUMBERS), c)


def text_or_null(name: str) -> Column:
    """The text without blanks around it, or null where it is null, blank or a stand-in."""
    c = F.btrim(F.col(name), F.lit(BLANKS))
    return F.when(~F.lower(c).isin(STAND_IN_TEXTS), c)


def fill_category(df: DataFrame, name: str, levels: Sequence[Sequence[str]], fallback: Column | None = None, min_support: int = 1) -> DataFrame:
    """``df`` with ``name`` filled by the mode of the finest group of ``levels`` that has ``min_support`` values.

    Ties go to the lowest text. A value that is no group's mode at the finest level although it stands in several
    groups counts as a stand-in too: no source is called so. ``{name}_fill_level`` is 0 for a value of the row's own,
    1.. for the level that filled it, ``len(levels) + 1`` for ``fallback``, null if nothing could fill it;
    ``{name}_filled`` marks filled values, ``{name}_missing`` those that were missing. Columns of these names are
    replaced.
    """
    made = [f"{name}_{x}" for x in ("missing", "filled", "fill_level")]
    own = df.drop(*made).withColumn("__gw_own", text_or_null(name))
    counts = own.where("__gw_own IS NOT NULL").groupBy(*levels[0], "__gw_own").agg(F.count("*").alias("__gw_n"))
    best = F.max_by("__gw_own", F.struct("__gw_n", _descending_text("__gw_own")))
    modes = []
    for level in levels:
        by = counts.groupBy(*level, "__gw_own").agg(F.sum("__gw_n").alias("__gw_n")) if level != levels[0] else counts
        modes.append(by.groupBy(*level).agg(best.alias("__gw_mode"), F.sum("__gw_n").alias("__gw_n")).where(F.col("__gw_n") >= min_support))
    called = modes[0].select(F.col("__gw_mode").alias("__gw_own")).distinct()
    spread = counts.groupBy("__gw_own").agg(F.count("*").alias("__gw_k")).where("__gw_k > 1").select("__gw_own")
    strangers = spread.join(called, "__gw_own", "left_anti").withColumn("__gw_odd", F.lit(True))
    out = own.join(strangers, "__gw_own", "left").withColumn("__gw_own", F.when(F.col("__gw_odd").isNull(), F.col("__gw_own"))).drop("__gw_odd")
    value, level_no = F.col("__gw_own"), F.when(F.col("__gw_own").isNotNull(), 0)
    for i, (level, mode) in enumerate(zip(levels, modes), 1):
        out = out.join(mode.select(*level, F.col("__gw_mode").alias(f"__gw_m{i}")), list(level), "left")
        value, level_no = F.coalesce(value, F.col(f"__gw_m{i}")), F.coalesce(level_no, F.when(F.col(f"__gw_m{i}").isNotNull(), i))
    if fallback is not None:
        value, level_no = F.coalesce(value, fallback), F.coalesce(level_no, F.when(fallback.isNotNull(), len(levels) + 1))
    keep = [F.col(c) if c != name else value.alias(name) for c in df.columns if c not in made]
    level_no = level_no.cast("int")
    return out.select(*keep, F.col("__gw_own").isNull().alias(made[0]), (level_no > 0).alias(made[1]), level_no.alias(made[2]))


def _descending_text(name: str) -> Column:
    """A key under which the lowest text is the greatest: code points turned round."""
    return F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c))


def fill_numbers(df: DataFrame, limits: dict[str, tuple[float, float]], levels: Sequence[Sequence[str]], min_support: int = 3, accuracy: int = 1000) -> DataFrame:
    """``df`` with the number columns of ``limits`` filled by medians, level by level.

    A value is missing if it is null, NaN, a stand-in, or outside its ``limits``. ``levels`` go from fine to coarse and
    end, if the caller wants every value filled, with ``[]`` (all rows). Medians are exact for groups of up to
    ``accuracy`` values and within 1/``accuracy`` of the rank beyond. The marks are those of `fill_category`. Rows
    with nothing missing only pass through.
    """
    names = list(limits)
    made = {f"{c}_{x}" for c in names for x in ("missing", "filled", "fill_level")}
    base = df.select(*[c for c in df.columns if c not in made and c not in names], *[number_or_null(c, *limits[c]).alias(c) for c in names])
    marked = base.withColumns({f"{c}_missing": F.col(c).isNull() for c in names})
    # Every level reads the cleaned rows again: from files, not by parsing them anew.
    marked = cut_lineage(marked)
    lacking = " OR ".join(f"`{c}_missing`" for c in names)
    whole, gaps = marked.where(f"NOT ({lacking})"), marked.where(lacking)
    value, level_no = {c: F.col(c) for c in names}, {c: F.when(F.col(c).isNotNull(), 0) for c in names}
    for i, level in enumerate(levels, 1):
        stats = marked.groupBy(*level).agg(
            *[F.percentile_approx(c, F.lit(0.5), F.lit(accuracy)).alias(f"__gw_v{i}_{c}") for c in names], *[F.count(c).alias(f"__gw_n{i}_{c}") for c in names]
        )
        gaps = gaps.join(stats, list(level), "left") if level else gaps.crossJoin(F.broadcast(stats))  # one row of statistics
        for c in names:
            usable = F.when(F.col(f"__gw_n{i}_{c}") >= min_support, F.col(f"__gw_v{i}_{c}"))
            value[c], level_no[c] = F.coalesce(value[c], usable), F.coalesce(level_no[c], F.when(usable.isNotNull(), i))
    order = [c for c in df.columns if c not in made]

    def result(x: DataFrame, filled: bool) -> DataFrame:
        level = {c: level_no[c].cast("int") if filled else F.lit(0) for c in names}
        return x.select(
            *[value[c].alias(c) if filled and c in names else F.col(c) for c in order],
            *[y for c in names for y in (F.col(f"{c}_missing"), (level[c] > 0).alias(f"{c}_filled"), level[c].alias(f"{c}_fill_level"))],
        )

    return result(whole, False).unionByName(result(gaps, True))
