"""References whose target is missing, deleted or late (problem 2).

Rows of every table become signed change deltas per (reference kind, key): a target row counts +1 existence at its insertion and -1 at
its deletion, a referring row +1 reference at its insertion and -1 at its own deletion. A state of these counts per key is kept
up by `apply_deltas`, and keys with positive references and no existence are the current report. For the references that
were wrong at their own time, counts per key and day tell the days on which all references are sound; the rows of the others are written
to the shared folder, summed per instant, and running existence is worked out by minutes. Rows join the instants' verdicts with a salt. No task holds
more than one key's one minute of different instants.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewright.operators.prefix import running
from galewright.session import cut_lineage, union_all

DAY_US, MINUTE_US = 86_400_000_000, 60_000_000
ALWAYS = 2**62


@dataclass(frozen=True)
class Reference:
    """One kind of reference: columns of a referring table that name the key columns of a target table."""

    table: str
    field: str
    target: str
    row_id: str = "id"
    columns: tuple[str, ...] = ()
    target_columns: tuple[str, ...] = ("id",)
    at: str = "inserted_at"
    target_at: str = "inserted_at"
    target_end: str | None = field(default="deleted_at")

    @property
    def keys(self) -> tuple[str, ...]:
        return self.columns or (self.field,)


def _micros(df: DataFrame, name: str | None) -> Column:
    if name is None or name not in df.columns:
        return F.lit(None).cast("bigint")
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(c.cast("timestamp"))


def _key(columns: tuple[str, ...]) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def _kinds(references: list[Reference]) -> list[str]:
    return list(dict.fromkeys(f"{r.target}({','.join(r.target_columns)})" for r in references))


def _kind(r: Reference, kinds: list[str]) -> Column:
    return F.lit(kinds.index(f"{r.target}({','.join(r.target_columns)})")).cast("int")


def _targets(tables: dict[str, DataFrame], references: list[Reference]) -> list[DataFrame]:
    """``(kind, key, at, until)`` of target rows; one without time has always been there, one that ends before it begins never was."""
    out, kinds, seen = [], _kinds(references), set()
    for r in references:
        if (r.target, r.target_columns) not in seen:
            seen.add((r.target, r.target_columns))
            t = tables[r.target]
            live = t.where(" AND ".join(f"`{c}` IS NOT NULL" for c in r.target_columns)).select(
                _kind(r, kinds).alias("kind"), _key(r.target_columns).alias("key"), F.coalesce(_micros(t, r.target_at), F.lit(-ALWAYS)).alias("at"), _micros(t, r.target_end).alias("until")
            )
            out.append(live.where("until IS NULL OR until > at"))
    return out


def _referring(tables: dict[str, DataFrame], references: list[Reference]) -> list[DataFrame]:
    """``(kind, key, at, until, source, row_id)`` of referring rows, ``source`` the reference's number; a null in a key refers to nothing, a row without time is
    asked about the end of all data."""
    out, kinds = [], _kinds(references)
    for k, r in enumerate(references):
        t = tables[r.table]
        named = t.where(" AND ".join(f"`{c}` IS NOT NULL" for c in r.keys))
        out.append(
            named.select(
                _kind(r, kinds).alias("kind"), _key(r.keys).alias("key"), F.coalesce(_micros(t, r.at), F.lit(ALWAYS)).alias("at"), _micros(t, "deleted_at").alias("until"),
                F.lit(k).alias("source"), F.col(r.row_id).cast("bigint").alias("row_id"),
            )
        )
    return out


def change_deltas(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """``(kind, key, at, exists, refs, made)``: signed existence and reference deltas, and references made, summed per key and instant; ``kind`` is the target's number.
    At equal times deletions and insertions come before references."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    out = []
    for frames, exists, refs in ((_targets(tables, references), one, none), (_referring(tables, references), none, one)):
        for df in frames:
            begins = F.struct(F.col("at"), exists.alias("exists"), refs.alias("refs"), refs.alias("made"))
            ends = F.struct(F.col("until").alias("at"), (-exists).alias("exists"), (-refs).alias("refs"), none.alias("made"))
            out.append(df.select("kind", "key", F.inline(F.when(F.col("until").isNull(), F.array(begins)).otherwise(F.array(begins, ends)))))
    return union_all(out).groupBy("kind", "key", "at").agg(*[F.sum(c).alias(c) for c in ("exists", "refs", "made")])


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The state ``(kind, key, exists, refs)`` after some deltas: signed counts per key; keys that came to nothing go. Deltas of a table's new
    rows alone, added to the state before them, give what all rows would."""
    new = deltas.select("kind", "key", "exists", "refs")
    both = new if state is None else state.unionByName(new)
    return both.groupBy("kind", "key").agg(F.sum("exists").alias("exists"), F.sum("refs").alias("refs")).where("exists <> 0 OR refs <> 0")


def current_orphans(state: DataFrame, references: list[Reference]) -> DataFrame:
    """The current report: keys with positive references and no existence, ``(kind, key, refs)`` with the target's name as kind."""
    names = F.array(*[F.lit(k) for k in _kinds(references)])
    return state.where("refs > 0 AND exists <= 0").select(names[F.col("kind")].alias("kind"), "key", "refs")


def orphan_keys(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """The current report of whole tables."""
    return current_orphans(apply_deltas(None, change_deltas(tables, references)), references)


def _rows(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """``(kind, key, day, at, exists, made, source, row_id)``: existence changes and referring rows, unsummed."""
    day, whole, nothing = F.floor(F.col("at") / DAY_US).alias("day"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    lives = F.array(F.struct(F.col("at"), F.lit(1).alias("exists")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("exists")))
    out = []
    for t in _targets(tables, references):
        changes = t.select("kind", "key", F.inline(lives)).where("at IS NOT NULL")
        out.append(changes.select("kind", "key", day, "at", F.col("exists").cast("bigint").alias("exists"), nothing.alias("made"), F.lit(None).cast("int").alias("source"), F.lit(None).cast("bigint").alias("row_id")))
    out += [r.select("kind", "key", day, "at", nothing.alias("exists"), whole.alias("made"), "source", "row_id") for r in _referring(tables, references)]
    return union_all(out)


def counts_per_key_day(rows: DataFrame) -> DataFrame:
    """``(kind, key, day, made, changed, first_made, last_change, before, after, exists_now)``: references made and existence changes of each key and day, when
    the first reference and the last change were, the existence before and after that day, and after all days."""
    is_change = F.col("exists") != 0
    per_day = rows.groupBy("kind", "key", "day").agg(
        F.sum("exists").alias("exists"), F.sum("made").alias("made"), F.max(F.when(is_change, F.col("at"))).alias("last_change"), F.min(F.when(~is_change, F.col("at"))).alias("first_made")
    )
    by_key = Window.partitionBy("kind", "key")
    so_far = F.sum("exists").over(by_key.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per_day.select(
        "kind", "key", "day", "made", "first_made", "last_change", (so_far - F.col("exists")).alias("before"), so_far.alias("after"), F.sum("exists").over(by_key).alias("exists_now")
    )


def orphan_references(tables: dict[str, DataFrame], references: list[Reference], salts: int = 8) -> DataFrame:
    """``(table_name, ref_field, row_id, at, reason)`` of each referring row without a live target at its own time
    (``missing then``) or without any undeleted target in all the data (``missing now``; it wins where both hold).

    Exact repeats of a referring row come out as often as they stand there; take ``distinct`` for a set. ``at`` is in
    microseconds since 1970. A referring row's own deletion doesn't matter here. Empty tables give no rows; further columns are never looked at.
    """
    rows = _rows(tables, references)
    totals = counts_per_key_day(rows)
    # With existence now, and all of the day's changes before its references and existence after them, all references of a key and day are sound.
    sound = "exists_now > 0 AND after > 0 AND coalesce(last_change <= first_made, true)"
    doubtful = totals.where(f"made > 0 AND NOT ({sound})").select("kind", "key", "day", "before", "exists_now")
    asked = cut_lineage(rows.join(doubtful, ["kind", "key", "day"]))
    same = ["kind", "key", "day", "before", "exists_now"]
    instants = asked.groupBy(*same, "at").agg(F.sum("exists").alias("exists"), F.sum("made").alias("made"))
    summed = running(instants, ["kind", "key", "day"], ["at"], F.floor(F.col("at") / MINUTE_US), F.col("exists"), "live")
    wrong = summed.where("made > 0 AND (before + live <= 0 OR exists_now <= 0)")
    reason = F.when(F.col("exists_now") <= 0, "missing now").otherwise("missing then")
    # One verdict per key and instant; rows find theirs under a salt, so that an instant that many rows share is spread.
    verdicts = wrong.select("kind", "key", "at", reason.alias("reason"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    names = F.array(*[F.struct(F.lit(r.table).alias("table_name"), F.lit(r.field).alias("ref_field")) for r in references])
    referring = asked.where("made > 0").select("kind", "key", "at", "source", "row_id", F.pmod(F.hash("source", "row_id"), F.lit(salts)).alias("salt"))
    found = referring.join(verdicts, ["kind", "key", "at", "salt"])
    return found.select(names[F.col("source")]["table_name"].alias("table_name"), names[F.col("source")]["ref_field"].alias("ref_field"), "row_id", "at", "reason")


def report_per_month(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per table, field and month of the referring row."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return orphans.groupBy("table_name", "ref_field", month.alias("month")).agg(F.countDistinct("row_id").alias("n_rows"))
