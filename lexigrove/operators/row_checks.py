"""Lines of a delimited log: load the good ones, set the others apart with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.columns import let
from lexigrove.session import BROADCAST_ROWS, broadcast_if_small, materialise

#: Columns of a log line, in order.
LOG_COLUMNS = ["time", "result", "size", "url", "hoppath", "refer", "mime", "thread", "dltime", "sha1", "sourcetag", "annot"]

#: Checked columns in the order in which a line's reason is chosen, with the reason.
CHECKS = [("time", "bad_time"), ("result", "bad_result"), ("size", "bad_size"), ("url", "bad_url")]

# Stand-ins for characters inside quoted columns while a line is split.
_BLANK, _TAB, _MARK = "\u0001", "\u0002", "\u0003"


def _valid(column: str, value: Column) -> Column:
    if column == "time":
        iso = F.regexp_replace(value, r"\A(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{3})\z", "$1-$2-$3T$4:$5:$6.$7Z")
        shape = iso.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}Z\z")
        return shape & F.substring(iso, 1, 10).try_cast("date").isNotNull()
    if column == "result":
        return value.rlike(r"\A-?[0-9]+\z")
    if column == "size":
        return value.rlike(r"\A([0-9]+|-)\z")
    return value.rlike(r"\A[A-Za-z]+://[^/:]+[/:]")


def split_quoted(line: Column) -> Column:
    """struct(sound: quoting is sound, c: columns) of a line whose columns are set apart by blanks and tabs.

    Works on the pieces between quotation marks, so that neither long lines nor
    many quotes make a regular expression backtrack: in a sound line odd pieces lie inside
    quotes, and an even piece between two others is empty (a doubled mark inside a column)
    or begins and ends with a separator. The pieces are made once and all work is linear in the line.
    """
    trimmed = F.btrim(F.rtrim(F.coalesce(line, F.lit("")), F.lit("\r\n")), F.lit(" \t"))

    def blank(c: Column) -> Column:
        return (c == " ") | (c == "\t")

    def split(x: Column) -> Column:
        pieces, n = x["p"], x["n"]
        fits = F.transform(
            pieces,
            lambda p, i: (i % 2 == 1) | (p == "") | (((i == 0) | blank(F.substring(p, 1, 1))) & ((i == n - 1) | blank(F.substring(p, -1, 1)))),
        )
        inside = F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, F.concat(F.when((i > 1) & (F.get(pieces, i - 1) == ""), F.lit("")).otherwise(F.lit(_MARK)), F.translate(p, " \t", _BLANK + _TAB)))
            .when((p == "") & (i > 0) & (i < n - 1), F.lit('"'))
            .otherwise(p),
        )
        columns = F.filter(F.split(F.array_join(inside, ""), r"[ \t]+"), lambda c: c != "")
        plain = F.transform(columns, lambda c: F.translate(F.translate(c, _BLANK + _TAB, " \t"), _MARK, ""))
        return F.struct(((n % 2 == 1) & F.forall(fits, lambda f: f)).alias("sound"), plain.alias("c"))

    return let(F.split(trimmed, '"', -1), lambda p: let(F.struct(p.alias("p"), F.size(p).alias("n")), split))


def check_rows(lines: DataFrame, id_col: str = "line_id", line_col: str = "line", limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per line: id, reason (NULL for a good line) and the twelve columns as text.

    Structural reasons come from the line alone. Each distinct value of a checked
    column is tested once; the failing ones form a dictionary (column, value, reason)
    that is written to the shared folder, counted by column, and joined back - a column's part broadcast while it holds
    at most `limit` rows, by a shuffled join beyond that.

    NULL, empty and blank lines are `too_few_fields`; a NULL id is kept; repeated lines give
    repeated rows; an empty table gives no rows; other columns of the input are left out,
    whatever their names.
    """
    parsed = lines.select(F.col(id_col).alias("id"), F.explode(F.array(split_quoted(F.col(line_col)))).alias("x")).select("id", "x.sound", "x.c")
    n = F.size("c")
    parsed = parsed.select(
        "id",
        F.when(~F.col("sound"), "broken_quote").when(n < len(LOG_COLUMNS), "too_few_fields").when(n > len(LOG_COLUMNS), "too_many_fields").alias("structural"),
        *[F.get("c", F.lit(i)).alias(name) for i, name in enumerate(LOG_COLUMNS)],
    )
    parsed = materialise(parsed)  # lines are read and split once
    values = parsed.filter("structural is null").select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c, _ in CHECKS])).alias("x")).select("x.k", "x.v").distinct()
    reason = F.coalesce(*[F.when((F.col("k") == c) & ~F.coalesce(_valid(c, F.col("v")), F.lit(False)), r) for c, r in CHECKS])
    invalid = materialise(values.withColumn("r", reason).filter("r is not null"))
    sizes = {r["k"]: r["count"] for r in invalid.groupBy("k").count().collect()}
    out = parsed
    for c, r in CHECKS:
        side = invalid.filter(F.col("k") == c).select(F.col("v").alias(c), F.col("r").alias(f"why_{c}"))
        out = out.join(broadcast_if_small(side, sizes.get(c, 0), limit), c, "left")
    failed = F.coalesce(F.col("structural"), *[F.col(f"why_{c}") for c, _ in CHECKS])
    return out.select(F.col("id").alias(id_col), failed.alias("reason"), *LOG_COLUMNS)


def load_rows(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """The good lines only, typed: time as timestamp, result and size as bigint ('-' is NULL)."""
    iso = F.regexp_replace("time", r"\A(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{3})\z", "$1-$2-$3T$4:$5:$6.$7Z")
    good = check_rows(lines, id_col, line_col).filter("reason is null")
    typed = {"time": iso.cast("timestamp"), "result": F.col("result").try_cast("bigint"), "size": F.col("size").try_cast("bigint")}
    return good.select(id_col, *[typed.get(c, F.col(c)).alias(c) for c in LOG_COLUMNS])
