"""Event envelopes: spool text, parsing and validation, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATA, ENVELOPE

PREFIX = "TELEMETRY_V1|"
#: Slots that hold nothing: an empty value and the literal two escaped zeros.
EMPTY_SLOTS = ("", r"\0\0")


def decode_spool(lines: DataFrame, column: str = "value") -> DataFrame:
    """Values of spool lines ``string[]|slot_..|base64|..``: value (null if undecodable) and raw.

    Base64 must be padded to a multiple of four and hold UTF-8.
    """
    rows = lines.where(F.col(column).startswith("string[]|slot_"))
    slots = F.split(column, r"\|")
    raw = rows.select(F.explode(F.slice(slots, 3, F.greatest(F.size(slots) - 2, F.lit(0)))).alias("raw")).where(~F.col("raw").isin(*EMPTY_SLOTS))
    decoded = F.when(F.length("raw") % 4 == 0, F.expr("try_to_binary(raw, 'base64')"))
    return raw.select(F.when(F.is_valid_utf8(decoded.cast("string")), decoded.cast("string")).alias("value"), "raw")


def validate(e: str = "e", data: str = "data") -> Column:
    """The first error of a parsed envelope, null if it is sound."""
    c = lambda f: F.col(f"{e}.{f}")
    error = F.when(F.col(e).isNull() | c("_corrupt").isNotNull(), "invalid JSON")
    for f in ("v", "seq", "ts", "type", "server_session", "round", "data"):
        error = error.when(c(f).isNull(), f"invalid {f}")
    return error.when(F.expr(f"not coalesce(schema_of_variant(try_parse_json({e}.data)) like 'OBJECT%', false)"), "invalid data").when((c("v") != 1) | (c("seq") < 1), "unsupported version or sequence").when((c("type") == "") | (c("server_session") == ""), "empty type or server_session")


def parse_envelopes(lines: DataFrame, column: str = "value", prefix: str = PREFIX) -> DataFrame:
    """One row per line: the envelope's fields, the line and the error (null for sound ones).

    The envelope comes out of a generator of one row: filters on its fields or the error are not pushed below that, where
    they would parse the line again for each field that they name.
    """
    text = F.rtrim(F.col(column), F.lit("\r\n"))
    body = F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30))
    parsed = lines.select(F.col(column).alias("line"), body.alias("body"), F.explode_outer(F.array(F.from_json(body, ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))).alias("e"))
    error = F.when(F.col("body").isNull(), "prefix mismatch").otherwise(validate())
    fields = ["seq", "ts", "type", "server_session", "round", "player", "game_ms", "data"]
    return parsed.select("line", *(F.col(f"e.{f}").alias(f) for f in fields), error.alias("error"))


def split_dead_letters(parsed: DataFrame, keep: int = 256) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and (error, first ``keep`` characters) of the others."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("error", F.left("line", F.lit(keep)).alias("head"))


def to_events(sound: DataFrame) -> DataFrame:
    """Bronze events: instants in microseconds, empty round and player as null, payload as JSON and as typed fields."""
    return sound.select(
        "seq",
        F.unix_micros(F.try_to_timestamp("ts")).alias("t_us"),
        "type",
        F.col("server_session").alias("server"),
        F.nullif("round", F.lit("")).alias("round_id"),
        F.nullif("player", F.lit("")).alias("player_id"),
        "game_ms",
        "data",
        F.from_json("data", DATA).alias("d"),
        "line",
    )
