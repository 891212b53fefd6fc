"""Behaviour logs: dirty-data split, repair of the new-visitor flag, and the start/page/display split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LOG

CORRUPT = "_corrupt"


@dataclass
class Split:
    """What one input divides into; each is a filter over the same rows."""

    clean: DataFrame
    dirty: DataFrame


def parsed(raw: DataFrame, schema: str = LOG, value: str = "value") -> DataFrame:
    """raw with ``doc``, the parsed document, and ``dirty``."""
    doc = F.from_json(F.col(value), f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return raw.withColumn("doc", doc).withColumn("dirty", F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull())


def complete() -> Column:
    """Whether a parsed log has a ``common`` part and a ``start`` or a ``page``."""
    return F.col("doc.common").isNotNull() & (F.col("doc.page").isNotNull() | F.col("doc.start").isNotNull())


def split_dirty(raw: DataFrame, value: str = "value", required: Column | None = None) -> Split:
    """Rows that are no JSON object, or lack what is required (as ``complete``), apart from the others.

    Clean rows keep their text, with fields that the schema does not name.
    """
    rows = parsed(raw, value=value)
    # a document that is no object has no key; the schema's parser would take it for one of nulls
    rows = rows.withColumn("dirty", F.col("dirty") | F.json_object_keys(value).isNull())
    if required is not None:
        rows = rows.withColumn("dirty", F.col("dirty") | ~F.coalesce(required, F.lit(False)))
    clean = rows.where(~F.col("dirty")).select(*raw.columns, "doc.*").drop(CORRUPT)
    return Split(clean, rows.where("dirty").select(*raw.columns))


def fixed_text(value: Column | str, flag: Column | str) -> Column:
    """The text of a log with its new-visitor flag set to ``flag``; all else stays as it was."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.regexp_replace(value, F.lit(r'("is_new"\s*:\s*)"[^"]*"'), F.concat(F.lit('$1"'), flag, F.lit('"')))


def display_texts(page_logs: DataFrame, value: str = "value") -> DataFrame:
    """{common, page, ts, display} as text for each display of whole page logs; no field of any part is lost."""
    doc = F.from_json(value, "common string, page string, displays array<string>, ts bigint")
    rows = page_logs.select(doc.alias("doc")).select("doc.common", "doc.page", "doc.ts", F.explode("doc.displays").alias("display"))
    part = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f'"{name}":'), x))
    parts = [part(c, F.col(c).cast("string")) for c in ("common", "page", "ts", "display")]
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def repair_is_new(logs: DataFrame, key: Column | str, flag: Column | str, order: list[str]) -> DataFrame:
    """logs with ``is_new_fixed``: of the rows of a key that claim to be new, only the first in ``order`` stays so.

    The first claim is found by an aggregation, not a sort of the key's rows,
    so that a very active visitor is combined before the shuffle; the join
    that follows can be split where it is skewed. ``order`` identifies a row.
    """
    key, flag = (F.col(x) if isinstance(x, str) else x for x in (key, flag))
    at = F.struct(*order)
    firsts = logs.where(flag == "1").groupBy(key.alias("_key")).agg(F.min(at).alias("_first"))
    joined = logs.join(firsts, key == F.col("_key"), "left")
    return joined.withColumn("is_new_fixed", F.when((flag == "1") & (at != F.col("_first")), "0").otherwise(flag)).drop("_key", "_first")


def starts(logs: DataFrame, is_start: Column | None = None) -> DataFrame:
    return logs.where(is_start if is_start is not None else F.coalesce(F.size("start"), F.lit(0)) > 0)


def pages(logs: DataFrame, is_start: Column | None = None) -> DataFrame:
    """What is no start log; the rows keep their displays."""
    return logs.where(~(is_start if is_start is not None else F.coalesce(F.size("start"), F.lit(0)) > 0))


def displays(page_logs: DataFrame, keep: list[str] | None = None, column: str = "displays") -> DataFrame:
    """A row a display; pages without any give none."""
    return page_logs.select(*(keep or ["common", "page", "ts"]), F.explode(column).alias("display"))


def entry_page(last_page: Column | str = "page.last_page_id") -> Column:
    return F.coalesce(F.col(last_page) if isinstance(last_page, str) else last_page, F.lit("")) == ""
