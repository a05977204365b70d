"""Row search, paging, caps and lookups over any rows; containment of golds in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators.automaton import found_in


def text_search(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose columns, joined by blanks and lowered, hold the query; all rows for an empty one."""
    wanted = query.strip().lower()
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return rows.filter(F.contains(hay, F.lit(wanted))) if wanted else rows


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """The rows of a page (from 1; size between 1 and 200) with has_more, whether others follow."""
    number, size = max(number, 1), max(1, min(size, 200))
    some = rows.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    at = some.withColumn("row__", F.row_number().over(Window.orderBy(*order)))  # a page and one row
    return at.withColumn("has_more", F.max("row__").over(Window.partitionBy()) > size).filter(F.col("row__") <= size).drop("row__")


def todo(rows: DataFrame, key: str, ids: list | None, done: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """What a run is to do: named ids, less those done (failed ones count as done), then offset and limit. The rest stays for later."""
    found = rows if ids is None else rows.filter(F.col(key).isin(ids))
    found = found.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).offset(offset)
    return found if limit is None else found.limit(limit)


def capped(rows: DataFrame, query: list[str], search: list[str], order: list[str], per_search: int, per_query: int, keep: Column | None = None) -> DataFrame:
    """The first per_search rows of each search, of these the first per_query of each query; keep chooses the rows that count."""
    found = rows if keep is None else rows.filter(keep)
    first = F.row_number().over(Window.partitionBy(*query, *search).orderBy(*order))
    found = found.withColumn("place__", first).filter(F.col("place__") <= per_search)
    again = F.row_number().over(Window.partitionBy(*query).orderBy(*search, *order))
    return found.withColumn("place__", again).filter(F.col("place__") <= per_query).drop("place__")


def kth(rows: DataFrame, keep: Column, by: list[str], order: list[str], k: int) -> DataFrame:
    """Of each group the k-th row that keep holds for; from the end if k is negative."""
    by_order = [F.col(c).asc() if k > 0 else F.col(c).desc() for c in order]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*by_order))
    return rows.filter(keep).withColumn("place__", place).filter(F.col("place__") == abs(k)).drop("place__")


def star(centre: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """centre with the columns of each part, by the keys: a left join for each."""
    for part in parts:
        centre = centre.join(part, keys, "left")
    return centre


def containment(golds: DataFrame, texts: DataFrame, gold_id: str, text_id: str) -> DataFrame:
    """(gold_id, text_id) of golds whose answer a text holds, normalised or as it is in lower case; both sides have a column text.

    Each text is normalised once, and walked once for each block of golds by an automaton of them.
    """
    norm, plain = T.normalize_answer(F.col("text")), T.simple_text(F.col("text"))
    forms = F.array(F.struct(F.lit(0).alias("form"), norm.alias("pattern")), F.struct(F.lit(1).alias("form"), plain.alias("pattern")))
    g = golds.filter(norm != "").select(F.col(gold_id).alias("id"), F.inline(forms))
    t = texts.select(F.col(text_id).alias("text_id"), norm.alias("norm"), plain.alias("plain")).filter("norm <> ''")
    return found_in(g, t, ["norm", "plain"]).select(F.col("id").alias(gold_id), F.col("text_id").alias(text_id))
