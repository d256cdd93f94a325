"""Look-ups by id and catalog pages over HTTP, as columns of a DataFrame: each task asks for its own rows.

A record whose look-up fails after its retries keeps its row, with the error in place of the answer, so one bad record never fails a day."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .http import ask

#: Items that a source gives at most in one answer.
TAKE = 200


def _with(rows: DataFrame, *more: str) -> StructType:
    """The schema of rows and these string columns."""
    return StructType([*rows.schema.fields, *(StructField(c, StringType()) for c in more)])


def with_details(rows: DataFrame, url: str, key: str, deferred: Column | None = None, pause: float = 0.5) -> DataFrame:
    """rows with detail (the answer's JSON) and error, from url with {id} replaced by the key; rows that are deferred, and null keys, are not asked for."""
    wanted = rows.withColumn("_ask", F.col(key).isNotNull() & ~(F.coalesce(deferred, F.lit(False)) if deferred is not None else F.lit(False)))
    schema = _with(rows, "detail", "error")

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [_one(lambda i=i: ask(url.format(id=i), base=pause)) if wish else (None, None) for i, wish in zip(part[key], part["_ask"], strict=True)]
            yield part.drop(columns="_ask").assign(detail=[d for d, _ in got], error=[e for _, e in got])

    return wanted.mapInPandas(fetch, schema)


def _one(call: Callable[[], object]) -> tuple[str | None, str | None]:
    try:
        return json.dumps(call(), ensure_ascii=False), None
    except Exception as e:  # noqa: BLE001  (whatever a server does wrong is the record's error)
        return None, f"{type(e).__name__}: {e}"


def all_items(page: Callable[[int, int], dict], take: int = TAKE) -> list:
    """The items of a list that is read by skip and take until its total is reached; fewer than it tells of is an error."""
    items: list = []
    while True:
        answer = page(len(items), take)
        more = answer.get("items") or []
        items += more
        if len(items) >= (answer.get("total") or 0):
            return items
        if not more:
            raise ValueError(f"list ends after {len(items)} of {answer['total']} items")


def with_contracts(rows: DataFrame, url: str, key: str, take: int = TAKE, pause: float = 0.5) -> DataFrame:
    """rows with contracts (a JSON array of all of a notice's contracts, read page by page) and error."""
    schema = _with(rows, "contracts", "error")

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [_one(lambda i=i: all_items(lambda skip, n: ask(url, {key: i, "skip": skip, "take": n}, base=pause), take)) for i in part[key].tolist()]
            yield part.assign(contracts=[d for d, _ in got], error=[e for _, e in got])

    return rows.mapInPandas(fetch, schema)


def catalog_codes(categories: DataFrame, url: str, take: int = TAKE, pause: float = 0.5) -> DataFrame:
    """(category, code, name) of the codes of each category (category); a category that cannot be read fails its task, as a catalog must be whole."""

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(c, i["code"], i.get("name")) for c in part["category"] for i in all_items(lambda skip, n, c=c: ask(url, {"category": c, "skip": skip, "take": n}, base=pause), take)]
            yield pd.DataFrame(rows, columns=["category", "code", "name"])

    return categories.select("category").distinct().mapInPandas(fetch, "category string, code string, name string")


def fetch_counts(fetched: DataFrame, answer: str = "detail") -> DataFrame:
    """One row: seen, fetched, failed, deferred."""
    return fetched.agg(F.count("*").alias("seen"), F.count(answer).alias("fetched"), F.count("error").alias("failed"), F.count_if(F.col(answer).isNull() & F.col("error").isNull()).alias("deferred"))
