"""Spend marts: the pair spine, national totals, cuts by type, division and region, profiles, leaderboards, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import local_year, minute_text


def pair_spend(acquisitions: DataFrame, contracts: DataFrame, winners: DataFrame) -> DataFrame:
    """Each euro between an authority and a supplier: direct acquisitions count whole, a contract counts whole for each
    winner (full) and by equal parts (split). Rows without an authority, acquisitions without a supplier are left out."""
    direct = acquisitions.where("authority_id is not null and supplier_id is not null").select(
        "authority_id", "supplier_id", F.lit("da").alias("src"), F.lit(None).cast("bigint").alias("contract_id"), F.col("closing").cast("double").alias("full"), F.col("closing").cast("double").alias("split"), F.col("finalization").alias("activity")
    )
    # the share is counted on the narrow bridge table before it meets the contracts
    shares = winners.withColumn("n_winners", F.count("*").over(Window.partitionBy("contract_id")))
    value = F.col("value").cast("double")
    won = contracts.where("authority_id is not null").join(shares, "contract_id")
    won = won.select("authority_id", "supplier_id", F.lit("contract").alias("src"), "contract_id", value.alias("full"), (value / F.nullif("n_winners", F.lit(0))).alias("split"), F.col("state_date").alias("activity"))
    return direct.unionByName(won)


def totals_by_year(streams: DataFrame, zone: str = "UTC") -> DataFrame:
    """(kind, at, value) to counts and sums for each kind and year, and for each kind over all time.

    all_time tells the all-time row (1) from the row of records without a date (0 with a null year)."""
    s = streams.select("kind", local_year(F.col("at"), zone).alias("year"), "value")
    g = s.groupingSets([["kind", "year"], ["kind"]], "kind", "year")
    return g.agg(F.grouping("year").cast("int").alias("all_time"), F.count("*").alias("n"), F.sum("value").alias("total"))


def by_type(streams: DataFrame) -> DataFrame:
    """(kind, acquisition_type, value) to counts and sums; a missing type is a type."""
    return streams.groupBy("kind", "acquisition_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def by_division(streams: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, division, value) to counts and sums with the division's name, if the catalog has it."""
    sums = streams.where("division is not null").groupBy("kind", "division").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.join(names, "division", "left")


def profiles(pairs: DataFrame, role: str) -> DataFrame:
    """Each organisation's contracts, acquisitions, sums and first and last activity in a role.

    A supplier's full sum counts consortium contracts whole; an authority counts each contract once and its full sum is the split one."""
    authority = role == "authority"
    contracts = F.countDistinct("contract_id") if authority else F.count_if(F.col("src") == "contract")
    return pairs.groupBy(F.col(f"{role}_id").alias("entity_id")).agg(
        contracts.alias("n_contracts"),
        F.count_if(F.col("src") == "da").alias("n_das"),
        F.sum("split" if authority else "full").alias("total_full"),
        F.sum("split").alias("total_split"),
        minute_text(F.min("activity")).alias("first_activity"),
        minute_text(F.max("activity")).alias("last_activity"),
    )


def by_region(profile: DataFrame) -> DataFrame:
    """(county, role, total_full) of profiles to counts and sums; blank counties are left out."""
    return profile.where("county is not null and county <> ''").groupBy("county", "role").agg(F.count("*").alias("n"), F.sum("total_full").alias("total"))


def top_by(df: DataFrame, groups: list[str], value: str, k: int, *ties: str) -> DataFrame:
    """The k largest of each group with their rank, nulls last, ties by the columns given. Spark keeps k rows a task
    before it sorts a group, so a large group is cut down where it lies."""
    order = Window.partitionBy(*groups).orderBy(F.desc_nulls_last(value), *(F.asc_nulls_last(t) for t in ties))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def partners(pairs: DataFrame, value: str) -> DataFrame:
    """Counts and sums between organisations, seen from both sides."""
    sums = pairs.groupBy("authority_id", "supplier_id").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    a, s = F.col("authority_id"), F.col("supplier_id")
    side = lambda role, own, other: sums.select(own.alias("entity_id"), F.lit(role).alias("role"), other.alias("partner_id"), "n", "total")
    return side("authority", a, s).unionByName(side("supplier", s, a))


def concentration(pairs: DataFrame, value: Column, own: str = "authority_id", other: str = "supplier_id") -> DataFrame:
    """Of each organisation: partners, total, largest partner's sum, and the sum of squares of its partners' sums."""
    per = pairs.groupBy(own, other).agg(F.sum(value).alias("part"))
    x = F.col("part").cast("double")
    return per.groupBy(own).agg(F.count("*").alias("partners"), F.sum("part").alias("total"), F.max("part").alias("top"), F.sum(x * x).alias("squares"))


def half_up(c: Column, places: int = 4) -> Column:
    """Rounded half up in decimal arithmetic, as a double; the same in every engine."""
    return F.round(c.cast("decimal(28,12)"), places).cast("double")


def shares(c: DataFrame) -> DataFrame:
    """concentration() with top_pct and hhi (the sum of squared shares), both null where the total is not positive."""
    total = F.col("total").cast("double")
    return c.withColumns({"top_pct": F.when(total > 0, half_up(F.col("top").cast("double") / total)), "hhi": F.when(total > 0, half_up(F.col("squares") / (total * total)))})
