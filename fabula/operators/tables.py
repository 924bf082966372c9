"""Changing tables: every operation returns the new table, to be published as a new directory or partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known(df: DataFrame, most: int) -> tuple[DataFrame, list | None]:
    """`df` computed once, and its rows, if there are at most `most`; else `df` as it is, and None."""
    rows = df.limit(most + 1).collect()
    return (df, None) if len(rows) > most else (df.sparkSession.createDataFrame(rows, df.schema), rows)


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by a key, if it is read in fewer parts than there are cores, as one file of one row group is; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def numbered(df: DataFrame, keys: list[str], order: str, name: str, span: int = 100_000, then: tuple[str, ...] = ()) -> DataFrame:
    """`df` with a number from 1 within each key, by a whole number that is unique in it, or is so with the columns `then`.

    A key's rows are counted in spans of the order first, so that a task sorts one span and not a whole key.
    """
    cut = df.withColumn("_span", F.floor(F.col(order) / span))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy(*keys, "_span").count().withColumn("_before", before).drop("count")
    within = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order, *then))
    return cut.join(offsets, [*keys, "_span"]).withColumn(name, (F.col("_before") + within).cast("long")).drop("_span", "_before")


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = 100_000) -> DataFrame:
    """`df` with the sum of `value` over the rows of its key that come before, by a whole number that is unique in it; nulls add nothing.

    As in `numbered`, sums of spans come first, so that no task gets a whole key.
    """
    cut = df.withColumns({"_span": F.floor(F.col(order) / span), "_value": F.coalesce(value, F.lit(0))})
    earlier = lambda by: F.coalesce(F.sum("_value").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cut.groupBy(*keys, "_span").agg(F.sum("_value").alias("_value"))
    offsets = spans.withColumn("_before", earlier(Window.partitionBy(*keys).orderBy("_span"))).drop("_value")
    within = cut.withColumn("_within", earlier(Window.partitionBy(*keys, "_span").orderBy(order)))
    return within.join(offsets, [*keys, "_span"]).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_span", "_value", "_before", "_within")


def seek(df: DataFrame, number: int, size: int, order: str, span: int = 100_000, largest: int = 100) -> DataFrame:
    """Page `number` by a whole number that is unique, with `seq`, the rows' places from the first page on.

    Rows are counted in spans of the order; only the spans that the page lies in are read again and sorted, however far
    the page is. They are as many as the page has rows at most, so their bounds go into the filter.
    """
    number, size = max(1, number), max(1, min(size, largest))
    first, last = (number - 1) * size, number * size
    counts = df.where(F.col(order).isNotNull()).groupBy(F.floor(F.col(order) / span).alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = counts.withColumn("_before", before).where((F.col("_before") < last) & (F.col("_before") + F.col("_n") > first)).orderBy("_span").collect()
    if not met:
        return df.limit(0).withColumn("seq", F.lit(0).cast("long"))
    low, high = met[0]._span * span, (met[-1]._span + 1) * span
    rows = df.where((F.col(order) >= low) & (F.col(order) < high)).orderBy(order).limit(last - met[0]._before)
    return rows.withColumn("seq", (F.row_number().over(Window.orderBy(order)) + met[0]._before).cast("long")).where(F.col("seq") > first)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """`delta`'s rows, and those of `base` whose keys it lacks. `delta` has one row for a key (see `latest`)."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def upsert_documents(base: DataFrame, delta: DataFrame, keys: list[str], text: str, *order: Column) -> DataFrame:
    """`upsert` of a delta that may name a key several times, of which the first in `order` counts; empty documents are left out."""
    return upsert(base, latest(delta.where(F.trim(text) != ""), keys, *order), keys)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """`base`, and of each new key the first row of `delta`; rows with a null key conflict with nothing."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    new = latest(delta.where(whole), keys, *order).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(new).unionByName(delta.where(~whole))


def replace_all(base: DataFrame, delta: DataFrame, scope: list[str], scopes: DataFrame | None = None) -> DataFrame:
    """`base` without the scopes that are rebuilt, and `delta`. `scopes` names them all; a scope that `delta` leaves empty has no rows then."""
    rebuilt = (delta if scopes is None else scopes).select(*scope).distinct()
    return base.join(rebuilt, scope, "left_anti").unionByName(delta)


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str, links: dict[str, str], then: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """The tables that `links` names (name to key column) without the rows of `gone`'s keys.

    `then` goes on from there, in order: a table (name) loses the rows whose column refers to a row that another
    table (parent, column of both) has lost.
    """
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    out = {n: df.join(keys, df[links[n]] == keys["_gone"], "left_anti") if n in links else df for n, df in tables.items()}
    for name, (parent, column) in (then or {}).items():
        lost = tables[parent].select(column).distinct().join(out[parent].select(column).distinct(), column, "left_anti")
        out[name] = out[name].join(lost, column, "left_anti")
    return out


def patch(base: DataFrame, changes: DataFrame, key: str, supplied: str | None = None) -> DataFrame:
    """`base` with the values that `changes` supplies: those that are not null, or, where `supplied` names an array of field names, those fields, null too."""
    names = [c for c in changes.columns if c not in (key, supplied)]
    named = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names], *([F.col(supplied).alias("_fields")] if supplied else []))
    value = lambda c: F.when(F.array_contains("_fields", c), F.col(f"_new_{c}")).otherwise(F.col(c)) if supplied else F.coalesce(f"_new_{c}", c)
    return base.join(named, key, "left").select(*[value(c).alias(c) if c in names else F.col(c) for c in base.columns])


def filtered(df: DataFrame, **supplied) -> DataFrame:
    """The rows that meet all the filters that are supplied (not None): a value, or a list of values."""
    for name, value in supplied.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def lookup(df: DataFrame, owner_id, **key) -> DataFrame:
    """The row of a key if it is the owner's and not deleted; no row else."""
    return filtered(df, owner_id=owner_id, **key).where(~F.coalesce(F.col("deleted"), F.lit(False)))


def layered(*layers: DataFrame) -> DataFrame:
    """(key, value, layer) of settings: the first layer (key, value) that has the key and a value for it decides."""
    named = [x.select("key", "value", F.lit(i).alias("layer")) for i, x in enumerate(layers)]
    out = named[0]
    for x in named[1:]:
        out = out.unionByName(x)
    return out.where("value is not null").groupBy("key").agg(F.min_by("value", "layer").alias("value"), F.min("layer").alias("layer"))


def page(df: DataFrame, number: int, size: int, *order: Column, largest: int = 100) -> DataFrame:
    """Rows of one page, numbered from the first page on. Sorting and cutting are one top-k."""
    number, size = max(1, number), max(1, min(size, largest))
    rows = df.orderBy(*order).limit(number * size)
    return rows.withColumn("seq", F.row_number().over(Window.orderBy(*order))).where(F.col("seq") > (number - 1) * size)


def page_with_total(df: DataFrame, number: int, size: int, *order: Column, largest: int = 100) -> DataFrame:
    """`page`, with the number of all rows and of pages on each row; a page beyond the last has none."""
    size = max(1, min(size, largest))
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))
    return page(df, number, size, *order, largest=largest).join(F.broadcast(total), F.lit(True))  # one row


def head_tail(df: DataFrame, key: str, order: str, line: str, head: int, tail: int) -> DataFrame:
    """(key, place, line): the first `head` and last `tail` lines of each key, and between them, where there are more, one that says how many are left out.

    `order` numbers a key's rows from 1.
    """
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    rows = df.join(n, key).where((F.col("n") <= head + tail) | (F.col(order) <= head) | (F.col(order) > F.col("n") - tail)).select(key, F.col(order).alias("place"), F.col(line).alias("line"))
    left_out = n.where(F.col("n") > head + tail).select(key, F.lit(head + 1).cast("long").alias("place"), F.concat(F.lit("...（中间省略 "), (F.col("n") - head - tail).cast("string"), F.lit(" 章）...")).alias("line"))
    return rows.unionByName(left_out)


def collect_capped(df: DataFrame, key: str, text: str, limit: int, order: str) -> DataFrame:
    """Parts of each key until `limit` characters are reached, the last one cut; later ones are left out.

    `order` is a whole number that is unique in its key. Only lengths are summed; the texts that are kept are joined to
    them, at most `limit` of a key.
    """
    sizes = running(df.select(key, order, F.length(text).alias("_size")), [key], order, F.col("_size"), "before").where(F.col("before") < limit)
    kept = df.join(sizes.select(key, order, "before"), [key, order])
    return kept.withColumn("part", F.substring(F.col(text), F.lit(1), (F.lit(limit) - F.col("before")).cast("int")))
