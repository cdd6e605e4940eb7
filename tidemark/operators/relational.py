"""Joins, aggregates, windows and paging that read models need, as plain DataFrame plans.

Every top-k has a total order: callers pass a unique key last. Nothing is collected; "now" is always an argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Keys = str | list[str]


def _list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def conjunction(filters: list[Column | None]) -> Column:
    """All given predicates; None stands for a filter that is switched off."""
    return reduce(lambda a, b: a & b, [f for f in filters if f is not None], F.lit(True))


def any_contains(term: str | None, *cols: str) -> Column | None:
    """Case-insensitive substring in any of the columns; None without a term."""
    if not term:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in cols])


def unexpired(col: str, as_of: Column) -> Column:
    return F.col(col).isNull() | (F.col(col) > as_of)


def due(col: str, as_of: Column) -> Column:
    return F.col(col).isNull() | (F.col(col) <= as_of)


def not_blank(col: str) -> Column:
    return F.nullif(F.trim(F.col(col)), F.lit("")).isNotNull()


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def topk_per_key(df: DataFrame, keys: Keys, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; the ranking filter lets Spark cut groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*_list(keys)).orderBy(*order))).where(F.col(rank) <= k)


def distinct_on(df: DataFrame, keys: Keys, order: list[Column]) -> DataFrame:
    return topk_per_key(df, keys, order, 1, "__rank").drop("__rank")


def latest_child(parent: DataFrame, child: DataFrame, on: Keys, order: list[Column], cols: list[str], where: Column | None = None, count: str | None = None) -> DataFrame:
    """Each parent with the first of its children, nulls where it has none; ``count`` adds the number of children."""
    rows = child if where is None else child.where(where)
    first = topk_per_key(rows, on, order, 1, "__rank").select(*_list(on), *cols)
    out = parent.join(first, on, "left")
    if not count:
        return out
    # Counted in its own grouping, which is partial before the shuffle; a window would hold all children of a key at once.
    n = rows.groupBy(*_list(on)).agg(F.count(F.lit(1)).alias(count))
    return out.join(n, on, "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def ordered_collect(df: DataFrame, by: Keys, order: list[Column], value: Column, name: str, distinct: bool = False) -> DataFrame:
    """An array per group in the given order; ``distinct`` keeps the first of equal values."""
    rows = df.groupBy(*_list(by)).agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], value.alias("v")))).alias("__a"))
    values = F.transform("__a", lambda x: x["v"])
    return rows.select(*_list(by), (F.array_distinct(values) if distinct else values).alias(name))


def exists_flag(left: DataFrame, right: DataFrame, on: Keys, name: str) -> DataFrame:
    """A boolean column: does the right side have the key?"""
    keys = right.select(*_list(on)).distinct().withColumn("__there", F.lit(True))
    return left.join(keys, on, "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there")


def any_of_semi(left: DataFrame, rights: list[DataFrame], on: Keys, negate: bool = False) -> DataFrame:
    """Rows with a partner in any of the right sides (or in none)."""
    keys = reduce(DataFrame.union, [r.select(*_list(on)) for r in rights]).distinct()
    return left.join(keys, on, "left_anti" if negate else "left_semi")


def coalesced_key_join(left: DataFrame, keys: list[str], right: DataFrame, right_key: str, how: str = "left") -> DataFrame:
    """Join on the first key of the left row that is not null."""
    l = left.withColumn("__key", F.coalesce(*[F.col(k) for k in keys]))  # noqa: E741
    return l.join(right, F.col("__key") == right[right_key], how).drop("__key")


def ranked_lookup(left: DataFrame, tries: list[tuple[list[str], list[str]]], dim: DataFrame, id_col: str, cols: list[str], dim_id: str) -> DataFrame:
    """Look each row up by several keys in order of preference; the first key with a hit wins, then the smallest id."""
    found = [left.join(dim, [left[a] == dim[b] for a, b in zip(lk, rk)]).select(left[id_col], *[dim[c] for c in cols], F.lit(i).alias("__try"), dim[dim_id].alias("__id")) for i, (lk, rk) in enumerate(tries)]
    best = distinct_on(reduce(DataFrame.unionByName, found), id_col, [F.col("__try"), F.col("__id")]).drop("__try", "__id")
    return left.join(best, id_col, "left")


def suffix_host_join(left: DataFrame, host: str, dim: DataFrame, domain: str, id_col: str, cols: list[str]) -> DataFrame:
    """Match a host with the longest of its own suffixes that the dimension lists, by equality on each suffix."""
    parts = F.split(F.lower(F.col(host)), r"\.")
    suffixes = left.select(id_col, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("__at", "__suffix"))
    hit = suffixes.join(dim, suffixes["__suffix"] == dim[domain])
    best = distinct_on(hit, id_col, [F.col("__at"), *[F.col(c) for c in cols]]).select(id_col, *cols)
    return left.join(best, id_col, "left")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, total: str | None = None) -> DataFrame:
    """One page; the total, if asked for, is counted once and joined as a single row instead of a global window."""
    out = df
    if total:
        out = out.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))))  # one row
    return out.orderBy(*order).offset(offset).limit(limit)


def group_counts(df: DataFrame, keys: Keys, **conditions: Column) -> DataFrame:
    """One pass: rows per group, and rows per group for which each condition holds."""
    return df.groupBy(*_list(keys)).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def keep_order(df: DataFrame, key: str, wanted: DataFrame, position: str) -> DataFrame:
    """The rows that a list of keys names, with their places in that list."""
    return df.join(F.broadcast(wanted), key)


def spread_sample(df: DataFrame, keys: Keys, order: list[Column], newest: int, spread: int) -> DataFrame:
    """Of each group the ``newest`` first rows and ``spread`` more, evenly placed over the rest."""
    w = W.partitionBy(*_list(keys))
    r = df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    rest = F.col("__n") - newest
    # The i-th of the spread lies at newest + floor(i * rest / spread); a row is one if the next step reaches it.
    step = lambda x: F.floor((x * spread + rest - 1) / rest)
    at = F.col("__r") - newest - 1
    picked = (F.col("__r") <= newest) | (rest <= spread) | ((at >= 0) & (F.floor(step(at) * rest / spread) == at) & (step(at) < spread))
    return r.where(picked).drop("__r", "__n")


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def null_safe_dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, null keys equal to each other (grouping and windows treat them so)."""
    return distinct_on(df, keys, order)
