"""Data-quality operators beyond the fact counts: keys, lists, shared products, unmapped ids,
column domains (Q7-Q13, U5).

Nothing here collects a group into one task: values per key are returned as DISTINCT (key, value)
pairs, and cross-table checks are joins to distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens.operators.share import shared


def pk_violations(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Q7: keys that are NULL or occur more than once, per (table name, df, key column)."""
    parts = []
    for name, df, key in tables:
        parts.append(
            df.groupBy(F.col(key).alias("_k"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("_k").isNull() | (F.col("n_rows") > 1))
            .select(F.lit(name).alias("table_name"), F.col("_k").cast("string").alias("key_value"), "n_rows")
        )
    return _union(parts)


#: Bytes of key bitmaps that may be broadcast (a row of 4 KB holds 32,768 keys); larger ones are joined by a shuffle.
BITMAP_BYTES = 64 << 20
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def key_bitmap(parent: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """The keys of ``parent`` as an exact bitmap, a row (_bucket, _bits) for every 32,768 neighbouring keys that
    hold one, and whether it may be broadcast by its measured size."""
    k = F.col(f"`{key}`").cast("long")
    bits = parent.where(k.isNotNull()).groupBy(F.bitmap_bucket_number(k).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("_bits"))
    bits = shared(bits, "key-bitmap")
    return bits, bits.count() * 4200 <= BITMAP_BYTES


def with_misses(rows: DataFrame, relations: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``rows`` with a boolean column per relation (name of the new column, parent, parent key, child key): whether
    the child key is not NULL and has no parent.

    Integer keys are looked up in the parents' bitmaps, which are exact and small, so no row is moved while the
    bitmaps may be broadcast; others by a join to the distinct parent keys.  No row comes or goes."""
    types = dict(rows.dtypes)
    for out, parent, pkey, ckey in relations:
        child = F.col(f"`{ckey}`")
        if types[ckey] in _INTEGRAL and dict(parent.dtypes)[pkey] in _INTEGRAL:
            bits, fits = key_bitmap(parent, pkey)
            k = child.cast("long")
            joined = rows.join(F.broadcast(bits) if fits else bits, F.bitmap_bucket_number(k) == F.col("_bucket"), "left")
            at = F.bitmap_bit_position(k)
            byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hit = F.coalesce(F.expr("1") == F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")), F.lit(False))
            rows = joined.select(*[F.col(f"`{c}`") for c in rows.columns], (child.isNotNull() & ~hit).alias(out))
        else:
            keys = parent.select(F.col(f"`{pkey}`").alias("_key")).distinct().withColumn("_hit", F.lit(True))
            joined = rows.join(keys, child == F.col("_key"), "left")
            rows = joined.select(*[F.col(f"`{c}`") for c in rows.columns], (child.isNotNull() & F.col("_hit").isNull()).alias(out))
    return rows


def fk_orphans(relations: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Q8: per relationship, the number of child rows whose non-NULL key has no parent.

    Relationships (name, child, child key, parent, parent key) that share a child table are checked in one
    pass over it, and the counts are unpivoted into one row per relationship."""
    groups: dict[int, list] = {}
    for rel in relations:
        groups.setdefault(id(rel[1]), []).append(rel)
    parts = []
    for rels in groups.values():
        keys = sorted({ckey for _, _, ckey, _, _ in rels})
        marks = [(f"_miss{i}", parent, pkey, ckey) for i, (_, _, ckey, parent, pkey) in enumerate(rels)]
        rows = with_misses(rels[0][1].select(*[F.col(f"`{c}`") for c in keys]), marks)
        counts = rows.agg(*[F.count_if(m[0]).alias(m[0]) for m in marks])
        parts.append(named_counts(counts, {m[0]: rel[0] for m, rel in zip(marks, rels)}))
    return _union(parts)


def named_counts(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row of counts as rows (relationship, orphan_rows)."""
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return counts.unpivot([], list(names), "_rel", "orphan_rows").select(label[F.col("_rel")].alias("relationship"), "orphan_rows")


def fk_orphan_rows(child: DataFrame, relations: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """Q8: the child rows that break a foreign key, once for each relationship (name, child key, parent, parent key)
    they break, with ``relationship`` and ``key_value`` before their own columns; one pass over the child."""
    marks = [(f"_miss{i}", parent, pkey, ckey) for i, (_, ckey, parent, pkey) in enumerate(relations)]
    broken = [F.when(F.col(m[0]), F.struct(F.lit(rel[0]).alias("relationship"), F.col(f"`{m[3]}`").cast("string").alias("key_value")))
              for m, rel in zip(marks, relations)]
    rows = with_misses(child, marks)
    hit = rows.where(" or ".join(m[0] for m in marks)).select(F.explode(F.array_compact(F.array(*broken))).alias("_x"), *[F.col(f"`{c}`") for c in child.columns])
    return hit.select("_x.relationship", "_x.key_value", *[F.col(f"`{c}`") for c in child.columns])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_values_per_key(df: DataFrame, key: str, value: str, out_count: str) -> DataFrame:
    """Q9/Q10: the distinct (key, value) pairs, each with the key's number of distinct values.

    NULL keys are dropped and NULL values not counted (H17); a key without any value keeps one row.
    Pairs instead of a list per key: a placeholder key with very many values stays spread over tasks.  The
    pairs are stored, so the source is read once."""
    pairs = shared(df.select(key, value).where(F.col(key).isNotNull()).distinct(), "pairs")
    counts = pairs.groupBy(key).agg(F.count(F.col(value)).alias(out_count))
    return pairs.join(counts, key).where(F.col(value).isNotNull() | (F.col(out_count) == 0))


def factory_products(ff: DataFrame) -> DataFrame:
    """Q11: which products each factory makes, as distinct (factory, product) pairs."""
    return ff.select("Factory ID", "Product ID").where(F.col("Factory ID").isNotNull() & F.col("Product ID").isNotNull()).distinct()


def shared_products(ff: DataFrame) -> DataFrame:
    """Q12: products made by more than one factory (distinct pairs, then a count per product)."""
    return (
        factory_products(ff)
        .groupBy("Product ID")
        .agg(F.count(F.lit(1)).alias("n_factories"))
        .where(F.col("n_factories") > 1)
    )


def unmapped_keys(enriched: DataFrame) -> DataFrame:
    """Q13: how many rows got no product / factory id from the dictionaries, and the id domains."""
    return enriched.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("Product ID").isNull()).alias("null_product_id"),
        F.count_if(F.col("Factory ID").isNull()).alias("null_factory_id"),
        F.countDistinct("Product ID").alias("distinct_product_ids"),
        F.countDistinct("Factory ID").alias("distinct_factory_ids"),
    )


def unmapped_names(names: DataFrame, product_map: DataFrame, factory_map: DataFrame) -> DataFrame:
    """Q13 from rows with the two name columns: names are counted (one pass, both columns as grouping sets) and
    each distinct name is looked up once, so no row is moved."""
    sets = names.groupingSets([["Product Name"], ["Factory"]], "Product Name", "Factory").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
    sets = shared(sets, "name-counts")

    def side(which: int, col: str, mapping: DataFrame, prefix: str) -> DataFrame:
        rows = sets.where(F.col("_set") == which).select(F.col(f"`{col}`").alias("name"), "n")
        mapped = rows.join(mapping.select("name", "id"), "name", "left")
        return mapped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{prefix}_rows"),
                          F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias(f"null_{prefix}_id"),
                          F.countDistinct("id").alias(f"distinct_{prefix}_ids"))

    both = side(1, "Product Name", product_map, "product").unionByName(side(2, "Factory", factory_map, "factory"), allowMissingColumns=True)
    cols = ["null_product_id", "null_factory_id", "distinct_product_ids", "distinct_factory_ids"]
    return both.agg(F.max("product_rows").alias("total_rows"), *[F.max(c).alias(c) for c in cols])  # a row each


def column_domains(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct values of several columns, as (column_name, value) rows — one scan,
    one shuffle (``unpivot`` then DISTINCT)."""
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return as_text.unpivot([], list(cols), "column_name", "value").distinct()
