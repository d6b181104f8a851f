"""Exact dedup by content sort (native).

Texts are range-partitioned by sampled splitters over their bytes, sorted externally inside each
range, and equal neighbours found by full comparison: the window's grouping compares the whole
text of each row with that of the row before it.

The sort key is (first ``PREFIX`` characters, 64-bit hash, salt, whole text), so that splitters stay
small whatever the length of the texts: ranges are in the order of the bytes up to there, and of hashes beyond. Equal texts are still neighbours. A text with many copies
is dealt to several salts, each a run of its own, and the totals of such runs come from a
pre-aggregation whose partial sums are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Characters of the text that lead the sort key.
PREFIX = 64
#: A hash with at least max(HOT_ROWS, rows / HOT_KEYS) rows is salted; so at most HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 512, 4096


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """``df`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after ``normalise`` (a Column -> Column; none: no
    change); a null text counts as empty. Of equal texts the row with the smallest (or, with
    ``keep="largest"``, the largest) id stays; nulls of the id come last. Repeated rows with the
    same id and text: exactly one of them stays. Empty table: empty result. The columns of ``df``
    are carried; one named like a column that is added is renamed by leading underscores.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    names = {"id": id_col, "text": text_col}
    for c in df.columns:
        if c.lower() in added:
            new = common.free_name(df, "_" + c)
            df = df.withColumnRenamed(c, new)
            names = {k: new if v == c else v for k, v in names.items()}
    carried = df.columns
    k = {x: common.free_name(df, x) for x in ("text_k", "prefix_k", "hash_k", "salt_k", "salts_k", "sha_k", "hot_id", "hot_n", "row_k")}
    best = F.min if keep == "smallest" else F.max

    text: Column = F.coalesce(common.col(names["text"]).cast("string"), F.lit(""))
    base = df.withColumn(k["text_k"], normalise(text) if normalise else text)
    base = base.withColumn(k["hash_k"], F.xxhash64(k["text_k"]))

    limit = max(HOT_ROWS, df.count() // HOT_KEYS)
    hot = common.written(
        base.groupBy(k["hash_k"]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
        .select(k["hash_k"], F.ceil(F.col("n") / limit).cast("int").alias(k["salts_k"])),
        "hot-texts",
    )
    with_hot = base.join(F.broadcast(hot), k["hash_k"], "left")
    totals = (
        base.join(F.broadcast(hot.select(k["hash_k"])), k["hash_k"], "left_semi")
        .groupBy(k["hash_k"], k["text_k"])
        .agg(best(common.col(names["id"])).alias(k["hot_id"]), F.count(F.lit(1)).alias(k["hot_n"]))
        .select(k["hash_k"], F.sha2(F.col(k["text_k"]), 256).alias(k["sha_k"]), k["hot_id"], k["hot_n"])
    )

    salt = F.when(F.col(k["salts_k"]).isNull(), 0).otherwise(F.pmod(F.xxhash64(common.col(names["id"])), F.col(k["salts_k"])).cast("int"))
    ranged = with_hot.select(
        *[common.col(c) for c in carried],
        k["text_k"],
        F.substring(k["text_k"], 1, PREFIX).alias(k["prefix_k"]),
        k["hash_k"],
        salt.alias(k["salt_k"]),
        F.col(k["salts_k"]).isNotNull().alias(k["salts_k"]),
    ).repartitionByRange(k["prefix_k"], k["hash_k"], k["salt_k"])

    run = Window.partitionBy(k["prefix_k"], k["hash_k"], k["salt_k"], k["text_k"])
    order = common.col(names["id"]).asc_nulls_last() if keep == "smallest" else common.col(names["id"]).desc_nulls_last()
    runs = (
        ranged.withColumn(k["row_k"], F.row_number().over(run.orderBy(order)))
        .withColumn("keep_id", best(common.col(names["id"])).over(run))
        .withColumn("group_size", F.count(F.lit(1)).over(run))
        .withColumn("text_sha256", F.sha2(F.col(k["text_k"]), 256))
        .drop(k["text_k"], k["prefix_k"])
    )
    joined = runs.join(
        F.broadcast(totals.withColumnsRenamed({k["hash_k"]: k["hash_k"] + "_r", k["sha_k"]: k["sha_k"] + "_r"})),
        F.col(k["salts_k"]) & (F.col(k["hash_k"]) == F.col(k["hash_k"] + "_r")) & (F.col("text_sha256") == F.col(k["sha_k"] + "_r")),
        "left",
    )
    first = (F.col(k["row_k"]) == 1) & (F.coalesce(common.col(names["id"]).eqNullSafe(F.col(k["hot_id"])), F.lit(True)) | F.col(k["hot_n"]).isNull())
    return joined.select(
        *[common.col(c) for c in carried],
        F.when(F.col(k["hot_n"]).isNull(), F.col("keep_id")).otherwise(F.col(k["hot_id"])).alias("keep_id"),
        F.coalesce(F.col(k["hot_n"]), F.col("group_size")).alias("group_size"),
        first.alias("kept"),
        "text_sha256",
    )


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``, whatever their names.

    A null text counts as empty, so of all null and empty texts one row stays; of repeated rows one stays; a null id
    comes last; an empty table gives an empty result.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    out = annotate(df.toDF(*plain), plain[df.columns.index(id_col)], plain[df.columns.index(text_col)], keep, normalise)
    return out.where("kept").select(*plain).toDF(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every row of documents with the row that stays for it, the largest doc_id of equal texts."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return annotate(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
