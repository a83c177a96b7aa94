"""Document fingerprints: bottom-k sketches of word shingles, in column expressions alone.

A sketch is the sorted array of the ``k`` smallest distinct shingle hashes. Sketches of parts merge into the sketch of
the whole; two sketches estimate resemblance and containment, one estimates how many distinct shingles there are.
With fewer than ``k`` shingles all of these are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
SHINGLE = 5
#: Words are runs of anything but ASCII white space, in lower case.
_WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WHITE), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Adds the sketch of a text column. Fewer than ``size`` words are one shingle; no word (or null) gives no hash."""
    h, n = f"__{out}_words", f"__{out}_n"
    df = df.withColumn(h, F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    df = df.withColumn(n, F.size(h))
    shingles = F.transform(
        F.sequence(F.lit(0), F.col(n) - size), lambda i: F.xxhash64(*(F.get(F.col(h), i + j) for j in range(size)))
    )
    all_hashes = (
        F.when(F.col(n) >= size, shingles).when(F.col(n) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    )
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(all_hashes)), 1, k)).drop(h, n)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group, of all its parts.

    A group is cut down to k hashes wherever a part of it lies before it meets in one place, so its size is no matter.
    A group whose sketches are all empty or null gives none.
    """
    each = df.select(*keys, F.explode(sketch).alias("__hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__hash"))
    least = each.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; 1 for two empty ones."""
    union = merge(a, b, k)
    common = F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(union, -1))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(common) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact below k."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds, 0 to 1; 1 for an empty ``a``."""
    r, union = resemblance(a, b, k), distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as one string of 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt out by ranges of ``__key``, and for each range the row that follows its last, in descending order.

    First: ``df`` with ``__range``. Second: ``__range``, ``__key``, ``text`` of the first row of the next range that has
    rows (after the last range: of the first). To the driver go the range bounds and one key for each range.
    """
    share = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx("__key", share, 20 * parts)).first()[0] if share else None
    edges = F.array(*(F.lit(b).cast("bigint") for b in sorted(set(bounds or []))))
    spread = df.withColumn("__range", F.size(F.filter(edges, lambda b: b < F.col("__key"))) if bounds else F.lit(0))
    tops = sorted(
        ((r["__range"], r.top) for r in spread.groupBy("__range").agg(F.max("__key").alias("top")).collect()), reverse=True
    )
    follows = [(tops[i][0], tops[(i + 1) % len(tops)][1]) for i in range(len(tops))]
    spark = df.sparkSession
    follows_df = spark.createDataFrame(follows, "__range int, __key bigint")
    first = spread.filter(F.col("__key").isin([k for _, k in follows])).groupBy("__key").agg(F.max("text").alias("text"))
    return spread, follows_df.join(first, "__key")


def edited_fingerprints(documents: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    The edited text has the last third (rounded down) of its characters replaced by as many of the next document, in
    descending order of doc_id, after the last the first; a shorter next text gives all it has. Columns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (resemblance to the edited text and to the
    next document), n_shingles (estimated). Null text is empty; two empty texts resemble each other fully. Null doc_ids
    come last; rows with one doc_id follow each other by descending text. One document is its own next.

    Texts are shuffled once, by ranges of doc_id; the row after the last of a range comes by a join of one row a range.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"),
    ).withColumn("__key", F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint")))
    spread, follows = with_next(docs, parts)
    follows = with_sketch(follows.withColumnRenamed("text", "__after"), "__after", "__after_sketch", k)
    order = Window.partitionBy("__range").orderBy(F.desc("__key"), F.desc("text"))
    df = with_sketch(spread.withColumn("__lead", F.lead("text").over(order)), "text", "__sketch", k)
    df = df.withColumn("__lead_sketch", F.lead("__sketch").over(order))
    df = df.join(follows.select("__range", "__after", "__after_sketch"), "__range")
    df = df.select(
        "doc_id", "text", "__sketch", F.length("text").cast("bigint").alias("n_chars"),
        F.coalesce("__lead", "__after").alias("__next"),
        F.coalesce("__lead_sketch", "__after_sketch").alias("__next_sketch"),
    )
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("__next", F.lit(1), cut)
    )
    df = with_sketch(df.withColumn("__edited", edited), "__edited", "__edited_sketch", k)
    return df.select(
        "doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("__sketch")).alias("fingerprint"), as_text(F.col("__edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("__sketch"), F.col("__edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("__sketch"), F.col("__next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("__sketch"), k).alias("n_shingles"),
    )
