"""Shards of bounded size by extendible hashing.

A document's hash is read bit by bit. The directory starts with one bucket; a bucket beyond the byte limit
splits on the next bit of the hash, the others stay as they are. A shard is thus a prefix of hash bits, of
a length of its own. Sizes are summed per long prefix first, so that the splits are worked out on one row
per prefix; where even that prefix is too large, only its documents take part in the next round of bits.

Documents with equal hash (equal id and text) cannot be parted by bits: they are laid down in overflow
pages of the bucket. Only a document larger than the limit makes a shard too large, alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snaptext.llm.common import whole
from snaptext.llm.counting import BLOCK, numbered, ranked
from snaptext.scale import stored

LIMIT_BYTES = 1 << 20
#: Bits that one round looks ahead, and bits of the hash in all.
ROUND_BITS = 16
HASH_BITS = 48


def bits_of(doc_id: Column, text: Column) -> Column:
    """The hash of a document as a string of 0 and 1, from its id and text."""
    head = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, HASH_BITS // 4)
    return F.lpad(F.conv(head, 16, 2), HASH_BITS, "0")


def directory(sizes: DataFrame, limit: int, bits: int = HASH_BITS, step: int = ROUND_BITS) -> DataFrame:
    """(``shard``, ``depth``, ``shard_bytes``) from (``bits``, ``n_bytes``): every bucket that fits, or can't be split."""
    done, rest, known = None, sizes.groupBy("bits").agg(F.sum("n_bytes").alias("n_bytes")), 0
    while True:
        upto = min(known + step, bits)
        prefix = stored(
            rest.groupBy(F.substring("bits", 1, upto).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes")), "sharding-prefixes"
        )
        # Sizes of all ancestors. A bucket is made when its parent is too large.
        levels = prefix.withColumn("depth", F.explode(F.sequence(F.lit(known), F.lit(upto))))
        sums = levels.groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("shard")).agg(F.sum("n_bytes").alias("shard_bytes"))
        parent = sums.filter(F.col("shard_bytes") > limit).select(F.col("shard").alias("_parent"))
        made = sums.withColumn("_parent", F.expr(f"if(depth = {known}, null, substring(shard, 1, depth - 1))"))
        born = made.join(parent, "_parent", "left_semi").select("shard", "depth", "shard_bytes")
        if known == 0:
            born = born.unionByName(sums.filter("depth = 0").select("shard", "depth", "shard_bytes"))
        fits = born.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == bits))
        done = stored(fits if done is None else done.unionByName(fits), "sharding-directory")
        over = stored(born.filter((F.col("shard_bytes") > limit) & (F.col("depth") == upto)).select("shard"), "sharding-over")
        if upto == bits or not over.limit(1).count():
            return done
        rest = rest.join(over, F.substring("bits", 1, upto) == F.col("shard"), "left_semi")
        known = upto


def assign(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``shard``, ``depth``, ``page``, ``shard_bytes``) for every row of (``doc_id``, ``text``).

    ``shard`` is the prefix of hash bits, ``page`` its overflow page, 0 unless rows with one hash exceed the
    limit; ``shard_bytes`` is the size of bucket and page. Sizes are UTF-8 bytes. Null texts have size 0; null
    ids are hashed as empty. An empty table gives no rows.
    """
    text = whole("text")
    hashed = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), bits_of(F.col("doc_id"), text).alias("bits")), "sharding")
    shards = directory(hashed, limit)
    depths = [r["depth"] for r in shards.select("depth").distinct().collect()] or [0]  # at most HASH_BITS + 1
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("shard")) for d in sorted(depths)])
    placed = (
        hashed.groupBy("doc_id", "n_bytes", "bits").agg(F.count("*").alias("copies"))
        .select("*", F.inline(tried))
        .join(shards, ["depth", "shard"])
    )
    # Overflow pages: equal rows have equal sizes, so the page of the i-th copy follows from i.
    per_page = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    rows = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    over = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
    page = F.when(over, F.floor(F.col("copy") / per_page)).otherwise(0).cast("long")
    in_page = F.least(per_page, F.col("copies") - page * per_page) * F.col("n_bytes")
    return rows.select(
        "doc_id", "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), page.alias("page"),
        F.when(over, in_page).otherwise(F.col("shard_bytes")).alias("shard_bytes"),
    )


def folder_names(columns: list[str]) -> tuple[str, str]:
    """Names of the folders of shards and pages: ``shard`` and ``page``, with underscores before them where a column is called so."""
    taken = {c.lower() for c in columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"_{name}")

    return free("shard"), free("page")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> tuple[str, str]:
    """Write ``docs`` as one folder per shard and page below ``path``, all columns kept; returns ``folder_names`` of its columns.

    A shard's folder is named by ``b`` and the prefix of hash bits, so that the name of the undivided shard isn't empty.
    """
    names = folder_names(docs.columns)
    text = whole("text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(row, F.octet_length(text).cast("long").alias("n_bytes"), bits_of(F.col("doc_id"), text).alias("bits"))
    shards = directory(hashed.select("n_bytes", "bits"), limit)
    depths = [r["depth"] for r in shards.select("depth").distinct().collect()] or [0]
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("shard")) for d in sorted(depths)])
    placed = hashed.select("*", F.inline(tried)).join(shards, ["depth", "shard"])
    over = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
    shown = ["row", "shard", "page"]
    out = placed.filter(~over).withColumn("page", F.lit(0).cast("long")).select(*shown)
    if shards.filter(over).limit(1).count():
        # Rows of one hash are equal in size: the page of one follows from its number among them.
        per_page = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
        copies = ranked(numbered(placed.filter(over).select("row", "shard", "n_bytes", "bits"), "sharding-copies"), F.col("bits"), BLOCK)
        out = out.unionByName(copies.withColumn("page", F.floor(F.col("rank") / per_page).cast("long")).select(*shown))
    folders = (F.concat(F.lit("b"), "shard").alias(names[0]), F.col("page").alias(names[1]))
    out.repartition("shard", "page").select("row.*", *folders).write.mode("overwrite").partitionBy(*names).parquet(path)
    return names
