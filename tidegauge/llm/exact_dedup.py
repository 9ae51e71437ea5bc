"""Exact dedup by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of BLOCK code points. Equal blocks get one integer name, unequal
blocks different ones; then adjacent pairs of names are named in the same way, level by level, until
each document has a single name. Two texts are equal exactly if their names are: nothing rests on a
hash being free of collisions.

Blocks are named without shuffling a text twice. Blocks are aggregated by a 64-bit hash, keeping the
smallest and the largest block of each hash: where these are equal, the hash stands for one block, and
its name can be looked up by the hash alone. Only blocks of hashes that more than one block shares are
looked up by their content. Copies are combined before the shuffle, so a hot block costs one row a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, join_groups, write_table

BLOCK = 2048
#: Names are ranks within one of so many sorted ranges, so that no task sorts all of them.
RANGES = 1 << 12
ID = ["doc", "sha", "chars"]


def numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """An integer for each row of keys (all different): its rank in its range of the sort order."""
    spread = F.pmod(F.xxhash64(*order), F.lit(RANGES))
    rank = F.row_number().over(W.partitionBy("name_range").orderBy(*order)).cast("long")
    return keys.withColumn("name_range", spread).withColumn("name", rank * RANGES + F.col("name_range")).drop("name_range")


def block_rows(docs: DataFrame, block_hash: Callable[[Column], Column], block: int, content: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc"), F.length(text).alias("chars"), F.regexp_replace(text, f"{SPACE}+", "").alias("norm"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = F.when(F.length("norm") <= block, F.array("norm")).otherwise(cut)
    rows = rows.select("doc", "sha", "chars", cut.alias("cut")).withColumn("n", F.size("cut"))
    rows = rows.select(*ID, "n", F.posexplode("cut").alias("at", "block"))
    return rows.select(*ID, "n", "at", block_hash(F.col("block")).alias("h"), *["block"] * content)


def named_blocks(docs: DataFrame, block_hash: Callable[[Column], Column], block: int) -> DataFrame:
    """doc, sha, chars, n (blocks of the document), at, name: a row for each block."""
    with_text = block_rows(docs, block_hash, block, content=True)
    by_hash = with_text.groupBy("h").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count(F.lit(1)).alias("blocks"))
    found, _ = write_table(by_hash.select("h", "blocks", (F.col("low") == F.col("high")).alias("single")), "block-hashes")
    shared = found.where("not single").select("h")
    # even names for blocks that are alone with their hash, odd names for the others
    single = numbered(found.where("single").select("h", "blocks"), ["h"]).withColumn("name", F.col("name") * 2)
    single, _ = write_table(single, "block-singles")
    hashed, _ = write_table(block_rows(docs, block_hash, block, content=False), "block-rows")
    named = join_groups(hashed, single, ["h"], "blocks").drop("h", "blocks")
    if not shared.isEmpty():
        twins = with_text.join(shared, "h")
        variants = numbered(twins.select("h", "block").distinct(), ["h", "block"]).withColumn("name", F.col("name") * 2 + 1)
        named = named.unionByName(twins.join(variants, ["h", "block"]).select(named.columns))
    return write_table(named.select(*ID, "n", "at", "name"), "block-names")[0]


def named_documents(docs: DataFrame, block_hash: Callable[[Column], Column], block: int) -> DataFrame:
    """doc, sha, chars, copies (equal rows), level, name: level and name are one identity a text.

    A document leaves the recursion at the level where it has one name left, so that one very long
    text doesn't take the others through its levels.
    """
    rows, level, done = named_blocks(docs, block_hash, block).withColumn("copies", F.lit(None).cast("long")), 0, []
    while True:
        done.append(rows.where("n = 1").select(*ID, F.coalesce("copies", F.lit(1)).alias("copies"), F.lit(level).alias("level"), "name"))
        rows = rows.where("n > 1")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level += 1
        left, right = (F.max(F.when(F.col("at") % 2 == side, F.col("name"))) for side in (0, 1))
        # an even place is there once for each of the equal rows
        copies = F.coalesce(F.max("copies"), F.count_if(F.col("at") % 2 == 0))
        pairs = rows.groupBy(*ID, "n", F.shiftright("at", 1).alias("at")).agg(left.alias("left"), right.alias("right"), copies.alias("copies"))
        # -1 stands for no right neighbour; no name is negative
        pairs = pairs.withColumns({"n": F.shiftright(F.col("n") + 1, 1), "right": F.coalesce("right", F.lit(-1))})
        pairs, _ = write_table(pairs, f"block-pairs-{level}")
        names = numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        rows, _ = write_table(pairs.join(names, ["left", "right"]).select(*ID, "n", "at", "name", "copies"), f"block-names-{level}")


def find_copies(docs: DataFrame, *, block: int = BLOCK, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; null counts as empty. Of equal
    texts the row with the most code points in its original text, then the smallest doc_id (a null id
    last) stays; keep_id is its doc_id. Of fully equal rows (id and text) one is kept. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    named = named_documents(docs.select("doc_id", "text"), block_hash, block)
    best = F.struct("chars", F.col("doc").isNotNull().alias("has_id"), F.bitwise_not("doc").alias("first"))
    groups = named.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), F.max(best).alias("best"))
    groups, _ = write_table(groups, "copies")
    rows = join_groups(named, groups, ["level", "name"], "group_size").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = rows.withColumn("keep_id", F.bitwise_not("best.first"))
    again = F.row_number().over(W.partitionBy(*ID).orderBy("copy"))
    kept = F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best.chars")) & (again == 1)
    return rows.select(F.col("doc").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, block: int = BLOCK, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of docs that stay, with all their columns, texts unchanged. Defined as find_copies is.

    Columns starting with ``keep_`` are reserved.
    """
    text = F.coalesce("text", F.lit(""))
    key = lambda sha: F.concat_ws(":", F.col("doc_id").cast("string"), sha)
    stay = find_copies(docs, block=block, block_hash=block_hash).where("kept").select(key(F.col("text_sha256")).alias("keep_key"))
    rows = docs.withColumn("keep_key", key(F.sha2(F.regexp_replace(text, f"{SPACE}+", ""), 256)))
    longest = W.partitionBy("keep_key").orderBy(F.length(text).desc(), "text")
    rows = rows.join(stay, "keep_key", "left_semi").withColumn("keep_rank", F.row_number().over(longest)).where("keep_rank = 1")
    return rows.select([F.col(f"`{c}`") for c in docs.columns])
