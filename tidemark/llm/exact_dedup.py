"""Exact deduplication by progressive refinement.

Rows are narrowed in three rounds, each on the survivors of the last:

1. by length: only lengths that at least two rows share survive;
2. by prefix hash: of those, only (length, prefix hash) pairs shared by two;
3. by full hash: SHA-256 over the whole text, computed only where the
   surviving (length, prefix) keys can match.

Texts never travel: every shuffle carries ids, lengths and hashes. Which rows
need the full hash is decided inside the scan by a membership bitmap of fixed
size (1 MB), so no document is shuffled to find out; a false positive costs
one hash and nothing else. Groups are aggregated map-side first and looked up
with ``common.lookup``, so a group holding a third of all rows is no hot spot.

Defined cases: null text is the empty text; texts are equal when identical
after lower-casing A-Z only; the largest id of a group stays (a null id is
smaller than any other); rows repeated with one id and one text are the same
document: all carry ``kept``, and ``keep_repeats`` tells how many there are;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bitmap, in_bitmap, lookup, materialize, table, text_or_empty

PREFIX_CHARS = 128


def prefix_key(text: Column, prefix_chars: int = PREFIX_CHARS) -> Column:
    """Hash of a text's length and normalised prefix."""
    return F.xxhash64(F.octet_length(text).cast("long"), F.substring(ascii_lower(text), 1, prefix_chars))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """One row per document: __id, keep_id, group_size, keep_repeats, kept,
    full_hash (null where rounds 1 and 2 already proved the row single), __pk
    and, with ``digest``, text_sha256 of every row from the same scan."""
    source = docs.select(docs[id_col].alias("__id"), text_or_empty(docs[text_col]).alias("__text"))
    norm = ascii_lower("__text")
    length = F.octet_length("__text").cast("long")
    first = prefix_key(F.col("__text"), prefix_chars)
    keys = materialize(source.select("__id", length.alias("__len"), first.alias("__pk")), "dedup-keys")
    total = keys.count()

    # Round 1: lengths that two rows share. Round 2: prefixes, among those.
    lengths = keys.groupBy("__len").agg(F.count(F.lit(1)).alias("__n1")).filter("__n1 > 1")
    by_length = lookup(keys, lengths, "__len", "__n1", total, F.xxhash64("__id")).filter("__n1 is not null")
    prefixes = by_length.groupBy("__pk").agg(F.count(F.lit(1)).alias("__n2")).filter("__n2 > 1")
    bits = bitmap(materialize(prefixes, "dedup-prefixes"), "__pk", "dedup-bits")

    # Round 3: the full hash, for survivors only.
    marked = in_bitmap(source.withColumn("__pk", first), bits, "__pk", "__maybe")
    full = F.sha2(norm, 256)
    asked = F.when(F.col("__maybe"), F.col("text_sha256") if digest else full).alias("full_hash")
    hashed = marked.withColumn("text_sha256", full if digest else F.lit(None).cast("string")).select("__id", "__pk", "text_sha256", asked)
    hashed = materialize(hashed, "dedup-hash")
    key = F.xxhash64("full_hash")
    survivors = hashed.filter("full_hash is not null").withColumn("__fk", key)
    by_id = survivors.groupBy("full_hash", "__id").agg(F.count(F.lit(1)).alias("__m"))
    groups = by_id.groupBy("full_hash").agg(
        F.max(F.struct("__id", "__m")).alias("__top"), F.sum("__m").alias("group_size")
    ).filter("group_size > 1")
    groups = groups.select("full_hash", F.col("__top.__id").alias("keep_id"), F.col("__top.__m").alias("keep_repeats"), "group_size")
    found = _lookup_text(hashed, groups, total)
    single = F.col("group_size").isNull()
    return found.select(
        "__id",
        F.when(single, F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("keep_repeats", F.lit(1).cast("long")).alias("keep_repeats"),
        (single | F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "full_hash",
        "__pk",
        "text_sha256",
    )


def _lookup_text(left: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``lookup`` on the SHA-256 text; single rows (null) spread by their id."""
    spread = F.concat(F.lit("~"), F.xxhash64("__id").cast("string"))
    keyed = left.withColumn("__key", F.coalesce("full_hash", spread))
    out = lookup(keyed, groups.withColumnRenamed("full_hash", "__key"), "__key", "group_size", total, spread)
    return out.drop("__key")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per distinct normalised text, all columns kept.

    Rows that the bitmap of (id, prefix) keys of dropped or repeated rows
    cannot hold pass through in the scan, unhashed; the others get their full
    hash and meet the dropped keys in a join. Of rows repeated with one id and
    one text any one stays."""
    decided = materialize(exact_groups(docs, id_col, text_col), "dedup-decided")
    asked = decided.filter("not kept or keep_repeats > 1").select("full_hash", F.col("__id").alias("__drop"), "kept", F.xxhash64("__id", "__pk").alias("__dk")).distinct()
    asked = materialize(asked, "dedup-asked")
    text = text_or_empty(docs[text_col])
    keyed = docs.withColumn("__tm_text", text).withColumn("__tm_key", F.xxhash64(docs[id_col], prefix_key(text)))
    marked = in_bitmap(keyed, bitmap(asked, "__dk", "dedup-bits"), "__tm_key", "__tm_maybe")
    sure = marked.filter("not __tm_maybe").select(*docs.columns)
    left = marked.filter("__tm_maybe").withColumn("__tm_sha", F.sha2(ascii_lower("__tm_text"), 256))
    gone = asked.filter("not kept").select("__drop", "full_hash")
    left = left.join(gone, (F.col("__tm_sha") == F.col("full_hash")) & F.col(id_col).eqNullSafe(F.col("__drop")), "left_anti")
    return sure.unionByName(left.dropDuplicates([id_col, "__tm_sha"]).select(*docs.columns))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    """Digest columns of the contract. The full hash of rows that the first
    rounds proved single is not needed for the decision; the contract asks it
    for every row, so it is computed in the scan of the third round."""
    found = exact_groups(docs, digest=True)
    return found.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from d)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
