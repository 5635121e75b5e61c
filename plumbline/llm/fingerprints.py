"""Document fingerprints by one-permutation MinHash with optimal densification, in column expressions.

Every five-word shingle is hashed once. The top bits of the hash name a bin, the rest is the value,
and a bin keeps its least value. An empty bin borrows from a bin found by probes that depend on the
empty bin alone, so two documents with the same filled bins borrow alike; each empty bin probes
independently, which is what makes the densification optimal (a bin's probes are a random order of
all bins: a few hashed ones first, then the bins ranked by hash). The lowest bits of the values are
stored, and likeness corrects for values that agree by chance.

Corner cases: words are what white space separates, after lower-casing; a text of 1 to 4 words has
one shingle; a null or empty text, or one without words, has the empty fingerprint, which is like
(1.0) another empty one and unlike (0.0) all others. Rows that repeat a doc_id each give a row; as
somebody's next document, such an id stands for its greatest text. A null doc_id has no place in the
order: such a row is its own head with nothing put behind it, and near_next is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.native_text import let, shingle_hashes, split_words
from plumbline.llm.saved import saved

SHINGLE = 5
BINS = 256
BITS = 8
PROBES = 12


def values(text: Column, bins: int = BINS) -> Column:
    """Array of ``bins`` values of 8 bits, empty without words."""
    shift = 63 - (bins.bit_length() - 1)
    empty = (1 << shift) - 1
    ends = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.shiftleft(b.cast("bigint"), shift).bitwiseOR(F.lit(empty)))

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, shift)

    def least(hashes: Column) -> Column:  # one value per bin, in bin order: the first of each bin in sorted order
        return F.transform(
            F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(hashes[F.greatest(i - 1, F.lit(0))]))),
            lambda h: h.bitwiseAND(F.lit(empty)),
        )

    def borrowed(values: Column, filled: Column, i: Column) -> Column:
        probe = F.filter(
            F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda t: F.xxhash64(i, t).bitwiseAND(F.lit(bins - 1).cast("bigint")).cast("int")),
            lambda j: values[j] != empty,
        )
        ranked = F.array_min(F.transform(filled, lambda j: F.xxhash64(j, i).bitwiseAND(F.lit(~(bins - 1))).bitwiseOR(j.cast("bigint"))))
        return values[F.coalesce(F.get(probe, F.lit(0)), ranked.bitwiseAND(F.lit(bins - 1).cast("bigint")).cast("int"))]

    def packed(values: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: values[j] != empty)

        def dense(filled: Column) -> Column:
            full = F.transform(values, lambda v, i: F.when(v != empty, v).otherwise(borrowed(values, filled, i)))
            return F.transform(full, lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")).cast("smallint"))

        return let(spots, dense)

    def of(hashes: Column) -> Column:
        kept = F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))
        return F.when(F.size(hashes) == 0, F.array().cast("array<smallint>")).otherwise(let(let(F.sort_array(F.concat(kept, ends)), least), packed))

    return let(shingle_hashes(split_words(F.lower(text), r"[\x20\x09-\x0D]+"), SHINGLE), of)


def packed_hex(stored: Column) -> Column:
    """The values as one hexadecimal string, two digits each."""
    return F.array_join(F.transform(stored, lambda v: F.substring(F.hex(v.cast("bigint") + 256), 2, 2)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated shingle similarity, 0 to 1, of two value arrays, corrected for values that agree by chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.size(a) - chance) / (1 - chance))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, estimate).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise((F.size(a) == F.size(b)).cast("double"))


def next_ids(ids: DataFrame) -> DataFrame:
    """Distinct doc_id with the next one in ascending order (the first after the last) and n_chars, without a single-task sort.

    Ids are dealt by range and saved, so the partition numbers cannot change; the next id is found inside a
    range, and for a range's last id in a table with one row per range.
    """
    ranged = ids.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars")).repartitionByRange("doc_id")
    ranged = saved(ranged.withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    everywhere = Window.partitionBy().orderBy("part")  # one row per range
    firsts = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(everywhere), F.min("first").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"),
    )
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("inside", inside).join(firsts, "part").select("doc_id", "n_chars", F.coalesce("inside", "after").alias("next_id"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's own head with the beginning of the next document in place of the
    last floor(n_chars / 2) code points. Texts are shuffled once by doc_id; the beginnings travel to the
    document before theirs, already cut to what it needs.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = base.where(F.col("doc_id").isNotNull())
    prints = placed.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), values(F.col("text")).alias("fingerprint"))
    prints = saved(prints)
    order = next_ids(prints)
    heads = placed.select("doc_id", "text")
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n_chars") / 2).cast("int").alias("most"))
    tails = heads.join(wanted, "doc_id").select(F.col("before").alias("doc_id"), F.col("text").substr(F.lit(1), F.col("most")).alias("tail"))
    repeated = prints.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    greatest = prints.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    if repeated:
        tails = tails.groupBy("doc_id").agg(F.max("tail").alias("tail"))
        greatest = heads.groupBy("doc_id").agg(F.max("text").alias("text")).select(F.col("doc_id").alias("next_id"), values(F.col("text")).alias("next_fingerprint"))
    near = order.select("doc_id", "next_id").join(greatest, "next_id").select("doc_id", "next_fingerprint")
    if repeated:  # prints holds a row per copy: give each text its own
        own = heads.withColumn("fingerprint", values(F.col("text")))
    else:
        own = heads.join(prints.select("doc_id", "fingerprint"), "doc_id")
    own = own.join(tails, "doc_id", "left").join(near, "doc_id", "left")
    lost = base.where(F.col("doc_id").isNull()).select(
        "doc_id", "text", values(F.col("text")).alias("fingerprint"), F.lit(None).cast("string").alias("tail"), F.lit(None).cast("array<smallint>").alias("next_fingerprint")
    )
    both = own.select("doc_id", "text", "fingerprint", "tail", "next_fingerprint").unionByName(lost)
    n = F.length("text")
    head = F.col("text").substr(F.lit(1), (n - F.floor(n / 2)).cast("int"))
    # a copy shorter than the longest of its id gets no more than its own half
    edited = F.concat(head, F.coalesce(F.col("tail").substr(F.lit(1), F.floor(n / 2).cast("int")), F.lit("")))
    both = both.select("doc_id", n.cast("bigint").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    both = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", values(F.col("edited")).alias("edited_fingerprint")
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(packed_hex(F.col("fingerprint"))).alias("fingerprint"),
        F.lower(packed_hex(F.col("edited_fingerprint"))).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
