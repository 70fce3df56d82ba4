"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Words are ordered by rarity; two sets with a Jaccard similarity of at least t share a word
among their rarest ones (prefix filter), differ little in size (length filter), and cannot be similar if too few
words are left after the shared one (positional filter). A parity bitmap of each set bounds the number of words that
only one of two sets has, and rejects nearly all other pairs inside the join.

A line goes if any earlier line (by document, its text's hash, then line number) is similar. That asks for one witness, not for all pairs:
1. equal sets are collapsed, combined before the shuffle;
2. two semi-joins by rare word find the sets that may have a partner at all; only these are looked at again;
3. every such set is verified against the earliest set of each of its words, which settles most of a large group;
4. what is left is verified against all its candidates.
Rarity, and which lines and documents take part in a step, are looked up in arrays of a fixed size, so no text is
shuffled to be filtered; a full array only filters less, the joins after it are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import EMPTY, by_place, only, release
from tidewatch.llm.fixed import fixed_array, may_contain, membership
from tidewatch.runtime import discard, materialize

SIMILARITY = (4, 5)
RARITY_SLOTS = 1 << 18
RARITY_BITS = 8
LAST = (1 << 63) - 1
#: Sets of up to this many words have a bitmap of 64 bits, larger ones of 128.
NARROW = 48


def _prefix(n: Column, overlap: Column) -> Column:
    return (n - overlap + 1).cast("int")


def _row_name(doc: Column, text: Column) -> Column:
    """Name of a row by its id and text. Names of rows without an id sort after all others."""
    name = F.xxhash64(doc, doc.isNull(), text)
    return F.when(doc.isNull(), name.bitwiseAND(F.lit(LAST))).otherwise(name.bitwiseOR(F.lit(-LAST - 1)))


def _plain(text: Column) -> Column:
    """`text` with blanks as the only white space inside its lines: finding these characters as bytes, then splitting by a
    blank, is several times faster than a regular expression on every line."""
    other = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\x0B\f\r"])
    return F.when(other, F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)


def _lines(documents: DataFrame) -> DataFrame:
    """One row for each line with a word: doc, name (of the row), line_no, line (words between blanks). Equal rows give equal lines."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    named = documents.select(F.coalesce(doc, F.lit(LAST)).alias("doc"), _row_name(doc, text).alias("name"), _plain(text).alias("text"))
    return (named.select("doc", "name", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
            .where(F.ltrim("line") != ""))


def _hashed(lines: DataFrame) -> DataFrame:
    """Replaces line by hashes, one of each of its distinct words."""
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), EMPTY)
    return lines.select("doc", "name", "line_no", hashes.alias("hashes"))


def _ordered(hashed: DataFrame, rarity: Column) -> DataFrame:
    """Adds words: the distinct words of a line, rarest first. A word is its step of rarity and 55 bits of its hash."""
    # The coalesce rules nulls out, so the array is sorted and compared as plain longs.
    coded = F.transform("hashes", lambda h: F.coalesce(F.get("rarity", h.bitwiseAND(F.lit(RARITY_SLOTS - 1))).bitwiseOR(
        F.shiftrightunsigned(h, RARITY_BITS + 1)), F.lit(0).cast("long")))
    # The optimizer merges both projections: the array is a constant of the plan, not a value of each row.
    return hashed.withColumn("rarity", rarity).withColumn("words", F.sort_array(coded)).drop("rarity")


def _parity(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def _odd(words: Column) -> Column:
    """The words that count in the second half of a bitmap twice as wide. Its first half is _parity of all words XOR that of these."""
    return F.filter(words, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(1)) == 1)


#: Columns of a bitmap four times as wide, for the sets that are compared in full.
WIDE = ("bits0", "bits1", "bits2", "bits3")


def _wide_parity(words: Column) -> dict[str, Column]:
    def part(k: int) -> Column:
        return _parity(F.filter(words, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(3)) == k))

    return {name: part(k) for k, name in enumerate(WIDE)}


def similar_lines(documents: DataFrame) -> DataFrame:
    """Columns name (see `_row_name`), line_no: the lines to remove from `documents` (doc_id, text), each once."""
    p, q = SIMILARITY
    spark = documents.sparkSession
    hashed = materialize(_hashed(_lines(documents)), "line-hashes")
    counted = (hashed.select(F.explode("hashes").alias("hash"))
               .groupBy(F.col("hash").bitwiseAND(F.lit(RARITY_SLOTS - 1)).alias("slot")).count())
    steps = F.least(F.floor(4 * F.log2("count")) + 1, F.lit((1 << RARITY_BITS) - 1))
    rarity = fixed_array(counted.select("slot", F.shiftleft(steps, 64 - RARITY_BITS - 1).alias("value")), RARITY_SLOTS)
    release(spark)

    # 1. Sets, and the earliest line of each.
    words = F.col("words")
    full = materialize(_ordered(hashed, rarity).select(
        "doc", "name", "line_no", F.xxhash64(words).alias("key"), F.size(words).alias("n"), _parity(words).alias("bits"),
        F.when(F.size(words) > NARROW, _parity(_odd(words))).otherwise(F.lit(0).cast("long")).alias("odd"),
        F.slice(words, 1, _prefix(F.size(words), F.ceil(F.size(words) * p / q))).alias("prefix")), "lines")
    discard(hashed)
    at = F.struct("doc", "name", F.col("line_no").alias("line"))
    first = F.min(F.struct(at.alias("at"), "n", "bits", "odd", "prefix")).alias("first")
    sets = materialize(full.groupBy("key").agg(first, F.count(F.lit(1)).alias("many")).select("key", "first.*", "many"), "line-sets")
    keyed = materialize(full.select("name", "line_no", "key"), "line-keys")
    discard(full)
    release(spark)

    # 2. Sets that may have a partner. Each set is listed under its rarest words.
    listed = sets.select("key", "bits", "odd", "n", F.posexplode("prefix").alias("pos", "word")).select(
        "word", "key", "bits", "odd", (F.col("n").cast("long") * (1 << 32) + F.col("n") - F.col("pos")).alias("size"))

    def n_of(side: str) -> Column:
        return F.shiftright(F.col(f"{side}.size"), 32)

    def left_of(side: str) -> Column:
        return F.col(f"{side}.size").bitwiseAND(F.lit((1 << 32) - 1))

    nx, ny = n_of("x"), n_of("y")
    narrow, second = F.col("x.bits").bitwiseXOR(F.col("y.bits")), F.col("x.odd").bitwiseXOR(F.col("y.odd"))
    apart = F.when(F.least(nx, ny) > NARROW, F.bit_count(second) + F.bit_count(second.bitwiseXOR(narrow))).otherwise(F.bit_count(narrow))
    close = ((F.col("x.word") == F.col("y.word")) & (F.col("x.key") != F.col("y.key"))
             & (apart * (p + q) <= (q - p) * (nx + ny))
             & (nx * p <= ny * q) & (ny * p <= nx * q) & (F.least(left_of("x"), left_of("y")) * (p + q) >= p * (nx + ny)))
    partners = listed.alias("x").join(listed.alias("y"), close, "left_semi").select("key").distinct()
    chosen = materialize(sets.select("key", "n", "at").join(partners, "key", "left_semi"), "line-candidates")
    release(spark)

    # Their words, read again from the lines that stand for them.
    rows = membership(chosen.select(F.xxhash64("at.name").alias("key")))
    places = membership(chosen.select(F.xxhash64("at.name", "at.line").alias("key")))
    some = documents.where(may_contain(rows, F.xxhash64(_row_name(F.col("doc_id").cast("long"), F.col("text").cast("string")))))
    again = _ordered(_hashed(_lines(some).where(may_contain(places, F.xxhash64("name", "line_no")))), rarity)
    again = again.select(F.xxhash64("words").alias("key"), "words").dropDuplicates(["key"])
    chosen = materialize(chosen.join(again.withColumns(_wide_parity(words)), "key"), "line-words")
    release(spark)
    listed = chosen.select("key", "n", *WIDE, "at", F.posexplode(F.slice("words", 1, _prefix(F.col("n"), F.ceil(F.col("n") * p / q)))).alias("pos", "word"))
    listed = materialize(listed, "line-lists")

    def verified(pairs: DataFrame) -> DataFrame:
        """Keys of the pairs (key, other) that are similar."""
        mine = chosen.select("key", "n", "words")
        theirs = chosen.select(F.col("key").alias("other"), F.col("n").alias("m"), F.col("words").alias("others"))
        both = F.size(F.array_intersect("words", "others"))
        return (pairs.distinct().join(mine, "key").join(theirs, "other").where(both * (p + q) >= p * (F.col("n") + F.col("m")))
                .select("key").distinct())

    # 3. Against the earliest set of each word.
    both = F.col("n") + F.col("m")
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in WIDE), F.lit(0))
    bound = differ * (p + q) <= (q - p) * both
    other_bits = [F.col(b).alias(f"other_{b}") for b in WIDE]
    sizes = (F.col("n") * p <= F.col("m") * q) & (F.col("m") * p <= F.col("n") * q)
    lead = listed.groupBy("word").agg(F.min(F.struct("at", F.col("key").alias("other"), F.col("n").alias("m"), *other_bits)).alias("lead")).select("word", "lead.*")
    pairs = listed.drop("at").join(lead.drop("at"), "word").where(F.col("key") != F.col("other")).where(bound & sizes).select("key", "other")
    gone = materialize(verified(pairs), "line-first")
    release(spark)

    # 4. The rest against every earlier candidate. Both sides are the same lists, shuffled once: which keys are open is
    # asked in the join, beside a comparison of both sides, so that it isn't moved below the shuffle of one of them.
    open_ = membership(chosen.select("key").join(gone, "key", "left_anti").select(F.xxhash64("key").alias("key")))
    x, y = listed.alias("x"), listed.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in WIDE), F.lit(0))
    rest = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("y.at") < F.col("x.at")) & (nx * p <= ny * q) & (ny * p <= nx * q)
                  & (differ * (p + q) <= (q - p) * (nx + ny))
                  & (F.least(nx - F.col("x.pos"), ny - F.col("y.pos")) * (p + q) >= p * (nx + ny))
                  & (may_contain(open_, F.xxhash64("x.key")) | (F.col("x.key") == F.col("y.key"))))
    rest = rest.select(F.col("x.key").alias("key"), F.col("y.key").alias("other"))
    gone = materialize(gone.unionByName(verified(rest)), "line-second")
    release(spark)

    # Every line of a similar set goes, of the other sets every line but the earliest.
    repeated = sets.where("many > 1").select("key", F.col("at.name").alias("kept_name"), F.col("at.line").alias("kept_line")).join(gone, "key", "left_anti")
    nowhere = F.lit(None)
    touched = repeated.unionByName(gone.select("key", nowhere.cast("long").alias("kept_name"), nowhere.cast("int").alias("kept_line")))
    removed = keyed.join(touched, "key").where(F.col("kept_name").isNull() | (F.col("name") != F.col("kept_name")) | (F.col("line_no") != F.col("kept_line")))
    return removed.select("name", "line_no").distinct()


def dedup_lines(documents: DataFrame) -> DataFrame:
    """`documents` with its own columns, texts without the lines that are similar to an earlier line.

    Lines are ordered by doc_id (null last), then by a hash of the text (for different texts of one id), then line number.
    Lines without a word are never compared and stay. A null text stays null; a text whose lines all go becomes empty.
    Rows with equal doc_id and text count as one document, so repeated rows stay equal. Extra columns are kept as they
    are, an empty table gives an empty result.
    """
    placed, [doc, text] = by_place(documents, "doc_id", "text")
    removed = similar_lines(only(documents, "doc_id", "text"))
    gone = materialize(removed.groupBy("name").agg(F.collect_list("line_no").alias("gone_lines")), "gone").withColumnRenamed("name", "gone_name")
    name = _row_name(F.col(doc).cast("long"), F.col(text).cast("string"))
    touched = may_contain(membership(gone.select(F.xxhash64("gone_name").alias("key"))), F.xxhash64(name))
    joined = placed.where(touched).join(gone, name == F.col("gone_name"), "left")
    # A column of its own, used twice, so that a text is split once and not again for each of its lines.
    joined = joined.withColumn("pieces", F.split(F.col(text).cast("string"), "\n", -1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("gone_lines"))
    left = F.when(F.col("gone_lines").isNull() | F.col(text).isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get("pieces", i)), "\n"))
    changed = joined.withColumn(text, left).select(*placed.columns)
    return placed.where(~touched).unionByName(changed).toDF(*documents.columns)
