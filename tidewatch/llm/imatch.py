"""I-Match fingerprints over a band of inverse document frequency, with DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band. Its lower end rises with the mean number of terms
of a text, so that at most LEXICON terms can qualify: the sum of all frequencies divided by the lowest one. The
lexicon is coded as a bitmap of fixed size with two probes, which lets about 0.4 % of other terms pass, for all texts
alike. A text's distinct terms in the lexicon fall into SUBSETS random sub-lexicons; each sub-lexicon's sorted terms are
hashed. Long texts use thinner sub-lexicons, by powers of two, so a sub-lexicon holds about one term of a text
of any length and one edit changes only a few hashes; two neighbouring densities are kept, so texts of like size compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import EMPTY, hashes_of, release
from tidewatch.llm.fixed import may_contain, membership
from tidewatch.llm.ordering import part_ends, with_guests
from tidewatch.runtime import discard, materialize

LEXICON = 1 << 18
LEAST_SHARE, MOST_SHARE = 0.0005, 0.1
SUBSETS = 32
FEW_TERMS = 8
PART_CHARS = 1 << 23
PLAIN = 64      # added to the level of a text with too few terms in the lexicon, which keeps all its terms


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(hashes_of(text)), EMPTY)


def _probe(term: Column) -> Column:
    return F.shiftrightunsigned(term, 17)


def lexicon(texts: DataFrame) -> Column:
    """Bitmap of the terms in the band, from the terms of all rows of `texts` (text)."""
    counts = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "terms")
    release(texts.sparkSession)
    rows, total = texts.count(), counts.agg(F.sum("n")).first()[0] or 0
    least, most = max(2, LEAST_SHARE * rows, total / LEXICON), max(2, MOST_SHARE * rows)
    band = counts.where(F.col("n").between(least, most)).select(F.explode(F.array(F.col("term"), _probe(F.col("term")))).alias("key"))
    bitmap = membership(band)
    discard(counts)
    return bitmap


def with_prints(frame: DataFrame, texts: list[str], known: Column) -> DataFrame:
    """Adds prints: for each of the columns `texts` a struct of level and the hashes of its two densities of sub-lexicons."""
    def kept(lexicon_, terms):
        return F.filter(terms, lambda h: may_contain(lexicon_, h) & may_contain(lexicon_, _probe(h)))

    def thin(terms, level):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
        return F.filter(terms, lambda h: F.shiftrightunsigned(h, 46).bitwiseAND(mask) == 0)

    def hashed(terms):
        def one(j):
            part = F.filter(terms, lambda h: F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(SUBSETS - 1)) == j)
            return F.when(F.size(part) > 0, F.xxhash64(part).bitwiseAND(F.lit(0xFFFFFF)) + 1).otherwise(0).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)

    # The bitmap and the terms are named once each, so the optimizer merges these projections and keeps the bitmap as a
    # constant of the plan instead of a value of each row.
    frame = frame.withColumn("lexicon", known).withColumn("terms", F.transform(F.array(*texts), _terms))
    frame = frame.withColumn("both", F.get(F.transform(F.array("lexicon"), lambda b: F.transform("terms", lambda t: F.struct(
        t.alias("all"), kept(b, t).alias("inside")))), 0)).drop("lexicon", "terms")
    frame = frame.withColumn("used", F.transform("both", lambda x: F.when(F.size(x["inside"]) >= FEW_TERMS, x["inside"]).otherwise(x["all"])))
    level = F.transform("used", lambda u: F.greatest(F.ceil(F.log2(F.size(u) / SUBSETS)), F.lit(0)).cast("int"))
    frame = frame.withColumn("levels", F.transform(level, lambda x: F.coalesce(x, F.lit(0))))
    frame = frame.withColumn("dense", F.zip_with("used", "levels", lambda u, x: F.sort_array(thin(u, x))))
    frame = frame.withColumn("sparse", F.zip_with("dense", "levels", lambda u, x: thin(u, x + 1)))
    shown = F.zip_with("levels", "both", lambda x, b: x + F.when(F.size(b["inside"]) >= FEW_TERMS, 0).otherwise(PLAIN))
    prints = F.arrays_zip(shown.alias("level"), F.transform("dense", hashed).alias("dense"), F.transform("sparse", hashed).alias("sparse"))
    return frame.withColumn("prints", prints).drop("both", "used", "levels", "dense", "sparse")


def as_text(print_: Column) -> Column:
    """level:hashes of the sub-lexicons in seven digits (0000000 for an empty one):hashes of the thinner ones."""
    def digits(values):
        return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 7, "0"))), "")
    return F.concat(print_["level"].cast("string"), F.lit(":"), digits(print_["dense"]), F.lit(":"), digits(print_["sparse"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of the sub-lexicons with a term of either text whose hashes agree, at a density that both have. 1 for two texts
    without terms, 0 if their numbers of terms are too far apart."""
    def share(u, v):
        used = F.aggregate(F.zip_with(u, v, lambda x, y: F.when((x != 0) | (y != 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        same = F.aggregate(F.zip_with(u, v, lambda x, y: F.when((x != 0) & (x == y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return F.when(used > 0, same / used).otherwise(1.0)
    return (F.when(a["level"] == b["level"], share(a["dense"], b["dense"]))
            .when(a["level"] + 1 == b["level"], share(a["sparse"], b["dense"]))
            .when(a["level"] == b["level"] + 1, share(a["dense"], b["sparse"])).otherwise(0.0))


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row for every
    row of `documents` (doc_id, text).

    The next document is the one below in descending doc_id (null last; rows with one id by the digest of their text);
    rows equal in both are one document here and all get its result. A null text counts as empty, a single document is
    its own next one. Extra columns are ignored, an empty table gives an empty result.

    Texts are shuffled once, to the parts of their order; the last row of a part is a guest at the start of the following part, so
    the row before a row is its next document.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.bitwise_not(F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"))))
    ends = part_ends(base.select("doc_id", "key", F.length("text").alias("n")), PART_CHARS, "n", "doc_id", "key")
    known = lexicon(base)
    order = Window.partitionBy("part").orderBy("own", "doc_id", "key")
    placed = with_guests(base, ends, "doc_id", "key")

    cut = F.expr("cast(length(text) div 3 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.lag("text").over(order), F.lit(1), cut))
    again = (F.lag("own").over(order) & F.col("own") & F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id")) & (F.lag("key").over(order) == F.col("key")))
    rows = placed.select("part", "own", "doc_id", "key", "text", F.coalesce(edited, F.lit("")).alias("edited"), F.coalesce(again, F.lit(False)).alias("again"))
    printed = with_prints(rows, ["text", "edited"], known).select(
        "part", "own", "doc_id", "key", "again", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.get("prints", 0).alias("own_print"), F.get("prints", 1).alias("changed"))
    # Of equal rows the first one has the next document before it, and the others take its result.
    found = F.when(~F.col("again"), F.struct("edited_sha256", "changed", F.lag("own_print").over(order).alias("other")))
    whole = printed.select("own", "doc_id", "n_chars", "own_print", F.last(found, ignorenulls=True).over(order).alias("found")).where("own")
    return whole.select("doc_id", "n_chars", "found.edited_sha256", as_text(F.col("own_print")).alias("fingerprint"), as_text(F.col("found.changed")).alias("edited_fingerprint"),
                        likeness(F.col("own_print"), F.col("found.changed")).cast("double").alias("near_edited"),
                        likeness(F.col("own_print"), F.col("found.other")).cast("double").alias("near_next"))
