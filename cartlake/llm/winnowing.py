"""Document fingerprints by winnowing; DataFrame and SQL functions only.

A text's k-grams are runs of ``k`` words (runs of characters other than space and \\x09-\\x0D), hashed to 64 bits;
each window of ``w`` consecutive k-grams keeps its smallest hash, the rightmost one on ties, with its position.
Any run of w + k - 1 words that two texts share yields a common hash, and no common run shorter than k words does.
A text of fewer than k words is one k-gram; of fewer than w k-grams, one window. Words longer than ``PIECE``
characters count as several, so that texts without spaces have fingerprints too.

Window minima come from doubling: least(h[i], h[i+1]) over spans of 2, 4, ... positions, so w is a power of two.
Hash and position travel in one number: the hash's upper bits, then the position counted from the end.

Defined cases: null text is empty and has the empty fingerprint; two empty fingerprints are alike (1), an empty and
a full one are not (0); equal texts have equal fingerprints; an empty table gives an empty result; ids that
repeat follow each other in the order of their texts' hashes; null ids come first, in an order of their
texts' hashes; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlake.llm.columns import need

PIECE = 24
POSITION_BITS = 24
LOW = (1 << POSITION_BITS) - 1
BREAKS = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The text's words; empty strings between neighbouring breaks go."""
    return F.filter(F.split(F.translate(text, BREAKS, " " * len(BREAKS)), " ", -1), lambda w: w != "")


def pieces(tokens: Column) -> Column:
    """Words of more than ``PIECE`` characters cut into several; most texts have none and stay as they are."""
    cut = F.flatten(F.transform(tokens, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(w) - 1) / PIECE).cast("int")), lambda j: F.substring(w, j * PIECE + 1, F.lit(PIECE)))))
    return F.when(F.exists(tokens, lambda w: F.char_length(w) > PIECE), cut).otherwise(tokens)


def window_minima(tokens: str, *, k: int, w: int, skipped: str = "0") -> str:
    """SQL for the code of each window's k-gram of the word array ``tokens``; ``skipped`` words lie before it.

    A code orders by the k-gram's hash and then from the right: the hash's upper bits, then its place from the end.
    """
    gram = f"xxhash64(slice({tokens}, i, {k}))"
    expression = f"if(size({tokens}) = 0, cast(array() as array<bigint>), transform(sequence(1, greatest(1, size({tokens}) - {k - 1})), i -> (({gram}) & ~{LOW}L) | ({LOW} - (i + {skipped}) % {LOW})))"
    for step in (1 << j for j in range(int(math.log2(w)))):
        # Where the spans so far reach past the end, one minimum stands for all that is left.
        expression = f"transform(array({expression}), m -> if(size(m) = 0, m, if(size(m) <= {step}, array(array_min(m)), zip_with(slice(m, 1, size(m) - {step}), slice(m, {step + 1}, size(m)), (a, b) -> least(a, b)))))[0]"
    return expression


def picked(minima: Column) -> Column:
    """(hash, position) of each k-gram that some window keeps, by position."""
    return F.transform(F.array_distinct(minima), lambda c: F.struct(F.shiftright(c, POSITION_BITS).alias("hash"), (F.lit(LOW) - c.bitwiseAND(F.lit(LOW))).alias("position")))


def fingerprint_text(minima: Column) -> Column:
    """``position:hash`` of each selected k-gram, comma-joined."""
    low = F.lit(LOW)
    return F.array_join(F.transform(F.array_distinct(minima), lambda c: F.concat((low - c.bitwiseAND(low)).cast("string"), F.lit(":"), F.hex(F.shiftrightunsigned(c, POSITION_BITS)))), ",")


def hashes(minima: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(minima), lambda c: F.shiftright(c, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of hashes; two empty sets are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(docs: DataFrame, *, k: int = 5, w: int = 8) -> DataFrame:
    """doc_id and the array ``picked`` of (hash, position) of each whole text."""
    rows = need(docs, "doc_id", "text").select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    minima = rows.select("doc_id", pieces(F.col("words")).alias("tokens")).select("doc_id", F.expr(window_minima("tokens", k=k, w=w)).alias("minima"))
    return minima.select("doc_id", picked(F.col("minima")).alias("picked"))


def id_ranges(docs: DataFrame, *, rows_per_range: int = 5_000) -> DataFrame:
    """doc_id, text (null: empty), tie and range: ids cut into ranges at approximate quantiles, null ids by their texts' hashes."""
    rows = need(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n_ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id").count() // rows_per_range + 1)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n_ranges for i in range(1, n_ranges)] or [0.5], 10 * n_ranges)).first()[0] or []
    return rows.withColumn("range", F.coalesce(_range_of("doc_id", sorted(set(cuts))), -1 - F.pmod("tie", F.lit(n_ranges)).cast("int")))


def _range_of(column: str, cuts: list) -> Column:
    """How many cuts lie below the value, counted first among every n-th cut and then among those between two."""
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    if not cuts:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    value = F.col(column).cast("long")
    coarse = F.size(F.filter(F.lit([g[-1] for g in groups]).cast("array<bigint>"), lambda c: c < value))
    fine = F.lit([*groups, []]).cast("array<array<bigint>>")
    return F.when(value.isNotNull(), coarse * width + F.size(F.filter(F.element_at(fine, coarse + 1), lambda c: c < value)))


def fingerprint_edits(docs: DataFrame, *, k: int = 5, w: int = 8) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike its own is to the edited one's and to the next text's.

    The edited text is the text with its last quarter of characters replaced by as many from the start of the next
    text; after the last one comes the first. Only neighbours within a range of ids meet in a window; each range's last
    row takes the first text of the next range. The edited text's windows that lie in unchanged words are the text's own.
    """
    ranged = id_ranges(docs)
    firsts = ranged.groupBy("range").agg(F.min_by("text", F.struct(F.coalesce("doc_id", F.lit(0)), "tie", "text")).alias("first_text"))
    # The ring of ranges holds a number for each; the texts are joined to it.
    ring = Window.orderBy("range")
    follower = F.coalesce(F.lead("range").over(ring), F.first("range").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    followers = ranged.select("range").distinct().select(F.col("range").alias("at"), follower.alias("follower"))
    firsts = followers.join(firsts.withColumnRenamed("range", "follower"), "follower").select("at", F.col("first_text").alias("after_text"))
    near = Window.partitionBy("range").orderBy("doc_id", "tie", "text_key")
    rows = ranged.withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256)).withColumn("next_text", F.lead("text").over(near))
    rows = rows.join(firsts, F.col("next_text").isNull() & (F.col("range") == F.col("at")), "left")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.coalesce("next_text", "after_text"), F.lit(1), quarter))
    carried = ["range", "doc_id", "tie", "text_key", "n_chars", "after_text"]
    rows = rows.select(*carried, words(F.col("text")).alias("own"), edited.alias("edited"))
    rows = rows.select(*carried, "own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), words(F.col("edited")).alias("other"), words(F.coalesce("after_text", F.lit(""))).alias("after"))
    rows = rows.select(*carried, "edited_sha256", *(pieces(F.col(c)).alias(c) for c in ("own", "other", "after")))
    differs = F.array_position(F.zip_with("own", "other", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    same = F.when(differs > 0, differs - 1).otherwise(F.size("own"))
    rows = rows.withColumn("shared", F.greatest(F.lit(0), same - (k + w - 2)).cast("int"))
    rows = rows.select(*carried, "edited_sha256", "shared", F.expr(window_minima("own", k=k, w=w)).alias("own"), F.expr("if(shared > 0, slice(other, shared + 1, size(other)), other)").alias("other"), F.expr(window_minima("after", k=k, w=w)).alias("after"))
    rows = rows.select(*carried, "edited_sha256", "own", F.concat(F.slice("own", 1, F.col("shared")), F.expr(window_minima("other", k=k, w=w, skipped="shared"))).alias("other"), "after")
    rows = rows.select(*carried, "edited_sha256", fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("other")).alias("edited_fingerprint"), hashes(F.col("own")).alias("own"), hashes(F.col("other")).alias("other"), hashes(F.col("after")).alias("after"))
    rows = rows.select(*carried[:-1], "edited_sha256", "fingerprint", "edited_fingerprint", "own", likeness(F.col("own"), F.col("other")).alias("near_edited"), F.when(F.col("after_text").isNotNull(), F.col("after")).alias("after"))
    rows = rows.withColumn("after", F.coalesce(F.lead("own").over(near), F.col("after")))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("own"), F.col("after")).alias("near_next"))
