"""What changed between two versions of documents, and what of a copy has to be looked at again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators import terms


def _counted(parts: DataFrame, name: str) -> DataFrame:
    """doc, digest, number of parts and a digest of their places, summed in the tasks first."""
    rows = parts.select("doc", "part", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"))
    # A sum of hashed places is the same for any order of the rows, and other places give another sum.
    place = F.sum(F.xxhash64("part").cast("decimal(20,0)"))
    return rows.groupBy("doc", "digest").agg(F.count("*").alias(f"n_{name}"), place.alias(f"places_{name}"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, digest, n_before, n_after, kind of texts that differ between two versions (doc, part, text).

    kind is added or dropped (the text is in one version only), repeated or thinned (more or fewer times than before), or
    moved (as often, at other places). Documents of which all texts and places are the same give no rows; a null text is
    an empty one. The versions meet as bags of digests, so no text is compared with another.
    """
    met = _counted(before, "before").join(_counted(after, "after"), ["doc", "digest"], "full")
    met = met.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_before", "n_after")})
    kind = (
        F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "dropped").when(F.col("n_before") < F.col("n_after"), "repeated")
        .when(F.col("n_before") > F.col("n_after"), "thinned").when(F.col("places_before") != F.col("places_after"), "moved")
    )
    return met.withColumn("kind", kind).where("kind IS NOT NULL").select("doc", "digest", "n_before", "n_after", "kind")


def to_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts of *after* (doc, part, text) whose text the document did not have before: only these need another check."""
    new = changes(before, after).where("kind = 'added'").select("doc", "digest")
    rows = after.withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return rows.join(new, ["doc", "digest"], "left_semi").select("doc", "part", "text")


# Placeholders of masked names.
PLACEHOLDER = r"(?:\p{Lu}{1,2}\._{2,}|_{3,}|\[…\])"


def left_in_copy(copy: DataFrame, forms: DataFrame) -> DataFrame:
    """id, kind, letters, n of what a copy (id, text) still shows: removed forms (term_id, term), and halves beside placeholders.

    A half is an initial or a capitalised word that touches a placeholder with nothing but one space between.
    """
    found = terms.find_terms(copy, forms).select("id", F.lit("form").alias("kind"), "start", "end")
    marked = copy.select("id", "text", F.split(F.regexp_replace("text", PLACEHOLDER, "\x01$0\x02"), "\x01").alias("ps"))
    pieces = marked.select("id", F.posexplode("ps").alias("nth", "piece"), F.size("ps").alias("n"))
    # The piece in front of a placeholder ends with the half, the placeholder's own piece goes on with it.
    behind = F.regexp_extract("piece", "(?s)^[^\x02]*\x02(.*)$", 1)
    rest = F.when(F.col("nth") == 0, F.col("piece")).otherwise(behind)
    before = F.when(F.col("nth") < F.col("n") - 1, F.regexp_extract(rest, r"(\p{Lu}\p{L}+|\p{Lu}\.) ?$", 1)).otherwise("")
    after = F.when(F.col("nth") > 0, F.regexp_extract(rest, r"^ ?(\p{Lu}\p{L}+|\p{Lu}\.(?!_))", 1)).otherwise("")
    halves = pieces.select("id", F.explode(F.array(before, after)).alias("letters")).where("letters <> ''")
    counted = halves.groupBy("id", "letters").agg(F.count("*").alias("n"))
    shown = found.join(copy, "id").select("id", "kind", F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("letters"))
    return shown.groupBy("id", "kind", "letters").agg(F.count("*").alias("n")).unionByName(counted.withColumn("kind", F.lit("half")))
