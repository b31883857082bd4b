"""A user's terms in texts: whole words in any case, a space like a hyphen, met by hashes of token runs.

A text is read as tokens: runs of letters, digits and underscores, and single other characters, with a mark behind a
token where white space or hyphens follow. A term is read the same way, so it occurs where its tokens and marks do; behind
a full stop the mark does not count ("St. Gallen", "St.Gallen"). Token runs start only where a term's first token stands,
and meet the terms by their hash, so the table of terms may be of any size and is never turned into a pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import keys
from lexforge.operators import places, spans
from lexforge.session import Scratch

# What stands between the words of a term.
_BETWEEN = r"[\s  \-‐‑]"
_TOKEN = rf"[\p{{L}}\p{{N}}_]+|{_BETWEEN}+|(?s:.)"


def _tokens(df: DataFrame, by: str) -> DataFrame:
    """*by*, at, start, end, token (lower case, with a mark where a gap follows that counts) of texts (*by*, plain)."""
    cutted = df.select(by, F.posexplode(F.regexp_extract_all("plain", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    order = Window.partitionBy(by).orderBy("pos")
    placed = cutted.withColumn("end", F.sum(F.length("token")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    gap = F.col("token").rlike(f"^{_BETWEEN}")
    placed = placed.withColumn("open", F.coalesce(F.lead(gap).over(order), F.lit(False))).where(~gap)
    low = F.lower("token")
    marked = F.concat(low, F.when(F.col("open") & (low != "."), "\x01").otherwise("\x02"))
    return placed.select(by, "pos", (F.col("end") - F.length("token")).alias("start"), "end", low.alias("first"), marked.alias("token"))


def read_terms(terms: DataFrame) -> DataFrame:
    """term_id, first, n, run of terms (term_id, term): first token, number of tokens, and the run as texts have it.

    Terms without a token are left out; of terms that read alike the least id stays.
    """
    plain = places.with_places(terms.select("term_id", "term"), "term")
    rows = _tokens(plain.select("term_id", F.trim(F.col("plain.text")).alias("plain")), "term_id")
    read = rows.groupBy("term_id").agg(F.sort_array(F.collect_list(F.struct("pos", "first", "token"))).alias("all"))
    # What follows a term's last token is not a part of it.
    run = F.array_join(F.transform("all", lambda x: x["token"]), "")
    run = F.left(run, F.length(run) - 1)
    read = read.select("term_id", F.col("all")[0]["first"].alias("first"), F.size("all").alias("n"), run.alias("run"))
    return read.groupBy("first", "n", "run").agg(F.min("term_id").alias("term_id"))


def find_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term_id, start, end (raw places) of every occurrence of terms (term_id, term) in texts (id, text).

    Occurrences may overlap; :func:`choose` picks among them.
    """
    # Written, so that its size is known and Spark may send it to the texts; texts are dealt out once, as they are.
    read = Scratch(texts.sparkSession).cut(read_terms(terms), "terms")
    sizes = sorted(r["n"] for r in read.select("n").distinct().collect())  # a term's numbers of tokens: a few
    docs = places.with_places(texts.select("id", "text").repartition("id"))
    if not sizes:
        return docs.limit(0).select("id", F.lit(0).cast("long").alias("term_id"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    rows = keys.computed(docs, F.regexp_extract_all("plain.text", F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    size = F.transform("tokens", F.length)
    rows = rows.select("id", "tokens", places.laid(F.col("plain"), size, size).alias("laid"))
    gap = lambda t: F.coalesce(t.rlike(f"^{_BETWEEN}"), F.lit(False))
    low, place = F.lower, lambda i: F.get("laid", i)
    mark = lambda t, i: F.when(gap(F.get("tokens", i + 1)) & (t != "."), "\x01").otherwise("\x02")
    each = F.transform("tokens", lambda t, i: F.struct(gap(t).alias("gap"), low(t).alias("first"), F.concat(low(t), mark(t, i)).alias("token"), place(i)["start"].alias("start"), place(i)["end"].alias("end")))
    rows = keys.computed(rows.select("id", F.filter(each, lambda x: ~x["gap"]).alias("words")), F.transform("words", lambda x, i: F.struct(x["first"], x["start"], F.slice("words", i + 1, F.lit(sizes[-1])).alias("next"))).alias("all"))
    starts = rows.select("id", F.explode("all").alias("x")).select("id", "x.*").join(read.select("first").distinct(), "first", "left_semi")
    whole = lambda n: F.array_join(F.transform(F.slice("next", 1, n), lambda x: x["token"]), "")
    run = lambda n: F.struct(F.lit(n).alias("n"), F.left(whole(n), F.length(whole(n)) - 1).alias("run"), F.get("next", F.lit(n - 1))["end"].alias("end"))
    runs = F.explode(F.filter(F.array(*map(run, sizes)), lambda r: r["n"] <= F.size("next")))
    asked = starts.select("id", "start", runs.alias("r")).select("id", "start", "r.*")
    return asked.join(read.select("n", "run", "term_id"), ["n", "run"]).select("id", "term_id", "start", "end")


def choose(own: DataFrame, shown: DataFrame) -> DataFrame:
    """id, start, end, source, row: a user's places (id, term_id, start, end) and shown ones (id, row, start, end) without overlap.

    The wider place stays; of equal ones the user's, then the lower number. What no longer occurs is not in either table,
    so a repeated check drops it.
    """
    tie = F.struct(F.col("source"), F.col("row"))
    both = own.select("id", "start", "end", F.lit(0).alias("source"), F.col("term_id").alias("row")).unionByName(shown.select("id", "start", "end", F.lit(1).alias("source"), "row"))
    return spans.widest_first(both.withColumn("tie", tie), tie="tie").drop("tie")
