"""Queries over the words of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import vocabulary as v
from lexforge.session import Scratch, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("court"), F.coalesce("text", F.lit("")).alias("text"))


def _firsts(spark, sf):
    """Stand-ins for first names: capitalised words that begin at least a line."""
    lines = _docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("t"))
    return lines.select(F.lower(F.regexp_extract("t", r"^(\p{Lu}\p{L}+) ", 1)).alias("name")).where("name <> ''").distinct()


def _names(stats):
    return stats.where("length(word) % 3 = 0").select(F.col("word").alias("part"), F.when(F.expr("docs % 2 = 0"), F.col("cap") % 7).otherwise(0).alias("bearers"))


def _stats(spark, sf):
    return v.word_statistics(v.admitted(_docs(spark, sf), 10), _firsts(spark, sf))


def _written(spark, sf):
    """The statistics, counted once for a plan that reads them several times."""
    return Scratch(spark).cut(_stats(spark, sf), "stats")


def word_stats(spark, sf):
    return _stats(spark, sf)


#: Words before a name: titles, parts of titles, and words that are none.
_TITLES = ("Herr", "Frau", "Dr.", "Sig.ra", "M.", "Prof. Dr.", "Richterin", "Herrn Dr", "Haus")


def title_reach(spark, sf):
    """Titles at 1 to 60 characters of white space before a name."""
    o = table(spark, sf, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, _TITLES)), (F.col("o_custkey") % len(_TITLES)).cast("int")).alias("title"), (F.col("o_orderkey") % 60 + 1).cast("int").alias("gap"))
    white = F.when(F.col("gap") % 2 == 0, F.concat(F.repeat(F.lit(" "), F.col("gap") - 1), F.lit("\n"))).otherwise(F.repeat(F.lit(" "), F.col("gap")))
    docs = o.select(F.col("o_orderkey").alias("id"), F.lit("c").alias("court"), F.concat(F.lit("Es sagt "), "title", white, F.lit("Muster "), F.concat(F.lit("nummer"), F.translate(F.col("gap").cast("string"), "0123456789", "abcdefghij"))).alias("text"))
    rows = v.word_rows(docs)
    titled = F.col("context").rlike(rf"(?:{'|'.join(v.TITLE_FORMS)})\s+$")
    return rows.where("word = 'muster'").select("id", F.length("context").cast("long").alias("seen"), titled.alias("titled"))


def vocabulary_decide(spark, sf):
    stats = _written(spark, sf)
    total = v.admitted(_docs(spark, sf), 10).count()
    return v.decide(stats, _names(stats), 100_000, total, v.Rules(unknown_min_docs=100, unknown_word_docs=50, noun_docs=60))


def vocabulary_marks(spark, sf):
    return vocabulary_decide(spark, sf).where("mark <> ''").select(F.concat("mark", "word").alias("line"))


def name_bearers(spark, sf):
    names = table(spark, sf, "customer").select(F.regexp_replace(F.concat_ws("-", F.col("c_mktsegment"), F.lit("von"), F.substring("c_mktsegment", 1, 4)), " ", "-").alias("name"), F.col("c_nationkey").cast("long").alias("bearers"), (F.col("c_custkey") % 2 == 0).alias("given"))
    return v.name_bearers(names)


def holdout_split(spark, sf):
    return _docs(spark, sf).select("id", v.held_out(F.col("id"), 10).alias("held_out"))


def compound_depth0(spark, sf):
    stats = _written(spark, sf)
    return v.compound_of_two(stats.select("word"), stats.where("docs >= 20").select("word"))


def compound_exceptions(spark, sf):
    stats = _written(spark, sf)
    common = stats.where("docs >= 20").select("word")
    names = _names(stats).select(F.col("part").alias("word")).where(F.length("word") >= 6).join(common, "word", "left_anti")
    return v.compounds(names, common)


def language_by_line(spark, sf):
    return v.language_of_lines(_docs(spark, sf))


def dehyphenate(spark, sf):
    text = F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n$2")
    return _docs(spark, sf).select("id", F.md5(v.dehyphenated(F.concat(text, F.lit(" see www.example.com/x now")))).alias("digest"))


def unknown_runs(spark, sf):
    return v.unknown_runs(_docs(spark, sf), _stats(spark, sf).where("docs >= 5").select("word"))


def given_name_runs(spark, sf):
    return v.given_name_runs(_docs(spark, sf), _firsts(spark, sf))


QUERIES = {f.__name__: f for f in (word_stats, title_reach, vocabulary_decide, vocabulary_marks, name_bearers, holdout_split, compound_depth0, compound_exceptions, language_by_line, dehyphenate, unknown_runs, given_name_runs)}

_HOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 33), lambda i: CAST(instr('0123456789abcdef', substr(md5(CAST(doc_id AS VARCHAR)), CAST(i AS INT), 1)) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 10) = 0"
_STATS = f"""
docs AS (SELECT doc_id AS id, source AS court, text, {_HOLD} AS held FROM documents WHERE text IS NOT NULL),
firsts AS (SELECT DISTINCT lower(regexp_extract(t, '^(\\p{{Lu}}\\p{{L}}+) ', 1)) AS name FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM docs) WHERE regexp_matches(t, '^\\p{{Lu}}\\p{{L}}+ ')),
tokens AS MATERIALIZED (SELECT id, court, ts[i] AS token, gs[i] AS gap, ts[i - 1] AS prev, coalesce(gs[i - 1], '') AS gap1, coalesce(ts[i - 2], '') AS prev2 FROM (
  SELECT id, court, ts, gs, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT id, court, regexp_extract_all(text, '\\p{{L}}{{2,}}') AS ts, string_split_regex(text, '\\p{{L}}{{2,}}') AS gs FROM docs WHERE length(text) >= 300 AND NOT held))),
words AS (SELECT id, court, lower(token) AS word, substr(token, 1, 1) <> lower(substr(token, 1, 1)) AS cap, token = upper(token) AS upper,
  right(prev2 || gap1 || coalesce(prev, '') || gap, {v.TITLE_REACH}) AS context, CASE WHEN gap = ' ' AND regexp_matches(prev, '^\\p{{Lu}}\\p{{L}}+$') THEN lower(prev) END AS lead FROM tokens),
marked AS (SELECT w.*, cap AND regexp_matches(context, '(?:{"|".join(v.TITLE_FORMS)})\\s+$') AS titled, f.name IS NOT NULL AS first
  FROM words w LEFT JOIN firsts f ON f.name = w.lead),
stats AS MATERIALIZED (SELECT word, count(DISTINCT id)::BIGINT AS docs, count(DISTINCT court)::BIGINT AS courts, count(*) FILTER (WHERE cap)::BIGINT AS cap, count(*) FILTER (WHERE NOT cap)::BIGINT AS low,
  count(*) FILTER (WHERE cap AND upper)::BIGINT AS upper, count(*) FILTER (WHERE titled)::BIGINT AS titled, count(*) FILTER (WHERE cap AND NOT titled AND first)::BIGINT AS firsted FROM marked GROUP BY word)"""
_LINKS = ", ".join(f"'{x}'" for x in v.LINKS)
_STRIP = lambda s: f"CASE WHEN suffix(word, '{s}') THEN substr(word, 1, length(word) - {len(s)}) END"
_DECIDE = f"""WITH {_STATS},
total AS (SELECT count(*) AS n FROM docs WHERE length(text) >= 300 AND NOT held),
names AS (SELECT word AS part, CASE WHEN docs % 2 = 0 THEN cap % 7 ELSE 0 END AS b FROM stats WHERE length(word) % 3 = 0),
j AS (SELECT s.*, n0.part IS NOT NULL AS listed, n0.part IS NOT NULL OR n1.part IS NOT NULL OR n2.part IS NOT NULL OR n3.part IS NOT NULL AS is_name,
    CASE WHEN coalesce(n0.b, 0) > 0 THEN n0.b ELSE coalesce(n1.b, n2.b, n3.b, 0) END AS people, titled + firsted AS marked, greatest(1, cap) AS caps
  FROM (SELECT *, {_STRIP("s")} AS k1, {_STRIP("es")} AS k2, {_STRIP("in")} AS k3 FROM stats WHERE docs >= 5 AND (courts >= 2 OR docs >= 30)) s
  LEFT JOIN names n0 ON n0.part = s.word LEFT JOIN names n1 ON n1.part = s.k1 LEFT JOIN names n2 ON n2.part = s.k2 LEFT JOIN names n3 ON n3.part = s.k3),
decided AS (SELECT word, cap, low, CASE
    WHEN upper * 2 >= cap AND cap >= 5 AND length(word) <= 6 AND NOT listed THEN 'acronym'
    WHEN word NOT IN ({", ".join(f"'{o}'" for o in v.OFFICES)}) AND marked >= 0.25::DOUBLE * caps AND low < cap AND cap >= 5 THEN 'name_by_context'
    WHEN NOT is_name THEN 'word'
    WHEN people = 0 AND docs < 100 AND NOT low >= cap AND NOT (docs >= 50 AND courts >= 10 AND marked < 0.01::DOUBLE * caps) THEN 'name'
    WHEN low >= cap OR ((people = 0 OR (docs / (SELECT n FROM total)::DOUBLE) / (people / 100000.0::DOUBLE) >= 100) AND marked / caps::DOUBLE < 0.1::DOUBLE) THEN 'name_as_word'
    WHEN docs >= 60 AND marked / caps::DOUBLE < 0.05::DOUBLE AND low * 10 < cap THEN 'noun_name' ELSE 'name' END AS verdict FROM j),
marks AS (SELECT word, verdict, CASE WHEN verdict = 'noun_name' THEN '^' WHEN verdict = 'name_as_word' AND cap * 10 <= low THEN '~' ELSE '' END AS mark FROM decided)"""
_TITLE_LIST = ", ".join(f"'{t}'" for t in _TITLES)
ORACLE_SQL = {
    "title_reach": f"""WITH o AS (SELECT o_orderkey AS id, [{_TITLE_LIST}][CAST(o_custkey % {len(_TITLES)} AS INT) + 1] AS title, o_orderkey % 60 + 1 AS gap FROM orders),
t AS (SELECT *, CASE title WHEN 'Herrn Dr' THEN NULL WHEN 'Haus' THEN NULL WHEN 'Prof. Dr.' THEN 3 ELSE length(title) END AS size FROM o)
SELECT id, least({v.TITLE_REACH}, gap + CASE title WHEN 'M.' THEN length('Es sagt M.') ELSE length(CASE title WHEN 'Prof. Dr.' THEN title WHEN 'Sig.ra' THEN title WHEN 'Herrn Dr' THEN title ELSE 'sagt ' || title END) END)::BIGINT AS seen,
  coalesce(size + gap <= {v.TITLE_REACH}, false) AS titled FROM t""",
    "word_stats": f"WITH {_STATS} SELECT * FROM stats",
    "name_bearers": """WITH n AS (SELECT lower(replace(c_mktsegment || '-von-' || substr(c_mktsegment, 1, 4), ' ', '-')) AS name, CAST(c_nationkey AS BIGINT) AS b, c_custkey % 2 = 0 AS given FROM customer)
SELECT part, sum(b)::BIGINT AS bearers, sum(CASE WHEN given THEN b ELSE 0 END)::BIGINT AS given FROM (SELECT unnest(regexp_extract_all(name, '\\p{L}{2,}')) AS part, b, given FROM n) WHERE part <> 'von' GROUP BY part""",
    "holdout_split": f"SELECT doc_id AS id, {_HOLD} AS held_out FROM documents",
    "compound_depth0": f"""WITH {_STATS}, lex AS (SELECT word FROM stats WHERE docs >= 20),
s AS (SELECT word, substr(word, 1, CAST(i AS INT)) AS whole, substr(word, CAST(i AS INT) + 1) AS tail FROM (SELECT word, unnest(range(3, length(word) - 3)) AS i FROM stats WHERE length(word) >= 7)),
h AS (SELECT word, tail, link, substr(whole, 1, length(whole) - length(link)) AS head FROM s, (SELECT unnest([{_LINKS}]) AS link) WHERE suffix(whole, link) AND tail IN (SELECT word FROM lex))
SELECT DISTINCT word, head, link, tail FROM h WHERE length(head) >= 3 AND head IN (SELECT word FROM lex)""",
    "language_by_line": f"""WITH l AS (SELECT doc_id AS id, i - 1 AS line, list_filter(regexp_extract_all(lower(ps[i]), '\\p{{L}}+'), lambda x: true) AS ws
  FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents))),
c AS (SELECT id, line, len(list_filter(ws, lambda x: x IN ({", ".join(f"'{x}'" for x in v.GERMAN.split("|"))})))::BIGINT AS de, len(list_filter(ws, lambda x: x IN ({", ".join(f"'{x}'" for x in v.OTHER.split("|"))})))::BIGINT AS other FROM l)
SELECT id, line, de, other, CASE WHEN de + other > 0 THEN de >= other ELSE sum(de) OVER (PARTITION BY id) >= sum(other) OVER (PARTITION BY id) END AS german FROM c""",
    "dehyphenate": """WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([a-z]{4})([a-z]{4})', '\\1-' || chr(10) || '\\2', 'g') || ' see www.example.com/x now' AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, chr(173), '', 'g'), '-[ \\t]*\\r?\\n([a-zäöüéèàç])', '\\1', 'g') AS t FROM a)
SELECT doc_id AS id, md5(regexp_replace(t, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|https?://[^ \\n]+|www[.][^ \\n]+', ' ', 'g')) AS digest FROM b""",
    "unknown_runs": f"""WITH {_STATS}, lex AS (SELECT word FROM stats WHERE docs >= 5),
p AS (SELECT doc_id AS id, i - 1 AS at_, ps[i] AS piece FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') AS ps FROM documents))),
u AS (SELECT id, at_ FROM p WHERE regexp_matches(piece, '^\\p{{Ll}}{{2,}}$') AND piece NOT IN (SELECT word FROM lex)),
m AS (SELECT id, at_, sum(new) OVER (PARTITION BY id ORDER BY at_) AS run FROM (SELECT *, CASE WHEN at_ - lag(at_) OVER (PARTITION BY id ORDER BY at_) = 1 THEN 0 ELSE 1 END AS new FROM u))
SELECT id, CAST(run AS BIGINT) AS run, min(at_)::BIGINT AS first, count(*)::BIGINT AS n FROM m GROUP BY id, run""",
}
#: Words of two or more listed words, the tails cut off one after the other: at the first level, and at three below it.
_COMPOUNDS = f"""WITH RECURSIVE {_STATS.replace('docs AS (', 'docs AS MATERIALIZED (', 1)}, lex AS MATERIALIZED (SELECT word FROM stats WHERE docs >= 20),
names AS (SELECT word FROM stats WHERE length(word) % 3 = 0 AND length(word) >= 6 AND word NOT IN (SELECT word FROM lex)),
rests(word, rest, depth) AS (
  SELECT word, word, 0 FROM names
  UNION SELECT word, substr(whole, 1, length(whole) - length(link)), depth + 1 FROM (
    SELECT word, depth, substr(rest, 1, CAST(i AS INT)) AS whole, substr(rest, CAST(i AS INT) + 1) AS tail, unnest([{_LINKS}]) AS link
    FROM (SELECT *, unnest(range(3, length(rest) - 3)) AS i FROM rests WHERE depth < 4 AND length(rest) >= 7))
  WHERE suffix(whole, link) AND length(whole) - length(link) >= 3 AND tail IN (SELECT word FROM lex))
SELECT DISTINCT word FROM rests WHERE depth > 0 AND rest IN (SELECT word FROM lex)"""
ORACLE_SQL |= {
    "compound_exceptions": _COMPOUNDS,
    "given_name_runs": f"""WITH {_STATS},
a AS (SELECT doc_id AS id, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x NOT IN ({", ".join(f"'{t}'" for t in v.TITLES)})) AS ps FROM documents),
p AS (SELECT id, i - 1 AS at_, ps[i] AS piece, ps[i + 1] AS after FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM a)),
g AS (SELECT * FROM p WHERE regexp_matches(piece, '^\\p{{Lu}}\\p{{L}}+$') AND lower(piece) IN (SELECT name FROM firsts)),
m AS (SELECT *, at_ - row_number() OVER (PARTITION BY id ORDER BY at_) AS run FROM g)
SELECT id, min(at_)::BIGINT AS first, least(count(*), 3)::BIGINT AS n, arg_max(coalesce(after, ''), at_) AS surname FROM m GROUP BY id, run HAVING regexp_matches(arg_max(coalesce(after, ''), at_), '^\\p{{Lu}}\\p{{L}}+$')""",
    "vocabulary_decide": f"{_DECIDE} SELECT word, verdict, mark FROM marks",
    "vocabulary_marks": f"{_DECIDE} SELECT mark || word AS line FROM marks WHERE mark <> ''",
}
