"""Queries over references in running text: tails, places in the raw text, numbers that need context, choices of spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import keys
from lexforge.operators import citelist, finder, places, references, spans, terms
from lexforge.plans import citations, domain
from lexforge.plans.domain import LINES_SQL, REFS_SQL
from lexforge.session import Scratch, table

# Tails as four drafts write them, and what they name: numbers, pages, dates, and what follows behind them all.
_PINS = ((" E. 2.3 und 2.4", "2.3,2.4"), (", CONSID. 3, 4 et 5", "3,4,5"), (" Erwägung 9", "9"), (" cons. 3a-4/bb", "3a,4/bb"))
_PAGES = ((" S. 118", "118"), (", pp. 120 ss.", "120"), (" p. 7", "7"), (", SS. 33 f.", "33"))
_DATES = ((" vom 6. April 2013", "2013-04-06"), (" du 1er mars 2014", "2014-03-01"), (", del 3.5.2015", "2015-05-03"), (" of 7 June 2016", "2016-06-07"))
_ENDS = ("; x", " 2018 f.", " und 4711", ", E.x", ".")
_ORDERS = ("ned", "nde", "end", "edn", "dne", "den", "n", "e", "d", "", "nednd", "eednd")  # n: numbers, e: pages, d: date


def _pick(column, values):
    return F.get(F.array(*map(F.lit, values)), (column % len(values)).cast("int"))


def _tailed(spark, sf):
    o = table(spark, sf, "orders")
    style, order = F.col("o_custkey"), _pick(F.col("o_orderkey"), _ORDERS)
    label = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("4A_"), (F.col("o_custkey") % 900 + 1).cast("string"), F.lit("/2012"))).otherwise(F.concat(F.lit("BGE 140 III "), (F.col("o_custkey") % 900 + 1).cast("string")))
    tail = F.lit("")
    for i in range(1, 6):
        letter = F.substring(order, i, 1)
        tail = F.concat(tail, F.when(letter == "n", _pick(style, [p for p, _ in _PINS])).when(letter == "e", _pick(style, [p for p, _ in _PAGES])).when(letter == "d", _pick(style, [p for p, _ in _DATES])).otherwise(""))
    return o.select(F.col("o_orderkey").alias("paragraph"), F.concat(F.lit("Siehe "), label, tail, _pick(F.col("o_orderkey") + style, _ENDS)).alias("text"))


def qualified_labels(spark, sf):
    """Every order's label with up to five tails in twelve orders and four styles; four of them count."""
    found = finder.find(_tailed(spark, sf))
    return found.select("paragraph", "start", "end", "written", "label", F.array_join("pinpoints", ",").alias("pinpoints"), F.array_join("pages", ",").alias("pages"), "written_date")


def label_chains(spark, sf):
    """Collections written once for several decisions, with a link that ends the chain in every third order."""
    o = table(spark, sf, "orders")
    n = lambda c, k: (F.col(c) % 900 + k).cast("string")
    broken = F.when(F.col("o_orderkey") % 3 == 0, " x ").otherwise(" und ")
    text = F.concat(F.lit("BGE 140 III "), n("o_orderkey", 1), F.lit(" E. 2; 141 II "), n("o_custkey", 1), F.lit(" consid. 3"), broken, F.lit("142 I "), n("o_orderkey", 2), F.lit(", 143 V "), n("o_custkey", 2), F.lit(" S. 9"))
    found = finder.find(o.select(F.col("o_orderkey").alias("paragraph"), text.alias("text")))
    return found.select("paragraph", "start", "written", "key", F.array_join("pinpoints", ",").alias("pinpoints"))


_BEFORE = ("", "Zu\u0308rich, Gene\u0300ve:   ", "a  b   c\ta\u0301 ")
_BETWEEN = "   Beschwerdefu\u0308hrer,  "
_GAPS = ("/", " /", "/ ", "  /  ")


def _raw(spark, sf):
    """Labels behind decomposed letters and runs of spaces, some with spaces around the slash, two to a text."""
    o = table(spark, sf, "orders")
    before, gap = _pick(F.col("o_custkey"), _BEFORE), _pick(F.col("o_orderkey"), _GAPS)
    year = F.year("o_orderdate").cast("string")
    text = F.concat(before, F.lit("4A_"), (F.col("o_orderkey") % 1000).cast("string"), gap, year, F.lit(f"{_BETWEEN}1B_"), (F.col("o_custkey") % 1000).cast("string"), gap, year, F.lit("  E. 2.1"))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"))


def raw_spans(spark, sf):
    """The raw letters of references found in normalised texts."""
    docs = _raw(spark, sf)
    found = finder.find(docs.withColumnRenamed("id", "paragraph")).select(F.col("paragraph").alias("id"), "start", "end", "written")
    return places.cut(docs, found).join(found.hint("merge"), ["id", "start", "end"]).select("id", "start", "end", "letters", "written")


def replaced_in_raw(spark, sf):
    """References replaced in the raw text where it still reads so; every fifth text has changed in between."""
    docs = _raw(spark, sf)
    found = finder.find(docs.withColumnRenamed("id", "paragraph")).select(F.col("paragraph").alias("id"), "start", "end")
    shown = places.cut(docs, found).select("id", "start", "end", F.col("letters").alias("written"), F.lit("[…]").alias("label"))
    now = docs.withColumn("text", F.when(F.col("id") % 5 == 0, F.replace("text", F.lit("4A_"), F.lit("4B_"))).otherwise(F.col("text")))
    return spans.replace_shown(now, shown)


def _mixed(spark, sf):
    """Ticino numbers with and without a court close before, application numbers, and a label whose number looks like one."""
    o = table(spark, sf, "orders")
    lead = _pick(F.col("o_orderkey"), ("sentenza ", "Tribunale d'appello, inc. n.5 ", "Il testo ", "La Pretura decide. Testo ", f"Camera {'x' * 70} ", "decisione; "))
    number = F.concat((F.col("o_custkey") % 80 + 10).cast("string"), F.lit("."), F.year("o_orderdate").cast("string"), F.lit("."), (F.col("o_orderkey") % 500 + 1).cast("string"))
    court = _pick(F.col("o_custkey"), ("EGMR Nr. ", "Cour EDH, no ", "Nr. ", "EGMR; Nr. "))
    application = F.concat((F.col("o_orderkey") % 3000 + 1).cast("string"), F.lit("/"), F.lpad((F.col("o_custkey") % 30).cast("string"), 2, "0"))
    text = F.concat(lead, number, F.lit(" e 4A_"), (F.col("o_orderkey") % 99 + 1).cast("string"), F.lit("/2012 cons. 3. "), court, application)
    return o.select(F.col("o_orderkey").alias("paragraph"), text.alias("text"), number.alias("number"), application.alias("application"))


def _lists(spark, sf):
    """What is listed: part of the numbers, at Ticino courts, at the human-rights court, joined, or elsewhere."""
    m = _mixed(spark, sf)
    ti = m.where("paragraph % 4 < 2").select(F.col("number").alias("key"), F.when(F.col("paragraph") % 4 == 0, "ti_tca").otherwise("zh_og").alias("court"))
    kind = F.col("paragraph") % 7
    echr = m.where(kind < 4).select(F.when(kind == 1, F.concat("application", F.lit("_1/99"))).otherwise(F.col("application")).alias("key"), F.when(kind == 2, "zh_og").when(kind == 3, "ecthr_grand_chamber").otherwise("hudoc_ch").alias("court"))
    return ti.unionByName(echr).distinct()


def document_findings(spark, sf):
    """References, Ticino numbers and application numbers as one list."""
    m = Scratch(spark).cut(_mixed(spark, sf), "texts")
    found = finder.find(m).select("paragraph", "start", "end", "label", F.lit("reference").alias("status"), F.lit(None).cast("string").alias("note"))
    return finder.document_findings(m, found, _lists(spark, sf))


def _overlapping(spark, sf):
    """Spans of several widths in every order's lines, one to seven a text, some equal, many of them overlapping."""
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    start, width = (F.col("l_partkey") % 40).cast("int"), (F.col("l_suppkey") % 13).cast("int") + F.when(F.col("l_partkey") % 9 == 0, 30).otherwise(0)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), start.alias("start"), (start + width).alias("end"), row.alias("row")).groupBy("row").agg(F.min("id").alias("id"), F.min(F.struct("start", "end")).alias("s")).select("id", "s.start", "s.end", "row")


def widest_spans(spark, sf):
    return spans.widest_first(_overlapping(spark, sf)).select("id", "start", "end", "row")


def earliest_spans(spark, sf):
    return spans.earliest_first(_overlapping(spark, sf).where("end > start")).select("id", "start", "end").distinct()


def free_spans(spark, sf):
    """Spans of even rows that share no place with a span of an odd row."""
    rows = _overlapping(spark, sf).where("end > start")
    return spans.free(rows.where("row % 2 = 0"), rows.where("row % 2 = 1")).select("id", "start", "end", "row")


def finding_pages(spark, sf):
    """Status of references to the collection with pages: inside, behind the last, before the first, or no end known."""
    lines = Scratch(spark).cut(citations._lines(spark, sf).where("key LIKE 'BGE%'"), "lines")
    at = keys.split_collection_key(F.col("key"))
    away = F.length("id") * 40 - 180
    refs = lines.select(F.col("id").alias("ref_id"), "key", F.array(at["page"] + away, at["page"] + 1).alias("pages"))
    found = references.page_status(refs.groupBy("ref_id").agg(F.min(F.struct("key", "pages")).alias("r")).select("ref_id", "r.key", "r.pages"), citelist.page_ranges(lines))
    return found.select("ref_id", "key", "status", F.array_join("outside", ",").alias("outside"), "first", "last")


def date_suggestions(spark, sf):
    """For labels of which no date fits: lines of the written date one typing error away."""
    refs, rows = citations._cut(spark, sf)
    wrong = references.date_issues(refs, rows).select("ref_id").distinct()
    asked = Scratch(spark).cut(refs.where("key NOT LIKE 'BGE%'").join(wrong, "ref_id", "left_semi"), "asked")
    return citelist.date_suggestions(asked, rows)


def occurrences(spark, sf):
    """References of an order as one document: which of how many of their label."""
    r = references.parsed(domain.references(spark, sf))
    rows = r.select((F.col("ref_id") / 10).cast("long").alias("document"), (F.col("ref_id") % 10).alias("paragraph"), F.lit(0).alias("start"), "label")
    return finder.occurrence(rows).select("document", "paragraph", "label", "nth", "total")


def snippets(spark, sf):
    """Context and snippet of the middle word of every text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.translate(F.coalesce("text", F.lit("")), "\n\t\r", "   ").alias("text"))
    middle = (F.length("text") / 2).cast("int")
    at = docs.withColumn("start", middle).withColumn("end", F.least(middle + 5, F.length("text")))
    around = finder.context(F.col("text"), F.col("start"), F.col("end"))
    return at.select("id", around["before"].alias("before"), around["after"].alias("after"), finder.snippet(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


#: Terms of one to five words as a user enters them, and the ways a text has them.
_TERMS = (
    ("St. Gallen", ("St. Gallen", "st.gallen", "ST.  GALLEN", "St.-Gallen")), ("Müller-Meier", ("Müller Meier", "mu\u0308ller-meier", "MÜLLER\u00a0MEIER", "Müller‑Meier")),
    ("Haus zum Roten Hirschen AG", ("Haus zum Roten Hirschen AG", "haus-zum-roten-hirschen ag", "HAUS ZUM ROTEN HIRSCHEN AG", "Haus  zum Roten Hirschen AG")), ("E-Mail", ("E-Mail", "e mail", "E‑MAIL", "E - Mail")),
    ("Roten", ("Roten", "roten", "ROTEN", "Roten")), ("A.B.", ("A.B.", "a. b.", "A.-B.", "A. B.")), ("(x)", ("(x)", "(X)", "(x)", "(x)")), ("Hirsch", ("Hirsch", "hirsch", "HIRSCH", "Hirsch")),
)
_NONE = ("Hirschen", "xHirsch", "Müllermeier", "St Gallen", "E_Mail", "Rotens")


def _own_terms(spark):
    return spark.createDataFrame([(k, t) for k, (t, _) in enumerate(_TERMS)], "term_id long, term string")


def _term_texts(spark, sf):
    """Two terms in one of four ways each, between words that only look like terms."""
    o = table(spark, sf, "orders")
    way = (F.col("o_orderkey") % 4).cast("int")
    pick = lambda c: _pick(c * 4 + way, [v for _, ways in _TERMS for v in ways])
    one, two = F.col("o_orderkey") % len(_TERMS), F.col("o_custkey") % len(_TERMS)
    other = _pick(F.col("o_custkey") + F.col("o_orderkey"), _NONE)
    return o.select(F.col("o_orderkey").alias("id"), F.concat(other, F.lit(": "), pick(one), F.lit(", dann "), other, F.lit("; "), pick(two), F.lit("! "), other).alias("text"))


def user_terms(spark, sf):
    """Every place of a user's terms, overlapping ones included."""
    return terms.find_terms(_term_texts(spark, sf), _own_terms(spark)).select("id", "term_id", "start", "end")


def user_terms_chosen(spark, sf):
    """A user's places against shown ones: half of them at the same place, others wider."""
    texts = _term_texts(spark, sf)
    own = Scratch(spark).cut(terms.find_terms(texts, _own_terms(spark)), "own")  # found once, read twice
    shown = own.where("term_id IN (0, 1, 4)").select("id", "start", (F.col("end") + F.when(F.col("id") % 2 == 0, 0).otherwise(3)).alias("end"), (F.col("term_id") + 100).alias("row"))
    return terms.choose(own, shown).select("id", "start", "end", "source", "row")


QUERIES = {f.__name__: f for f in (qualified_labels, label_chains, raw_spans, replaced_in_raw, document_findings, widest_spans, earliest_spans, free_spans, finding_pages, date_suggestions, occurrences, snippets, user_terms, user_terms_chosen)}


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _at(values, index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INT) + 1]"


_TAILED = f"""o AS (SELECT o_orderkey AS paragraph, o_custkey AS c, {_at(_ORDERS, "o_orderkey")} AS ord,
  CASE WHEN o_orderkey % 2 = 0 THEN '4A_' || (o_custkey % 900 + 1) || '/2012' ELSE 'BGE 140 III ' || (o_custkey % 900 + 1) END AS label FROM orders),
t AS (SELECT *, {_at([p for p, _ in _PINS], "c")} AS n, {_at([p for p, _ in _PAGES], "c")} AS e, {_at([p for p, _ in _DATES], "c")} AS d, substr(ord, 1, 4) AS taken FROM o),
w AS (SELECT *, label || list_aggregate(list_transform(range(1, 5), lambda i: CASE substr(taken, CAST(i AS INT), 1) WHEN 'n' THEN n WHEN 'e' THEN e WHEN 'd' THEN d ELSE '' END), 'string_agg', '') AS written FROM t)"""
_OVER = """s AS (SELECT row, min(id) AS id, min({'a': a, 'b': b}) AS s FROM (SELECT l_orderkey * 10 + l_linenumber AS row, l_orderkey AS id, CAST(l_partkey % 40 AS INT) AS a,
  CAST(l_partkey % 40 + l_suppkey % 13 + CASE WHEN l_partkey % 9 = 0 THEN 30 ELSE 0 END AS INT) AS b FROM lineitem) GROUP BY row),
r AS (SELECT row, id, s.a AS start, s.b AS stop FROM s WHERE s.b > s.a)"""
_GREEDY = """ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS k FROM {source}),
chosen AS (
  SELECT id, 0::BIGINT AS k, []::STRUCT(a INT, b INT)[] AS kept, NULL::INT AS start, NULL::INT AS stop, NULL::BIGINT AS row, false AS good FROM (SELECT DISTINCT id FROM ranked)
  UNION ALL
  SELECT n.id, n.k, CASE WHEN ok THEN list_append(kept, {{'a': n.start, 'b': n.stop}}) ELSE kept END, n.start, n.stop, n.row, ok
  FROM (SELECT r.*, c.kept, len(list_filter(c.kept, lambda x: x.a < r.stop AND r.start < x.b)) = 0 AS ok FROM chosen c JOIN ranked r ON r.id = c.id AND r.k = c.k + 1) n)"""
_RAW = f"""o AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, {_at(_BEFORE, "o_custkey")} AS b, CAST([{", ".join(str(len(b)) for b in _BEFORE)}][CAST(o_custkey % {len(_BEFORE)} AS INT) + 1] AS INT) AS nb,
  {_at(_GAPS, "o_orderkey")} AS g, '4A_' || (o_orderkey % 1000) AS one, '1B_' || (o_custkey % 1000) AS two FROM orders),
p AS (SELECT *, one || g || y AS raw1, two || g || y || '  E. 2.1' AS raw2, nb AS at1, CAST(nb + length(one || g || y) + {len(_BETWEEN)} AS INT) AS at2 FROM o)"""
_MIXED = f"""m AS (SELECT o_orderkey AS paragraph, o_orderkey % 6 AS lead, {_at(("sentenza ", "Tribunale d'appello, inc. n.5 ", "Il testo ", "La Pretura decide. Testo ", f"Camera {'x' * 70} ", "decisione; "), "o_orderkey")} AS head,
  (o_custkey % 80 + 10) || '.' || year(o_orderdate) || '.' || (o_orderkey % 500 + 1) AS number, '4A_' || (o_orderkey % 99 + 1) || '/2012' AS label,
  o_custkey % 4 AS court, {_at(("EGMR Nr. ", "Cour EDH, no ", "Nr. ", "EGMR; Nr. "), "o_custkey")} AS named, (o_orderkey % 3000 + 1) || '/' || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') AS application FROM orders),
ti AS (SELECT DISTINCT number FROM m WHERE paragraph % 4 = 0),
le AS (SELECT DISTINCT CASE WHEN paragraph % 7 = 1 THEN application || '_1/99' ELSE application END AS key, CASE paragraph % 7 WHEN 2 THEN 'zh_og' ELSE 'echr' END AS court FROM m WHERE paragraph % 7 < 4),
ow AS (SELECT key, max(court = 'echr') AS ours FROM le GROUP BY key),
jo AS (SELECT DISTINCT split_part(key, '_', 1) AS key FROM le WHERE contains(key, '_')),
x AS (SELECT *, CAST(length(head) AS INT) AS a1, CAST(length(head) + length(number) + 3 AS INT) AS a2, CAST(length(head) + length(number) + 3 + length(label) + 10 + length(named) AS INT) AS a3 FROM m)"""

ORACLE_SQL = {
    "qualified_labels": f"""WITH {_TAILED}
SELECT paragraph, 6 AS start, CAST(6 + length(written) AS INT) AS "end", written, label,
  CASE WHEN contains(taken, 'n') THEN {_at([v for _, v in _PINS], "c")} ELSE '' END AS pinpoints,
  coalesce(array_to_string(list_filter(list_transform(range(1, 5), lambda i: CASE WHEN substr(taken, CAST(i AS INT), 1) = 'e' THEN {_at([v for _, v in _PAGES], "c")} END), lambda x: x IS NOT NULL), ','), '') AS pages,
  CASE WHEN contains(taken, 'd') THEN {_at([v for _, v in _DATES], "c")} END AS written_date FROM w""",
    "label_chains": """WITH o AS (SELECT o_orderkey AS paragraph, o_orderkey % 900 AS a, o_custkey % 900 AS b, o_orderkey % 3 = 0 AS broken FROM orders),
w AS (SELECT *, 'BGE 140 III ' || (a + 1) || ' E. 2' AS w1, '141 II ' || (b + 1) || ' consid. 3' AS w2, '142 I ' || (a + 2) AS w3, '143 V ' || (b + 2) || ' S. 9' AS w4 FROM o)
SELECT paragraph, 0 AS start, w1 AS written, 'BGE 140 III ' || lpad(CAST(a + 1 AS VARCHAR), 4, '0') AS key, '2' AS pinpoints FROM w
UNION ALL SELECT paragraph, CAST(length(w1) + 2 AS INT), w2, 'BGE 141 II ' || lpad(CAST(b + 1 AS VARCHAR), 4, '0'), '3' FROM w
UNION ALL SELECT paragraph, CAST(length(w1) + 2 + length(w2) + 5 AS INT), w3, 'BGE 142 I ' || lpad(CAST(a + 2 AS VARCHAR), 4, '0'), '' FROM w WHERE NOT broken
UNION ALL SELECT paragraph, CAST(length(w1) + 2 + length(w2) + 5 + length(w3) + 2 AS INT), w4, 'BGE 143 V ' || lpad(CAST(b + 2 AS VARCHAR), 4, '0'), '' FROM w WHERE NOT broken""",
    "raw_spans": f"""WITH {_RAW}
SELECT id, at1 AS start, CAST(at1 + length(raw1) AS INT) AS "end", raw1 AS letters, one || '/' || y AS written FROM p
UNION ALL SELECT id, at2, CAST(at2 + length(raw2) AS INT), raw2, two || '/' || y || ' E. 2.1' FROM p""",
    "replaced_in_raw": f"""WITH {_RAW}
SELECT id, b || CASE WHEN id % 5 = 0 THEN replace(raw1, '4A_', '4B_') ELSE '[…]' END || '{_BETWEEN}[…]' AS text,
  CASE WHEN id % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS applied, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS skipped FROM p""",
    "document_findings": f"""WITH {_MIXED}
SELECT paragraph, a2 AS start, CAST(a2 + length(label || ' cons. 3') AS INT) AS "end", label, 'reference' AS status, NULL AS note FROM x
UNION ALL SELECT paragraph, a1, CAST(a1 + length(number) AS INT), number, CASE WHEN number IN (SELECT number FROM ti) THEN 'found' ELSE 'unchecked' END, CASE WHEN number NOT IN (SELECT number FROM ti) THEN 'unknown_shape' END
  FROM x WHERE lead < 2 OR number IN (SELECT number FROM ti)
UNION ALL SELECT paragraph, a3, CAST(a3 + length(application) AS INT), application, CASE WHEN ow.ours OR jo.key IS NOT NULL THEN 'found' ELSE 'unchecked' END, CASE WHEN ow.ours OR jo.key IS NOT NULL THEN NULL ELSE 'echr_not_listed' END
  FROM x LEFT JOIN ow ON ow.key = application LEFT JOIN jo ON jo.key = application WHERE court < 2 AND coalesce(ow.ours, true)""",
    "widest_spans": f"""WITH RECURSIVE {_OVER}, {_GREEDY.format(order="stop - start DESC, row, start", source="r")} SELECT id, start, stop AS "end", row FROM chosen WHERE good""",
    "earliest_spans": f"""WITH RECURSIVE {_OVER}, d AS (SELECT DISTINCT id, start, stop, 0::BIGINT AS row FROM r), {_GREEDY.format(order="start, stop DESC", source="d")} SELECT id, start, stop AS "end" FROM chosen WHERE good""",
    "free_spans": f"""WITH {_OVER} SELECT id, start, stop AS "end", row FROM r WHERE row % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r t WHERE t.row % 2 = 1 AND t.id = r.id AND t.start < r.stop AND r.start < t.stop)""",
    "finding_pages": f"""WITH {LINES_SQL}, {citations._RANGES},
f AS (SELECT id AS ref_id, min(key) AS key FROM lines WHERE key LIKE 'BGE%' GROUP BY id),
p AS (SELECT ref_id, r.key, r.first, r.last, [r.first + length(ref_id) * 40 - 180, r.first + 1] AS pages FROM f JOIN ranges r ON r.key = f.key),
q AS (SELECT *, list_filter(pages, lambda x: x < first OR (last IS NOT NULL AND x > last)) AS outside FROM p)
SELECT ref_id, key, CASE WHEN len(outside) > 0 THEN 'page' WHEN last IS NOT NULL THEN 'page_inside' ELSE 'open' END AS status, array_to_string(outside, ',') AS outside, first, last FROM q""",
    "date_suggestions": f"""WITH {LINES_SQL}, {REFS_SQL}, {citations._CHECK},
wrong AS (SELECT DISTINCT ref_id, key, met.written_date, named FROM met JOIN judged USING (ref_id, key) WHERE bad_date AND scoped AND key NOT LIKE 'BGE%'),
near AS (SELECT DISTINCT w.key, w.written_date, l.key AS variant FROM (SELECT DISTINCT key, written_date FROM wrong) w JOIN (SELECT DISTINCT key, date FROM lines WHERE key NOT LIKE 'BGE%') l
  ON l.date = w.written_date AND abs(length(w.key) - length(l.key)) <= 1 AND damerau_levenshtein(w.key, l.key) = 1 AND regexp_replace(w.key, '[0-9]', '', 'g') = regexp_replace(l.key, '[0-9]', '', 'g')),
letter AS (SELECT DISTINCT w.key, w.written_date, l.key AS variant FROM (SELECT DISTINCT key, written_date FROM wrong) w JOIN (SELECT DISTINCT key, date FROM lines WHERE key NOT LIKE 'BGE%') l
  ON l.date = w.written_date AND length(w.key) = length(l.key) AND damerau_levenshtein(w.key, l.key) = 1 AND regexp_replace(w.key, '[A-Z]', '', 'g') = regexp_replace(l.key, '[A-Z]', '', 'g')),
ranked AS (SELECT w.ref_id, l.key, l.court, l.date, row_number() OVER (PARTITION BY w.ref_id ORDER BY NOT (w.named IS NULL OR w.named = l.court), l.key, l.court, l.canton) AS rank
  FROM wrong w JOIN (SELECT * FROM near UNION SELECT * FROM letter) n ON n.key = w.key AND n.written_date = w.written_date JOIN lines l ON l.key = n.variant AND l.date = w.written_date)
SELECT ref_id, rank, key, court, date FROM ranked WHERE rank <= 3""",
    "occurrences": f"""WITH {REFS_SQL}, r AS (SELECT ref_id // 10 AS document, ref_id % 10 AS paragraph, label FROM parsed)
SELECT document, paragraph, label, row_number() OVER (PARTITION BY document, label ORDER BY paragraph) - 1 AS nth, count(*) OVER (PARTITION BY document, label) AS total FROM r""",
    "snippets": r"""WITH d AS (SELECT doc_id AS id, translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   ') AS t FROM documents),
m AS (SELECT *, CAST(length(t) // 2 AS INT) AS s, CAST(least(length(t) // 2 + 5, length(t)) AS INT) AS e FROM d)
SELECT id, substr(t, greatest(s - 48, 0) + 1, s - greatest(s - 48, 0)) AS before, substr(t, e + 1, 48) AS after,
  CASE WHEN s > 60 THEN '…' || regexp_replace(substr(t, s - 59, 60), '^\S*\s', '') ELSE substr(t, 1, s) END || substr(t, s + 1, e - s)
  || CASE WHEN e + 60 < length(t) THEN regexp_replace(substr(t, e + 1, 60), '\s\S*$', '') || '…' ELSE substr(t, e + 1, 60) END AS snippet FROM m""",
}

_WAYS = [v for _, ways in _TERMS for v in ways]
#: Where the terms stand in the texts; "Roten" also inside the longest one, at its third word.
_TERM_PLACES = f"""o AS (SELECT o_orderkey AS id, o_orderkey % {len(_TERMS)} AS t1, o_custkey % {len(_TERMS)} AS t2, {_at(_WAYS, f"(o_orderkey % {len(_TERMS)}) * 4 + o_orderkey % 4")} AS v1,
  {_at(_WAYS, f"(o_custkey % {len(_TERMS)}) * 4 + o_orderkey % 4")} AS v2, {_at(_NONE, "o_custkey + o_orderkey")} AS other FROM orders),
p AS (SELECT id, t1 AS term_id, length(other) + 2 AS start, v1 AS v FROM o UNION ALL SELECT id, t2, 2 * length(other) + 2 + length(v1) + 7 + 2, v2 FROM o),
h AS (SELECT id, term_id, CAST(start AS INT) AS start, CAST(start + length(v) AS INT) AS stop FROM p
  UNION ALL SELECT id, 4, CAST(start + strpos(lower(v), 'roten') - 1 AS INT), CAST(start + strpos(lower(v), 'roten') + 4 AS INT) FROM p WHERE term_id = 2)"""
ORACLE_SQL |= {
    "user_terms": f"""WITH {_TERM_PLACES} SELECT id, CAST(term_id AS BIGINT) AS term_id, start, stop AS "end" FROM h""",
    "user_terms_chosen": f"""WITH {_TERM_PLACES},
b AS (SELECT id, start, stop, 0 AS source, CAST(term_id AS BIGINT) AS row FROM h UNION ALL SELECT id, start, CAST(stop + CASE WHEN id % 2 = 0 THEN 0 ELSE 3 END AS INT), 1, CAST(term_id + 100 AS BIGINT) FROM h WHERE term_id IN (0, 1, 4)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stop - start DESC, source, row, start) AS nr FROM b)
SELECT id, start, stop AS "end", source, row FROM k WHERE NOT EXISTS (SELECT 1 FROM k w WHERE w.id = k.id AND w.nr < k.nr AND w.start < k.stop AND k.start < w.stop)""",
}
