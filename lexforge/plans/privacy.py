"""Queries over identifiers, masked names, people, pages and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import anonymize, evaluation, identifiers
from lexforge.session import table
from lexforge.sources import docx


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.coalesce("text", F.lit("")).alias("text"))


def _mails(spark, sf):
    """Mail addresses with the number of their occurrence as position."""
    found = F.regexp_extract_all("text", F.lit(identifiers.MAIL), F.lit(0))
    return _docs(spark, sf).select("id", "lang", F.posexplode(found).alias("start", "value")).withColumn("label", F.lit("mail"))


def _masked(spark, sf):
    """Conversations with every other capitalised word of five letters or more masked."""
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"(^|[ \n])([A-Z])[a-z]{4,}", "$1$2.____").alias("text"))


def placeholders(spark, sf):
    return identifiers.placeholders(_masked(spark, sf))


def anonymized_documents(spark, sf):
    """Documents that count as anonymous: three masked names, or five initials."""
    counts = identifiers.placeholders(_masked(spark, sf)).groupBy("id").agg(F.sum("n").alias("n"))
    rows = _masked(spark, sf).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("masked"), F.regexp_count("text", F.lit(identifiers.INITIAL)).cast("long").alias("initials"))
    return rows.where("masked >= 3 OR initials >= 5")


def identifier_scan(spark, sf):
    return identifiers.identifiers(_docs(spark, sf))


def ahv_valid(spark, sf):
    number = F.concat(F.lit("756."), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", number.alias("number")).withColumn("valid", identifiers.social_insurance_valid(F.col("number")))


def iban_valid(spark, sf):
    number = F.concat(F.lit("CH"), F.lpad((F.col("o_orderkey") % 98).cast("string"), 2, "0"), F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return table(spark, sf, "orders").select("o_orderkey", number.alias("iban")).withColumn("valid", identifiers.iban_valid(F.col("iban")))


def code_shapes(spark, sf):
    found = _docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(identifiers.CODE), F.lit(0))).alias("code"))
    return found.groupBy(identifiers.code_shape(F.col("code")).alias("shape")).agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"))


def entries(spark, sf):
    return identifiers.entries(_mails(spark, sf)).select("id", "key", "text", F.array_join("forms", ",").alias("forms"), "n", F.col("first").cast("long").alias("first"))


def label_assignment(spark, sf):
    found = identifiers.entries(_mails(spark, sf)).select("id", "key", "first")
    used = _docs(spark, sf).where("id % 2 = 0").select("id", F.explode(F.array(F.lit("A"), F.lit("C"))).alias("label"))
    return identifiers.assign_labels(found, used)


def redact_text(spark, sf):
    docs = _docs(spark, sf)
    places = docs.select("id", F.instr("text", "token = ").alias("at")).where("at > 0").select("id", (F.col("at") - 1).alias("start"), (F.col("at") + 7).alias("end"), F.lit("[…] ").alias("label"))
    return identifiers.redact(docs, places).select("id", F.md5("text").alias("digest"))


def verify_copy(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("index"), F.coalesce("text", F.lit("")).alias("text"))
    copy = c.where("file % 50 <> 7").select("file", "index", F.regexp_replace("text", r" [A-Z][a-z]{8,} ", " X.____ ").alias("text"))
    return identifiers.verify_copy(c, copy).select("file", "index", F.md5("expected").alias("expected"), F.md5("actual").alias("actual"))


def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(identifiers.html_text(F.col("html"))).alias("digest"))


def _files(spark, sf):
    """Each conversation as a word-processor file, a paragraph for each turn."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return docx.files_of(c.select(F.col("conv_id").cast("string").alias("path"), F.transform("t", lambda x: x["text"]).alias("texts")))


def docx_parts(spark, sf):
    found = docx.parts(_files(spark, sf)).where("part = 'body'")
    return found.select(F.col("path").cast("long").alias("conv_id"), F.col("index").cast("long").alias("index"), F.md5("text").alias("digest"))


def docx_copy(spark, sf):
    """The first five characters of every paragraph masked in a copy, and the copy read again."""
    files = _files(spark, sf)
    places = docx.parts(files).where("part = 'body' AND length(text) >= 5").select("path", "file", "index", F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("X.____").alias("label"))
    found = docx.parts(docx.copies(files, places)).where("part = 'body'")
    return found.select(F.col("path").cast("long").alias("conv_id"), F.col("index").cast("long").alias("index"), F.md5("text").alias("digest"))


def anonymization_check(spark, sf):
    """Conversations checked against the words of five or more documents."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)))).alias("word"))
    common = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    lexicon = common.select("word", F.lit("").alias("mark"))
    parts = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.lit("body").alias("kind"), F.col("turn").alias("index"), "text")
    return anonymize.check_with(parts, lexicon)


def people(spark, sf):
    """People of each conversation: runs of capitalised words in its turns."""
    c = table(spark, sf, "conversations")
    found = c.select(F.col("conv_id").alias("id"), "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})?\b"), F.lit(0))).alias("n", "name"))
    return identifiers.people(found.select("id", (F.col("turn") * 10000 + F.col("n")).alias("start"), "name", F.lit(None).cast("string").alias("initial")))


def list_length_quantiles(spark, sf):
    counts = _mails(spark, sf).groupBy("id").agg(F.count("*").alias("n"))
    per = _docs(spark, sf).select("id", "lang").join(counts, "id", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))
    return evaluation.lengths(per)


def recall_by_form(spark, sf):
    trials = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("form"), F.col("l_linestatus").alias("mode"), (F.col("l_quantity") > 10).alias("hit"))
    return evaluation.hit_rates(trials)


def _spans(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    start = F.col("l_partkey") % 900
    return l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("mention"), start.alias("start"), (start + 5 + F.col("l_partkey") % 7).alias("end")).distinct()


def mention_caught(spark, sf):
    spans = _spans(spark, sf)
    shown = spans.where("mention % 2 = 1").select("doc", (F.col("start") + 3).alias("start"), (F.col("end") + 60).alias("end"))
    return evaluation.caught(spans, shown)


def entity_recall(spark, sf):
    l = table(spark, sf, "lineitem")
    mentions = l.select((F.col("l_suppkey") % 3).alias("annotator"), F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 4).alias("entity"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("type"), (F.col("l_quantity") > 5).alias("caught"))
    return evaluation.entity_recall(mentions)


def stratified_sample(spark, sf):
    return evaluation.stratified(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5)


def name_forms(spark, sf):
    n = table(spark, sf, "nation").select(F.initcap(F.lower("n_name")).alias("last"), F.concat(F.lit("Zoë"), F.col("n_nationkey").cast("string")).alias("first"))
    return evaluation.forms(n)


def _turns_once(spark, sf):
    return _masked(spark, sf).groupBy("id").agg(F.min("text").alias("text"))


def mask_positions(spark, sf):
    return evaluation.mask_positions(_turns_once(spark, sf), head=40, tail=20)


def synthetic_identifiers(spark, sf):
    return evaluation.identifier_cases(table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


def identifier_recall(spark, sf):
    """Made-up identifiers behind the first mask of each turn, and how many a scan shows."""
    docs = _turns_once(spark, sf)
    return evaluation.identifier_recall(docs, evaluation.mask_positions(docs, head=-1, tail=0).where("nth = 0"))


QUERIES = {f.__name__: f for f in (placeholders, anonymized_documents, identifier_scan, ahv_valid, iban_valid, code_shapes, entries, label_assignment, redact_text, verify_copy, html_text, docx_parts, docx_copy, anonymization_check, people, list_length_quantiles, recall_by_form, mention_caught, entity_recall, stratified_sample, name_forms, mask_positions, synthetic_identifiers, identifier_recall)}

_MAILS = r"mails AS (SELECT id, lang, i - 1 AS start, ms[i] AS value FROM (SELECT doc_id AS id, lang, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS ms FROM documents)))"
_ENTRIES = r"""forms AS (SELECT id, 'i:mail:' || lower(regexp_replace(value, '[^\p{L}\p{N}]', '', 'g')) AS key, value, count(*) AS n, min(start) AS first FROM mails GROUP BY ALL),
entries AS (SELECT id, key, arg_max(value, (n, -first)) AS text, string_agg(value, ',' ORDER BY value) AS forms, sum(n)::BIGINT AS n, min(first)::BIGINT AS first FROM forms GROUP BY id, key)"""
_MASKED = r"masked AS (SELECT conv_id * 100 + turn AS id, regexp_replace(coalesce(text, ''), '(^|[ \n])([A-Z])[a-z]{4,}', '\1\2.____', 'g') AS text FROM conversations)"
_HOLDERS = r"holders AS (SELECT id, regexp_replace(form, '_{2,}', '________', 'g') AS form, count(*)::BIGINT AS n FROM (SELECT id, unnest(regexp_extract_all(text, '\b[A-Z]{1,3}\.?_{2,}|\[(?:\.\.\.|…)\]|\bX{3,}\b|\*{3,}')) AS form FROM masked) GROUP BY ALL)"
_SPANS = "spans AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS mention, l_partkey % 900 AS s, l_partkey % 900 + 5 + l_partkey % 7 AS e FROM lineitem)"
_SHAPE = r"""CASE WHEN regexp_matches(c, '^([0-9]{1,2}\.[0-9]{1,2}\.([0-9]{2}|[0-9]{4})|[0-9]{4}-[0-9]{2}-[0-9]{2})$') THEN 'date'
  WHEN regexp_matches(c, '^[0-9]{1,3}(''[0-9]{3})+(\.[0-9]{2})?$|^[0-9]+\.[0-9]{2}$') THEN 'amount' WHEN regexp_matches(c, '^[0-9]{1,3}(\.[0-9]{1,3})+[a-z]?\.?$') THEN 'section'
  WHEN regexp_matches(c, '^[0-9]{1,4}-[0-9]{1,4}$') THEN 'span' WHEN regexp_matches(c, '^[0-9]{1,6}(/[0-9]{1,6})+$|^[A-Za-z]+[0-9]*([._/-][A-Za-z0-9]+)+$') THEN 'reference'
  WHEN length(regexp_replace(c, '[^0-9]', '', 'g')) <= 4 THEN 'short' ELSE 'other' END"""
ORACLE_SQL = {
    "placeholders": f"WITH {_MASKED}, {_HOLDERS} SELECT id, form, n FROM holders",
    "anonymized_documents": f"""WITH {_MASKED}, {_HOLDERS}, c AS (SELECT id, sum(n)::BIGINT AS n FROM holders GROUP BY id),
r AS (SELECT m.id, coalesce(c.n, 0)::BIGINT AS masked, len(regexp_extract_all(m.text, '(?:^|[ (\\n])[A-Z]\\.(?:[A-Z]\\.)?[ ,;)]'))::BIGINT AS initials FROM masked m LEFT JOIN c ON c.id = m.id)
SELECT id, masked, initials FROM r WHERE masked >= 3 OR initials >= 5""",
    "ahv_valid": """WITH n AS (SELECT o_orderkey, '756.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') AS number FROM orders),
d AS (SELECT *, replace(number, '.', '') AS d FROM n)
SELECT o_orderkey, number, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(d, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(substr(d, 13, 1) AS INT) AS valid FROM d""",
    "iban_valid": """WITH n AS (SELECT o_orderkey, 'CH' || lpad(CAST(o_orderkey % 98 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey AS VARCHAR), 5, '0') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS iban FROM orders)
SELECT o_orderkey, iban, CAST(substr(iban, 5) || '1217' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM n""",
    "code_shapes": f"""WITH c AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z./''\\-]*[0-9][0-9A-Za-z./''\\-]*')) AS c FROM documents)
SELECT {_SHAPE} AS shape, count(*)::BIGINT AS n, count(DISTINCT c)::BIGINT AS codes FROM c GROUP BY 1""",
    "entries": f"WITH {_MAILS}, {_ENTRIES} SELECT id, key, text, forms, n, first FROM entries",
    "label_assignment": f"""WITH {_MAILS}, {_ENTRIES}, r AS (SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY first, key) AS rank FROM entries),
l AS (SELECT i, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INT)) ELSE chr(CAST(64 + i // 26 AS INT)) || chr(CAST(65 + i % 26 AS INT)) END AS label FROM (SELECT unnest(range(0, 702)) AS i)),
even AS (SELECT label, row_number() OVER (ORDER BY i) AS rank FROM l WHERE label NOT IN ('A', 'C')), odd AS (SELECT label, i + 1 AS rank FROM l)
SELECT id, key, coalesce(CASE WHEN id % 2 = 0 THEN e.label ELSE o.label END, '[…]') AS label FROM r LEFT JOIN even e ON e.rank = r.rank LEFT JOIN odd o ON o.rank = r.rank""",
    "redact_text": """SELECT doc_id AS id, md5(CASE WHEN instr(coalesce(text, ''), 'token = ') > 0 THEN substr(text, 1, instr(text, 'token = ') - 1) || '[…] ' || substr(text, instr(text, 'token = ') + 8) ELSE coalesce(text, '') END) AS digest FROM documents""",
    "verify_copy": """WITH a AS (SELECT conv_id AS file, turn AS index, coalesce(text, '') AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
b AS (SELECT conv_id AS file, turn AS index, regexp_replace(coalesce(text, ''), ' [A-Z][a-z]{8,} ', ' X.____ ', 'g') AS text FROM conversations WHERE conv_id % 50 <> 7 AND trim(coalesce(text, '')) <> '')
SELECT file, index, md5(a.text) AS expected, md5(b.text) AS actual FROM a FULL JOIN b USING (file, index) WHERE a.text IS DISTINCT FROM b.text""",
    "html_text": """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))) AS digest FROM a""",
    "list_length_quantiles": f"""WITH {_MAILS}, c AS (SELECT id, count(*) AS n FROM mails GROUP BY id), p AS (SELECT d.lang, coalesce(c.n, 0) AS n FROM documents d LEFT JOIN c ON c.id = d.doc_id)
SELECT lang, count(*)::BIGINT AS documents, median(n)::DOUBLE AS median, list_sort(list(n))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1]::BIGINT AS p90,
  list_sort(list(n))[CAST(floor(0.99::DOUBLE * (count(*) - 1)) AS BIGINT) + 1]::BIGINT AS p99, round(count(*) FILTER (WHERE n = 0) / count(*)::DOUBLE, 6) AS none FROM p GROUP BY lang""",
    "recall_by_form": """WITH t AS (SELECT l_returnflag AS form, l_linestatus AS mode, l_quantity > 10 AS hit FROM lineitem)
SELECT form, mode, count(*)::BIGINT AS n, count(*) FILTER (WHERE hit)::BIGINT AS hits FROM (SELECT * FROM t UNION ALL SELECT form, 'all', hit FROM t) GROUP BY form, mode""",
    "mention_caught": f"""WITH {_SPANS}, shown AS (SELECT doc, s + 3 AS a, e + 60 AS b FROM spans WHERE mention % 2 = 1)
SELECT doc, mention, bool_and(hit) AS caught FROM (SELECT doc, mention, EXISTS (SELECT 1 FROM shown x WHERE x.doc = t.doc AND t.s < x.b AND x.a < t.e) AS hit FROM spans t) GROUP BY doc, mention""",
    "entity_recall": """WITH m AS (SELECT l_suppkey % 3 AS a, l_orderkey AS d, l_partkey % 4 AS e, l_returnflag AS kind, l_linestatus AS type, bool_and(l_quantity > 5) AS c FROM lineitem GROUP BY ALL)
SELECT "group", count(*)::BIGINT AS entities, count(*) FILTER (WHERE c)::BIGINT AS found FROM (SELECT kind AS "group", c FROM m UNION ALL SELECT kind || ':' || type, c FROM m) GROUP BY 1""",
    "stratified_sample": """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) <= 5""",
    "name_forms": """WITH n AS (SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS l, 'Zoë' || n_nationkey AS f FROM nation)
SELECT f || ' ' || l AS name, form, written FROM (SELECT f, l, unnest(['surname', 'full', 'possessive', 'capitals', 'initial', 'double', 'mail', 'spelt_out']) AS form,
  unnest([l, f || ' ' || l, l || 's', upper(l), substr(f, 1, 1) || '. ' || l, l || '-' || l, lower(f) || '.' || lower(l) || '@gmail.com', replace(replace(replace(l, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')]) AS written FROM n)""",
}
_TURNS = "turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS index, coalesce(text, '') AS text FROM conversations)"
ORACLE_SQL |= {
    "docx_parts": f"WITH {_TURNS} SELECT conv_id, index, md5(text) AS digest FROM turns WHERE regexp_matches(text, '[\\pL\\pN_]')",
    "docx_copy": f"WITH {_TURNS}, c AS (SELECT conv_id, index, CASE WHEN length(text) >= 5 AND regexp_matches(text, '[\\pL\\pN_]') THEN 'X.____' || substr(text, 6) ELSE text END AS text FROM turns) SELECT conv_id, index, md5(text) AS digest FROM c WHERE regexp_matches(text, '[\\pL\\pN_]')",
}

_MASK = r"\b[A-Z]{1,3}\.?_{2,}|\[(?:\.\.\.|…)\]|\bX{3,}\b|\*{3,}"
_DIGITS = lambda a, b, n: f"lpad(CAST((x * {a} + {b}) % {10**n} AS VARCHAR), {n}, '0')"
_TEXT = lambda a, b, m, low: f"CAST((x * {a} + {b}) % {m} + {low} AS VARCHAR)"
ORACLE_SQL |= {
    "mask_positions": f"""WITH {_MASKED}, single AS (SELECT id, min(text) AS text FROM masked GROUP BY id),
cut AS (SELECT id, length(text) AS size, string_split_regex(text, '{_MASK}') AS ps, regexp_extract_all(text, '{_MASK}') AS ms FROM single),
pieces AS (SELECT id, size, i, ps[i] AS piece, ms[i] AS mask FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM cut)),
placed AS (SELECT *, sum(length(piece) + coalesce(length(mask), 0)) OVER (PARTITION BY id ORDER BY i) AS upto FROM pieces)
SELECT id, (i - 1)::BIGINT AS nth, (upto - length(mask))::BIGINT AS start, upto::BIGINT AS "end", mask FROM placed
WHERE mask IS NOT NULL AND upto - length(mask) > 40 AND upto - length(mask) < size - 20""",
    "synthetic_identifiers": f"""WITH d AS (SELECT doc_id AS id, doc_id % 1000000000 AS x FROM documents),
n AS (SELECT id, x, '756' || {_DIGITS(104729, 7, 9)} AS t, {_DIGITS(15485863, 11, 9)} || {_DIGITS(32452843, 13, 8)} AS a FROM d),
c AS (SELECT id, x, t || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(t, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR) AS s,
  'CH' || lpad(CAST(98 - CAST(a || '121700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || a AS b FROM n)
SELECT id, label, phrase FROM (
  SELECT id, 'ahv' AS label, 'AHV-Nr. ' || substr(s, 1, 3) || '.' || substr(s, 4, 4) || '.' || substr(s, 8, 4) || '.' || substr(s, 12) AS phrase FROM c
  UNION ALL SELECT id, 'iban', 'IBAN ' || substr(b, 1, 4) || ' ' || substr(b, 5, 4) || ' ' || substr(b, 9, 4) || ' ' || substr(b, 13, 4) || ' ' || substr(b, 17, 4) || ' ' || substr(b, 21) FROM c
  UNION ALL SELECT id, 'mobile', 'Telefon 079 ' || {_TEXT(31, 1, 900, 100)} || ' ' || {_TEXT(37, 2, 90, 10)} || ' ' || {_TEXT(41, 3, 90, 10)} FROM c
  UNION ALL SELECT id, 'address', 'wohnhaft in der Seegasse ' || {_TEXT(43, 4, 99, 1)} || ', ' || {_TEXT(47, 5, 8000, 1000)} || ' Musterdorf' FROM c
  UNION ALL SELECT id, 'plate', 'Fahrzeug mit dem Kennzeichen ZH ' || {_TEXT(53, 6, 900000, 10000)} FROM c
  UNION ALL SELECT id, 'parcel', 'Parzelle Nr. ' || {_TEXT(59, 8, 9900, 100)} FROM c
  UNION ALL SELECT id, 'birth_date', 'geboren am ' || {_TEXT(61, 9, 28, 1)} || '. März 19' || {_TEXT(67, 10, 60, 40)} FROM c)""",
}
