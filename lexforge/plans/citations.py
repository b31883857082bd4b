"""Queries over the list of decisions and over references to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import keys
from lexforge.operators import citelist, references
from lexforge.plans import domain
from lexforge.plans.domain import LINES_SQL, REFS_SQL
from lexforge.session import Scratch, table

def _csv():
    return F.array_join("enums", ",").alias("enums")


def _lines(spark, sf):
    return citelist.lines(domain.decisions(spark, sf), domain.numbering(spark, sf), domain.aliases(spark, sf))


def _refs(spark, sf, *columns):
    return references.parsed(domain.references(spark, sf), *columns)


def _cut(spark, sf):
    """References and lines as written tables, for what reads them several times."""
    scratch = Scratch(spark)
    return scratch.cut(_refs(spark, sf), "refs"), scratch.cut(_lines(spark, sf), "lines")


def cite_index_lines(spark, sf):
    return _lines(spark, sf).orderBy("key", "court", "canton", "date").select("key", "court", "canton", "date", _csv(), "id")


def cite_index_dedup(spark, sf):
    return citelist.deduplicated(_lines(spark, sf)).select("key", "court", "canton", "date", _csv(), "id")


def cite_drop_counts(spark, sf):
    return citelist.resolve_duplicates(_lines(spark, sf)).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def court_coverage(spark, sf):
    return citelist.coverage(domain.decisions(spark, sf), domain.numbering(spark, sf))


def manifest_totals(spark, sf):
    return citelist.totals(domain.decisions(spark, sf), domain.numbering(spark, sf), _lines(spark, sf))


def absent_volumes(spark, sf):
    # Volumes of whole years are all there; the years' odd pages leave gaps to find.
    rows = _lines(spark, sf).where("key LIKE 'BGE%'").withColumn("key", F.concat(F.lit("BGE "), F.lpad((F.substring("key", -4, 4).cast("int") * 6 % 200 + 1).cast("string"), 3, "0"), F.lit(" I 0001")))
    return citelist.absent_volumes(rows)


def lookup_exact(spark, sf):
    rows = citelist.listed(domain.decisions(spark, sf), domain.aliases(spark, sf))
    return citelist.lookup(_refs(spark, sf, "key"), rows.select("key", "court", "date", "id"))


def lookup_semi(spark, sf):
    return citelist.lookup(_refs(spark, sf, "key"), _lines(spark, sf).select("key"), "left_semi")


def lookup_missing(spark, sf):
    return citelist.lookup(_refs(spark, sf, "key"), _lines(spark, sf).select("key"), "left_anti")


def alias_lookup(spark, sf):
    known = domain.decisions(spark, sf).select(F.col("decision_id").alias("canonical_decision_id"), "court")
    found = domain.aliases(spark, sf).join(known, "canonical_decision_id")
    return found.select(keys.key_for(F.col("court"), F.translate("alias_docket_norm", "_", " ")).alias("key"), F.col("canonical_decision_id").alias("id"))


def key_neighbours(spark, sf):
    probes = _refs(spark, sf, "key").select(F.col("key").alias("probe")).distinct()
    return citelist.neighbours(probes, _lines(spark, sf))


def page_ranges(spark, sf):
    return citelist.page_ranges(_lines(spark, sf))


def contains_page(spark, sf):
    at = keys.computed(_refs(spark, sf, "key").where("key LIKE 'BGE %'"), keys.split_collection_key(F.col("key")).alias("at"))
    at = Scratch(spark).cut(at.where("at IS NOT NULL").select("ref_id", "at.*"), "pages")  # parsed once, read twice
    return citelist.containing_page(at, citelist.page_ranges(_lines(spark, sf))).select("ref_id", "key", "first", "last")


def asof_probe(spark, sf):
    """The last decision of a court before each reference's date."""
    refs = Scratch(spark).cut(_refs(spark, sf, "written_date").select("ref_id", F.col("written_date").alias("at")), "refs")  # parsed once, read twice
    days = domain.decisions(spark, sf).where("court = 'bger'").select(F.col("decision_date").alias("at")).distinct().withColumn("listed", F.col("at"))
    from pyspark.sql import Window

    # One row a day on either side: the day's answer is found once and joined to its references.
    asked = refs.select("at").distinct().withColumn("listed", F.lit(None).cast("string"))
    both = asked.unionByName(days).groupBy("at").agg(F.max("listed").alias("listed")).withColumn("year", F.substring("at", 1, 4))
    year = Window.partitionBy("year").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = both.select("at", "year", F.last("listed", ignorenulls=True).over(year).alias("in_year"))
    ends = days.groupBy(F.substring("at", 1, 4).alias("y")).agg(F.max("at").alias("end"))
    earlier = found.where("in_year IS NULL").join(F.broadcast(ends), F.col("y") < F.col("year"), "left").groupBy("at").agg(F.max("end").alias("end"))
    answer = found.join(earlier, "at", "left").select("at", F.coalesce("in_year", "end").alias("before"))
    return refs.join(answer, "at").select("ref_id", F.col("at").alias("written_date"), "before")


def one_edit_suggestions(spark, sf):
    scratch = Scratch(spark)
    rows = scratch.cut(_lines(spark, sf).where("key NOT LIKE 'BGE%'"), "lines")
    # Parsed once; what is missing is read several times.
    missing = scratch.cut(citelist.lookup(_refs(spark, sf).where("key NOT LIKE 'BGE%'"), rows.select("key"), "left_anti"), "missing")
    return citelist.suggest(missing, rows)


def collection_suggestions(spark, sf):
    rows = Scratch(spark).cut(_lines(spark, sf).where("key LIKE 'BGE %'"), "lines")
    missing = citelist.lookup(_refs(spark, sf, "key").where("key LIKE 'BGE %'"), rows.select("key"), "left_anti")
    return citelist.collection_suggestions(missing, rows)


def other_part(spark, sf):
    return citelist.other_part(_refs(spark, sf, "key").where("key LIKE 'BGE %'"), _lines(spark, sf).where("key LIKE 'BGE %'"))


def _pinned(spark, sf, *pins, levels=True):
    """Lists of written references that ask alike (``refs``: of one key and first number) beside the lines of their key.

    ``asked`` holds the numbers that are asked of each (*pins*, else the first one) with their places, lines have what
    they cover and, with *levels*, the neighbours of these places.
    """
    refs, rows = _refs(spark, sf, "key", "pinpoint"), citelist.dealt(_lines(spark, sf).select("key", "court", "canton", "date", "enums"), "key")
    pins = pins or (F.col("pinpoint"),)
    rows = keys.computed(rows, citelist.covered(F.col("enums")).alias("covered"))
    if levels:
        refs = Scratch(spark).cut(refs, "refs")  # parsed once, read twice
        each = refs.where("key IS NOT NULL").select("key", "pinpoint").distinct().select("key", F.explode(F.array(*pins)).alias("pin"))
        rows = citelist.with_levels(rows, each.distinct())
    asked = F.array(*[F.struct(p.alias("pin"), citelist.stem(p).alias("stem"), citelist.pinpoint_parent(p).alias("parent")) for p in pins])
    return rows.join(keys.computed(citelist.gathered(refs, ["key", "pinpoint"], "key"), asked.alias("asked")), "key")


#: The state of the first number that is asked of a line.
_FIRST_STATE = lambda: citelist.pinpoint_state(F.col("pinpoint"), F.col("enums"), F.col("covered"), F.col("asked")[0]["parent"])


def pinpoint_check(spark, sf):
    found = _pinned(spark, sf, levels=False).select("key", "court", "canton", "date", "pinpoint", _FIRST_STATE().alias("state"), "refs")
    return citelist.laid_out(found).select("ref_id", "key", "court", "canton", "date", "pinpoint", "state")


def nearby_numbers(spark, sf):
    absent = _pinned(spark, sf).where(_FIRST_STATE() == "absent")
    at = keys.computed(absent, F.element_at("levels", F.col("asked")[0]["stem"]).alias("at"))
    found = at.select("court", "canton", "date", "pinpoint", F.array_join("at.numbers", ",").alias("numbers"), "at.more", "refs")
    return citelist.laid_out(found).select("ref_id", "court", "canton", "date", "pinpoint", "numbers", "more")


def finding_status(spark, sf):
    found = references.check(*_cut(spark, sf))
    return found.select("ref_id", "key", "status", F.array_join("issues", ",").alias("issues"), F.array_join("notes", ",").alias("notes"), "n_listed", "n_scoped")


def court_scope(spark, sf):
    found = references.court_issues(Scratch(spark).cut(_refs(spark, sf), "refs"), _lines(spark, sf))
    return found.select("ref_id", "key", F.array_join("listed", ",").alias("listed"), "n")


def date_issue(spark, sf):
    found = references.date_issues(Scratch(spark).cut(_refs(spark, sf), "refs"), _lines(spark, sf))
    return found.select("ref_id", "key", "written_date", F.array_join("listed", ",").alias("listed"))


def status_counts(spark, sf):
    return references.status_counts(references.check(*_cut(spark, sf)))


def parse_reference(spark, sf):
    return _refs(spark, sf).select("ref_id", F.array_join("courts", ",").alias("courts"), "label", "key", "written_date", "pinpoint")


def decision_links(spark, sf):
    rows = _lines(spark, sf)
    pin = F.concat(F.substring("date", 7, 1), F.lit(".1"))
    return rows.select("key", "court", "canton", "date", keys.decision_link("https://decisions.example/", F.col("id"), F.col("enums"), pin).alias("link"), keys.label(F.col("key")).alias("label"), keys.display_date(F.col("date")).alias("shown_date"))


def gap_fill_source(spark, sf):
    """Decisions of a court-wise export, and from the whole store those of courts that the export lacks."""
    from lexforge.sources.corpus import gap_filled

    every = domain.decisions(spark, sf)
    export = every.where("court NOT LIKE 'c1%'").withColumn("origin", F.lit("export"))
    return gap_filled(export, every.withColumn("origin", F.lit("store")), "court").groupBy("court", "origin").agg(F.count("*").alias("n"))


def joined_applications(spark, sf):
    """Application numbers that are listed as the first of two joined ones."""
    year = (F.year("o_orderdate") % 100).cast("string")
    number = lambda c: F.concat((F.col(c) % 2000).cast("string"), F.lit("/"), year)
    o = table(spark, sf, "orders")
    listed = o.select(F.concat_ws("_", number("o_orderkey"), number("o_custkey")).alias("key")).distinct()
    return citelist.joined_applications(o.select(F.col("o_orderkey").alias("ref_id"), number("o_custkey").alias("key")), listed)


#: A cantonal court's name, the code of its canton, and a file number of one form for each; $n, $y and $p are numbers.
_CANTONAL = (
    ("Obergericht des Kantons Zürich", "ZH", "SB190$p-O"), ("Verwaltungsgericht ZH,", "ZH", "VB.$y.00$p"), ("Cour de justice de Genève", "GE", "ACJC/$n/$y"), ("Tribunale d'appello del Canton Ticino", "TI", "52.$y.$n"),
    ("OGer BE", "BE", "100 $y $n"), ("Kantonsgericht St. Gallen", "SG", "BO $y $n"), ("Tribunal cantonal, Vaud,", "VD", "HC $y/$n"), ("Kantonsgericht Freiburg", "FR", "KGE$y.$n"), ("Kantonsgericht", None, "ZK $y $n"),
)


def _cantonal_prose(spark, sf):
    """Every order as a reference to a cantonal decision, each ninth in one of the forms."""
    form = (F.col("o_orderkey") % len(_CANTONAL)).cast("int")
    n, y, p = (F.col("o_custkey") % 999 + 1).cast("string"), F.year("o_orderdate").cast("string"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    of = lambda i: F.get(F.array(*[F.lit(c[i]) for c in _CANTONAL]), form)
    docket = F.replace(F.replace(F.replace(of(2), F.lit("$n"), n), F.lit("$y"), y), F.lit("$p"), p)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref_id"), F.concat(F.lit("Urteil "), of(0), F.lit(" "), docket, F.lit(" vom 3. Mai 2019 E. 2.1")).alias("prose"))


def parse_cantonal(spark, sf):
    return references.parsed(_cantonal_prose(spark, sf)).select("ref_id", "label", "key", "canton", "written_date", "pinpoint")


def page_issue(spark, sf):
    """Pages behind a comma, some of them beyond the decision's last page, a few out of reach."""
    lines = Scratch(spark).cut(_lines(spark, sf).where("key LIKE 'BGE%'"), "lines")
    at = keys.split_collection_key(F.col("key"))
    prose = F.concat(keys.label(F.col("key")), F.lit(", S. "), (at["page"] + F.length("id") * 40 - 180).cast("string"), F.lit(" ff."))
    refs = lines.select(F.col("id").alias("ref_id"), "key", references.page_tail(prose).alias("page"))
    return references.page_issues(refs, citelist.page_ranges(lines)).select("ref_id", "key", "page", "last")


def findings_union(spark, sf):
    """Checked references beside loose labels, of which some are listed after all."""
    checked = references.check(*_cut(spark, sf), "label")
    o = table(spark, sf, "orders")
    label = F.concat(F.lit("VB."), F.year("o_orderdate").cast("string"), F.lit("."), (F.col("o_custkey") % 150 + 1).cast("string"))
    loose = references.loose_labels(o.select(F.col("o_orderkey").alias("paragraph"), F.concat(F.lit("siehe "), label, F.lit(" und SJ 1999 I 3")).alias("text")))
    listed = o.where("o_custkey % 2 = 0").select(label.alias("key")).distinct()
    return references.all_findings(checked, references.loose_status(loose, listed))


QUERIES = {f.__name__: f for f in (cite_index_lines, cite_index_dedup, cite_drop_counts, court_coverage, manifest_totals, absent_volumes, lookup_exact, lookup_semi, lookup_missing, alias_lookup, key_neighbours, page_ranges, contains_page, asof_probe, one_edit_suggestions, other_part, pinpoint_check, nearby_numbers, court_scope, date_issue, finding_status, status_counts, parse_reference, decision_links, gap_fill_source, joined_applications, parse_cantonal, page_issue, findings_union, collection_suggestions)}

_KIND = """
kinds AS (
  SELECT *, CASE WHEN copy AND fed IS NOT NULL THEN 'cantonal_copy' WHEN NOT copy AND yearly AND dated IS NOT NULL THEN 'year_only' END AS kind
  FROM (SELECT *, regexp_matches(key, '^[0-9][A-Z]{1,2}_[0-9]{1,5}/[0-9]{4}$') AND court NOT IN ('bger', 'bge') AND canton NOT IN ('', 'CH') AS copy,
          regexp_matches(date, '^[0-9]{4}(-01-01)?$') AS yearly,
          min(CASE WHEN court IN ('bger', 'bge') THEN court END) OVER (PARTITION BY key, date) AS fed,
          min(CASE WHEN NOT regexp_matches(date, '^[0-9]{4}(-01-01)?$') THEN date END) OVER (PARTITION BY key, court, canton, substr(date, 1, 4)) AS dated
        FROM lines)),
targets AS (
  SELECT *, CASE WHEN kind = 'cantonal_copy' THEN fed ELSE court END AS tc, CASE WHEN kind = 'cantonal_copy' THEN 'CH' ELSE canton END AS tn, CASE WHEN kind = 'year_only' THEN dated ELSE date END AS td FROM kinds)"""
_STATE = """CASE WHEN enums = '' THEN 'no_structure'
  WHEN len(list_filter(string_split(enums, ','), lambda e: e = pinpoint OR (starts_with(e, pinpoint) AND regexp_matches(substr(e, length(pinpoint) + 1, 1), '^[.a-z/]$')))) > 0 THEN 'exists'
  WHEN regexp_replace(pinpoint, '[a-z]+$', '') <> pinpoint AND list_contains(string_split(enums, ','), regexp_replace(pinpoint, '[a-z]+$', '')) THEN 'parent_only'
  ELSE 'absent' END"""
_W, _R = f"WITH {LINES_SQL}", f"WITH {LINES_SQL}, {REFS_SQL}"
_CHECK = f"""
met AS (
  SELECT p.*, l.court, l.date, l.court IS NOT NULL AS listed, l.court IS NOT NULL AND (p.named IS NULL OR p.named = l.court) AS scoped, {_STATE} AS state
  FROM parsed p LEFT JOIN lines l ON l.key = p.key),
grouped AS (
  SELECT ref_id, key, any_value(written_date) AS written_date, count(*) FILTER (WHERE listed) AS n_listed, count(*) FILTER (WHERE scoped) AS n_scoped,
    count(*) FILTER (WHERE scoped AND date NOT LIKE '%-01-01') AS n_dated, count(*) FILTER (WHERE scoped AND date = written_date) AS n_same,
    count(DISTINCT CASE WHEN scoped THEN court || date END) AS n_unlike,
    min(CASE WHEN scoped THEN CASE state WHEN 'exists' THEN 0 WHEN 'parent_only' THEN 1 WHEN 'absent' THEN 2 ELSE 3 END END) AS pin
  FROM met GROUP BY ref_id, key),
judged AS (
  SELECT *, n_listed > 0 AND n_scoped = 0 AS bad_court, n_scoped > 0 AND n_dated = n_scoped AND n_same = 0 AS bad_date, n_scoped > 0 AND pin = 2 AS bad_pin FROM grouped),
findings AS (
  SELECT ref_id, key, CASE WHEN n_listed = 0 THEN 'missing' WHEN bad_court OR bad_date OR bad_pin THEN 'differs' ELSE 'found' END AS status,
    concat_ws(',', CASE WHEN bad_court THEN 'court' END, CASE WHEN bad_date THEN 'date' END, CASE WHEN bad_pin THEN 'pinpoint' END) AS issues,
    concat_ws(',', CASE WHEN n_scoped > 0 AND pin = 3 THEN 'pinpoint_no_structure' END, CASE WHEN n_scoped > 0 AND pin = 1 THEN 'pinpoint_parent_only' END, CASE WHEN n_scoped > 1 AND n_unlike > 1 THEN 'several' END) AS notes,
    n_listed::BIGINT AS n_listed, n_scoped::BIGINT AS n_scoped FROM judged)"""
_RANGES = """
pages AS (SELECT DISTINCT key, CAST(substr(key, 5, 3) AS BIGINT) AS volume, split_part(key, ' ', 3) AS part, CAST(split_part(key, ' ', 4) AS BIGINT) AS first FROM lines WHERE key LIKE 'BGE %'),
ranges AS (SELECT *, lead(first) OVER (PARTITION BY volume, part ORDER BY first) - 1 AS last FROM pages)"""

ORACLE_SQL = {
    "cite_index_lines": f"{_W} SELECT key, court, canton, date, enums, id FROM lines",
    "cite_index_dedup": f"""{_W}, {_KIND},
moved AS (
  SELECT a.key, coalesce(b.tc, a.tc) AS court, coalesce(b.tn, a.tn) AS canton, coalesce(b.td, a.td) AS date, a.enums, CASE WHEN a.kind IS NULL THEN a.id END AS id
  FROM targets a LEFT JOIN (SELECT * FROM targets WHERE kind IS NOT NULL) b ON a.key = b.key AND a.tc = b.court AND a.tn = b.canton AND a.td = b.date),
kept AS (SELECT key, court, canton, date, min(id) AS id FROM moved GROUP BY ALL HAVING min(id) IS NOT NULL),
single AS (SELECT DISTINCT key, court, canton, date, e FROM (SELECT key, court, canton, date, unnest(string_split(enums, ',')) AS e FROM moved WHERE enums <> ''))
SELECT k.key, k.court, k.canton, k.date, coalesce(string_agg(e, ',' {domain.NATURAL_SQL}), '') AS enums, k.id
FROM kept k LEFT JOIN single s ON s.key = k.key AND s.court = k.court AND s.canton = k.canton AND s.date = k.date GROUP BY k.key, k.court, k.canton, k.date, k.id""",
    "cite_drop_counts": f"{_W}, {_KIND} SELECT kind, count(*)::BIGINT AS n FROM kinds WHERE kind IS NOT NULL GROUP BY kind",
    "court_coverage": f"""WITH {domain.SQL}
SELECT court, min(canton) AS canton, count(*)::BIGINT AS decisions, count(n.decision_id)::BIGINT AS with_numbering, min(decision_date) AS first, max(decision_date) AS last
FROM decisions d LEFT JOIN (SELECT DISTINCT decision_id FROM enums) n USING (decision_id) GROUP BY court""",
    "manifest_totals": f"""{_W} SELECT (SELECT count(*) FROM decisions)::BIGINT AS decisions, (SELECT count(*) FROM lines)::BIGINT AS labels,
  (SELECT count(*) FROM decisions WHERE decision_id IN (SELECT decision_id FROM enums))::BIGINT AS with_numbering""",
    "absent_volumes": f"""{_W}, v AS (SELECT DISTINCT (CAST(right(key, 4) AS BIGINT) * 6 % 200 + 1) AS volume FROM lines WHERE key LIKE 'BGE%'),
span AS (SELECT min(volume) AS first, max(volume) AS last FROM v)
SELECT first, last, volume FROM (SELECT first, last, unnest(range(first, last + 1)) AS volume FROM span) WHERE volume NOT IN (SELECT volume FROM v)""",
    "lookup_exact": f"{_R} SELECT key, ref_id, court, date, id FROM parsed JOIN lines USING (key)",
    "lookup_semi": f"{_R} SELECT ref_id, key FROM parsed WHERE key IN (SELECT key FROM lines)",
    "lookup_missing": f"{_R} SELECT ref_id, key FROM parsed WHERE key NOT IN (SELECT key FROM lines)",
    "alias_lookup": f"WITH {domain.SQL} SELECT {domain.key_for_sql('d.court', chr(39).join(['replace(a.alias_docket_norm, ', '_', ', ', ' ', ')']))} AS key, d.decision_id AS id FROM aliases a JOIN decisions d ON d.decision_id = a.canonical_decision_id",
    "key_neighbours": f"""{_R}, k AS (SELECT DISTINCT key FROM lines), p AS (SELECT DISTINCT key AS probe FROM parsed)
SELECT probe, b.key AS before, a.key AS after FROM p ASOF LEFT JOIN k b ON p.probe > b.key ASOF LEFT JOIN k a ON p.probe < a.key""",
    "page_ranges": f"{_W}, {_RANGES} SELECT key, volume, part, first, last FROM ranges",
    "contains_page": f"""{_R}, {_RANGES}
SELECT ref_id, r.key, r.first, r.last FROM parsed p JOIN ranges r ON p.key LIKE 'BGE %' AND CAST(substr(p.key, 5, 3) AS BIGINT) = r.volume AND split_part(p.key, ' ', 3) = r.part
  AND CAST(split_part(p.key, ' ', 4) AS BIGINT) BETWEEN r.first AND coalesce(r.last, r.first + 40)""",
    "asof_probe": f"""{_R}, days AS (SELECT DISTINCT decision_date AS d FROM decisions WHERE court = 'bger')
SELECT ref_id, written_date, d AS before FROM parsed p ASOF LEFT JOIN days ON p.written_date > days.d""",
    "one_edit_suggestions": f"""{_R},
missing AS (SELECT * FROM parsed WHERE key NOT IN (SELECT key FROM lines) AND key NOT LIKE 'BGE%'),
wanted AS (SELECT DISTINCT key FROM missing),
near AS (SELECT DISTINCT w.key, l.key AS variant FROM wanted w JOIN (SELECT DISTINCT key FROM lines WHERE key NOT LIKE 'BGE%') l
  ON right(w.key, 2) = right(l.key, 2) AND abs(length(w.key) - length(l.key)) <= 1 AND damerau_levenshtein(w.key, l.key) = 1 AND regexp_replace(w.key, '[0-9A-Z]', '', 'g') = regexp_replace(l.key, '[0-9A-Z]', '', 'g')
  UNION SELECT DISTINCT w.key, l.key FROM wanted w JOIN (SELECT DISTINCT key FROM lines WHERE key NOT LIKE 'BGE%') l
  ON left(w.key, 3) = left(l.key, 3) AND abs(length(w.key) - length(l.key)) <= 1 AND damerau_levenshtein(w.key, l.key) = 1 AND regexp_replace(w.key, '[0-9A-Z]', '', 'g') = regexp_replace(l.key, '[0-9A-Z]', '', 'g')),
met AS (SELECT m.ref_id, l.key, l.court, l.canton, l.date, l.date = m.written_date AS same,
  CASE WHEN l.date = m.written_date THEN 0 ELSE 4 END + CASE WHEN len(list_filter(string_split(l.enums, ','), lambda e: e = m.pinpoint OR starts_with(e, m.pinpoint || '.'))) > 0 THEN 0 ELSE 2 END
  + CASE WHEN m.named IS NULL OR m.named = l.court THEN 0 ELSE 1 END AS score
  FROM missing m JOIN near n ON n.key = m.key JOIN lines l ON l.key = n.variant),
best AS (SELECT *, min(score) OVER (PARTITION BY ref_id) AS best FROM met),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score, key, court, canton, date) AS rank FROM best WHERE best >= 4 OR score < 4)
SELECT ref_id, rank, key, court, date, CASE WHEN same THEN 'one_character_same_date' ELSE 'one_character' END AS reason, score::BIGINT AS score FROM ranked WHERE rank <= 3""",
    "other_part": f"""{_R} SELECT p.ref_id, l.key, l.court, l.date FROM parsed p JOIN lines l ON p.key LIKE 'BGE %' AND l.key LIKE 'BGE %'
  AND substr(p.key, 5, 3) = substr(l.key, 5, 3) AND right(p.key, 4) = right(l.key, 4) AND p.key <> l.key""",
    "pinpoint_check": f"{_R} SELECT ref_id, key, court, canton, date, pinpoint, {_STATE} AS state FROM parsed JOIN lines USING (key)",
    "nearby_numbers": f"""{_R},
absent AS (SELECT * FROM (SELECT ref_id, court, canton, date, pinpoint, string_split(enums, ',') AS es, {_STATE} AS state FROM parsed JOIN lines USING (key)) WHERE state = 'absent'),
sib AS (SELECT *, list_filter(es, lambda e: starts_with(e, split_part(pinpoint, '.', 1) || '.')) AS s FROM absent),
lev AS (SELECT *, CASE WHEN len(s) > 0 THEN s ELSE list_transform(es, lambda e: split_part(e, '.', 1)) END AS raw FROM sib),
uni AS (SELECT ref_id, court, canton, date, pinpoint, list_filter(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN list_position(raw, raw[i]) = i THEN raw[i] END), lambda e: e IS NOT NULL) AS u FROM lev)
SELECT ref_id, court, canton, date, pinpoint, array_to_string(u[1:14], ',') AS numbers, len(u) > 14 AS more FROM uni""",
    "finding_status": f"{_R}, {_CHECK} SELECT ref_id, key, status, issues, notes, n_listed, n_scoped FROM findings",
    "court_scope": f"""{_R}, {_CHECK} SELECT ref_id, key, string_agg(DISTINCT court, ',' ORDER BY court) AS listed, count(*)::BIGINT AS n
FROM met JOIN judged USING (ref_id, key) WHERE bad_court AND listed GROUP BY ref_id, key""",
    "date_issue": f"""{_R}, {_CHECK} SELECT ref_id, key, any_value(met.written_date) AS written_date, string_agg(DISTINCT date, ',' ORDER BY date) AS listed
FROM met JOIN judged USING (ref_id, key) WHERE bad_date AND scoped GROUP BY ref_id, key""",
    "status_counts": f"""{_R}, {_CHECK} SELECT s.status, count(f.ref_id)::BIGINT AS n FROM (VALUES ('found'), ('differs'), ('missing'), ('unchecked')) s(status) LEFT JOIN findings f ON f.status = s.status GROUP BY s.status""",
    "parse_reference": f"WITH {REFS_SQL} SELECT ref_id, coalesce(named, '') AS courts, label, key, written_date, pinpoint FROM parsed",
    "decision_links": f"""{_W}, a AS (SELECT *, substr(date, 7, 1) || '.1' AS pin, string_split(enums, ',') AS es FROM lines),
b AS (SELECT *, CASE WHEN list_contains(es, pin) THEN pin ELSE list_filter(es, lambda e: starts_with(e, pin || '.'))[1] END AS hit FROM a)
SELECT key, court, canton, date, 'https://decisions.example/' || id || coalesce('#e-' || replace(hit, '.', '-'), '') AS link,
  CASE WHEN key LIKE 'BGE %' THEN 'BGE ' || CAST(substr(key, 5, 3) AS INT) || ' ' || replace(replace(split_part(key, ' ', 3), 'IA', 'Ia'), 'IB', 'Ib') || ' ' || CAST(right(key, 4) AS INT) ELSE key END AS label,
  CASE WHEN date LIKE '%-01-01' THEN substr(date, 1, 4) ELSE CAST(substr(date, 9, 2) AS INT) || '.' || CAST(substr(date, 6, 2) AS INT) || '.' || substr(date, 1, 4) END AS shown_date FROM b""",
    "gap_fill_source": f"""WITH {domain.SQL} SELECT court, CASE WHEN court LIKE 'c1%' THEN 'store' ELSE 'export' END AS origin, count(*)::BIGINT AS n FROM decisions GROUP BY ALL""",
    "joined_applications": """WITH o AS (SELECT o_orderkey, (o_orderkey % 2000) || '/' || (year(o_orderdate) % 100) AS a, (o_custkey % 2000) || '/' || (year(o_orderdate) % 100) AS b FROM orders),
j AS (SELECT DISTINCT a || '_' || b AS listed, a AS head FROM o)
SELECT o_orderkey AS ref_id, b AS key, listed FROM o JOIN j ON o.b = j.head""",
}

_LISTED = lambda i: "[" + ", ".join("NULL" if c[i] is None else "'" + c[i].replace("'", "''") + "'" for c in _CANTONAL) + "]"
ORACLE_SQL |= {
    "collection_suggestions": f"""{_R}, {_RANGES},
m AS (SELECT DISTINCT key AS asked, CAST(substr(key, 5, 3) AS BIGINT) AS volume, split_part(key, ' ', 3) AS part, CAST(right(key, 4) AS BIGINT) AS page, substr(key, 5, 3) || right(key, 4) AS digits
  FROM parsed WHERE key LIKE 'BGE %' AND key NOT IN (SELECT key FROM lines)),
l AS (SELECT *, substr(key, 5, 3) || right(key, 4) AS digits, split_part(key, ' ', 3) AS part, row_number() OVER (PARTITION BY key ORDER BY court, canton, date) AS nth FROM lines WHERE key LIKE 'BGE %'),
near AS (
  SELECT asked, r.key, 0 AS source FROM m JOIN ranges r ON r.volume = m.volume AND r.part = m.part AND m.page BETWEEN r.first AND coalesce(r.last, r.first + 40)
  UNION ALL SELECT asked, l.key, 100 + list_position({list(keys.PARTS)}, l.part) FROM m JOIN l ON l.digits = m.digits AND l.part <> m.part WHERE nth = 1
  UNION ALL SELECT asked, l.key, 200 FROM m JOIN l ON l.part = m.part AND damerau_levenshtein(l.digits, m.digits) = 1 WHERE nth = 1),
best AS (SELECT asked, key, min(source) AS source FROM near GROUP BY asked, key),
ranked AS (SELECT asked, key, court, date, source, row_number() OVER (PARTITION BY asked ORDER BY source, key, court, canton, date) AS rank
  FROM best JOIN l USING (key) WHERE nth = 1 OR source BETWEEN 100 AND 199)
SELECT p.ref_id, r.rank, r.key, r.court, r.date, CASE WHEN source = 0 THEN 'contains_page' WHEN source < 200 THEN 'other_part' ELSE 'one_character' END AS reason
FROM parsed p JOIN ranked r ON r.asked = p.key WHERE rank <= 4""",
    "parse_cantonal": f"""WITH o AS (SELECT o_orderkey AS ref_id, CAST(o_orderkey % {len(_CANTONAL)} AS INT) + 1 AS i,
  replace(replace(replace({_LISTED(2)}[CAST(o_orderkey % {len(_CANTONAL)} AS INT) + 1], '$n', CAST(o_custkey % 999 + 1 AS VARCHAR)), '$y', CAST(year(o_orderdate) AS VARCHAR)), '$p', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')) AS label FROM orders)
SELECT ref_id, label, label AS key, {_LISTED(1)}[i] AS canton, '2019-05-03' AS written_date, '2.1' AS pinpoint FROM o""",
    "page_issue": f"""{_W}, {_RANGES}, p AS (SELECT l.id AS ref_id, r.key, r.first, r.last, r.first + length(l.id) * 40 - 180 AS page FROM lines l JOIN ranges r ON r.key = l.key)
SELECT ref_id, key, CAST(page AS INT) AS page, last FROM p WHERE page > first AND page <= first + {references.PAGE_REACH} AND page > last""",
    "findings_union": f"""{_R}, {_CHECK}, l AS (SELECT o_orderkey AS at_, 'VB.' || year(o_orderdate) || '.' || (o_custkey % 150 + 1) AS label, o_custkey FROM orders)
SELECT 'parsed' AS source, ref_id AS at, label, status, NULL AS kind FROM findings JOIN (SELECT ref_id, label FROM parsed) USING (ref_id)
UNION ALL SELECT 'loose', at_, label, CASE WHEN label IN (SELECT label FROM l WHERE o_custkey % 2 = 0) THEN 'found' ELSE 'unchecked' END, 'unknown_shape' FROM l
UNION ALL SELECT 'loose', at_, 'SJ 1999 I 3', 'unchecked', 'collection' FROM l""",
}
