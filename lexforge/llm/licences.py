"""Operator 9: licence notices by sparse TF-IDF cosine, inherited from the nearest directory; DataFrame functions only.

Texts are cut into statements (lines and sentences). Those that share enough of a template's weight to be a notice
(an exact bound) are compared with templates of licences: terms are weighed by their document frequency in the whole
corpus, and a statement's licence is that of the template with the largest cosine. Licence files (by name, or because most of their words are notices) license
their directory; a file without a notice of its own inherits from the nearest ancestor directory that has a licence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import hot_join
from lexforge.session import Scratch, table

#: Least cosine of a notice, and least share of a licence file's words that are notices.
LEAST, COVER = 0.6, 0.5
#: Terms of statements, at most, that are sent to every task to be counted; more are joined.
SENT_TERMS = 500_000

# Statements by which licences are declared.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


def terms_of(templates=TEMPLATES) -> list[tuple[int, str, str, int]]:
    """(template, licence, term, frequency) rows."""
    return [(i, name, term, n) for i, (name, text) in enumerate(templates) for term, n in sorted(Counter(re.findall("[a-z0-9]+", text.lower())).items())]


def _terms(text) -> F.Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _idf(df, total) -> F.Column:
    return F.log((F.lit(1.0) + total) / (F.lit(1.0) + df)) + 1


def _weights(files: DataFrame, templates) -> tuple[DataFrame, DataFrame, int]:
    """Template terms with their weights (a table fixed by the templates), template norms, and the number of files."""
    spark = files.sparkSession
    rows = spark.createDataFrame(terms_of(templates), "template int, licence string, term string, tf int")
    words = sorted({r[2] for r in terms_of(templates)})
    seen = files.select(F.array_intersect(_terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, words))).alias("terms"))
    # One row for each template term, and one with the number of files.
    counts = seen.select(F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = {r["term"]: r["df"] for r in counts.collect()}
    total = df.pop("", 0)
    idf = spark.createDataFrame([(w, df.get(w, 0)) for w in words], "term string, df long").select("term", _idf(F.col("df"), F.lit(total)).alias("idf"))
    weighed = rows.join(F.broadcast(idf), "term").select("template", "licence", "term", (F.col("tf") * F.col("idf")).alias("tw"), "idf")
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    return weighed, norms, total


def _reachable(weighed: DataFrame, norms: DataFrame, least: float) -> tuple[list[str], Callable[[Column], Column]]:
    """Words of which every notice has one, and the exact condition on a statement's terms that its cosine can be *least*.

    By Cauchy-Schwarz a cosine is at most the root of the share of the template's squared norm that the shared terms
    hold. Of each template, the lightest terms that stay below that share together need another term beside them.
    """
    reach = max(least - 1e-6, 0.0) ** 2  # scores are rounded
    shares: dict[int, list[tuple[float, str]]] = {}
    for r in weighed.join(norms, "template").select("template", "term", (F.col("tw") * F.col("tw") / (F.col("tnorm") * F.col("tnorm"))).alias("share")).collect():
        shares.setdefault(r["template"], []).append((r["share"], r["term"]))
    needed: set[str] = set()
    for terms in shares.values():
        light = 0.0
        for share, term in sorted(terms):
            light += share
            if light >= reach:
                needed.add(term)
    each = F.array(*[F.create_map(*[F.lit(x) for share, term in terms for x in (term, share)]) for terms in shares.values()])

    def enough(terms: Column) -> Column:
        shared = lambda m: F.aggregate(F.array_distinct(terms), F.lit(0.0), lambda n, t: n + F.coalesce(F.try_element_at(m, t), F.lit(0.0)))
        return F.exists(each, lambda m: shared(m) >= F.lit(reach))

    return sorted(needed), enough


def _term_weights(files: DataFrame, found: DataFrame, total: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """term and idf of all terms of the statements *found*, counted over all files; whether they are few enough to be sent."""
    vocabulary = scratch.cut(found.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    few = vocabulary.count() <= SENT_TERMS
    seen = files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    # Counted in every task before they are dealt out; terms of no statement are left out first if that needs no exchange.
    counts = seen.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term") if few else seen.groupBy("term")
    df = counts.agg(F.count("*").alias("df"))
    if not few:
        df = df.join(vocabulary, "term", "left_semi")
    return scratch.cut(df.select("term", _idf(F.col("df"), F.lit(total)).alias("idf")), "weights"), few


def notices(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """path, body (a hash of the text), words of the file, and its statements that are notices: licence, score, size."""
    scratch = Scratch(files.sparkSession)
    weighed, norms, total = _weights(files, templates)
    lines = F.split(F.regexp_replace("text", r"([.!?])[ \t]+", "$1\n"), "\n")
    needed, enough = _reachable(weighed, norms, least)
    has_needed = lambda terms: F.arrays_overlap(terms, F.array(*map(F.lit, needed)))
    found = files.where(has_needed(_terms(F.col("text")))).select("path", F.xxhash64("text").alias("body"), F.size(_terms(F.col("text"))).alias("words"), F.posexplode(F.transform(lines, _terms)).alias("at", "terms"))
    found = scratch.cut(found.where(has_needed(F.col("terms")) & enough(F.col("terms"))), "statements")
    terms = found.select("path", "body", "at", "words", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    terms = terms.groupBy("path", "body", "at", "words", "size", "term").agg(F.count("*").alias("tf"))
    idf, few = _term_weights(files, found, total, scratch)
    templated = F.broadcast(weighed.select("term", F.lit(True).alias("templated")).distinct())
    scaled = terms.join(F.broadcast(idf) if few else idf, "term").join(templated, "term", "left").withColumn("w", F.col("tf") * F.col("idf"))
    key = ["path", "body", "at"]
    each = F.col("w") * F.col("w")
    norm = scaled.groupBy(*key, "words", "size").agg(F.sqrt(F.sum(each)).alias("norm"), F.collect_list(F.when(F.col("templated"), F.struct("term", "w"))).alias("known"))
    known = norm.select(*key, "words", "size", "norm", F.explode("known").alias("k")).select(*key, "words", "size", "norm", "k.term", "k.w")
    dots = known.join(F.broadcast(weighed.select("template", "licence", "term", "tw")), "term").groupBy(*key, "words", "size", "norm", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scores = dots.join(F.broadcast(norms), "template").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6))
    best = scores.groupBy(*key, "words", "size").agg(F.min(F.struct((-F.col("score")).alias("order"), "template", "licence")).alias("b"))
    return best.select(*key, "words", "size", F.col("b.licence").alias("licence"), (-F.col("b.order")).alias("score")).where(F.col("score") >= least)


def directory(path) -> F.Column:
    """The directory of a path; the root is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licences(files: DataFrame, templates=TEMPLATES, least: float = LEAST, cover: float = COVER) -> DataFrame:
    """path, body, licence, status, score, inherited_from of every row of *files* (path, text), from its whole text.

    status is ``own`` (the best notice in the whole text; ties: the earliest template), ``inherited`` or ``none``.
    A null or empty text has no notice. A null path has no directory and inherits nothing. Rows with equal path and
    text are treated alike, and so is each of several rows with one path. An empty table gives no rows; other columns are
    ignored whatever their names.
    """
    scratch = Scratch(files.sparkSession)
    files = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    said = scratch.cut(notices(files, templates, least), "notices")
    own = said.groupBy("path", "body").agg(F.min(F.struct((-F.col("score")).alias("order"), "at", "licence")).alias("b"), F.sum("size").alias("covered"), F.max("words").alias("words"))
    own = scratch.cut(own.select("path", "body", F.col("b.licence").alias("own"), (-F.col("b.order")).alias("score"), "covered", "words"), "own")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE) | (F.col("covered") >= cover * F.col("words"))
    licensed = own.where(F.col("path").isNotNull() & named).groupBy(directory(F.col("path")).alias("ancestor")).agg(F.min(F.struct((-F.col("score")).alias("order"), "path", F.col("own").alias("licence"))).alias("b"))
    licensed = licensed.select("ancestor", F.col("b.licence").alias("inherited"), F.col("b.path").alias("inherited_from"))
    rows = scratch.cut(files.select("path", F.xxhash64("text").alias("body"), directory(F.col("path")).alias("dir")), "places")
    # Directories, not files, meet their ancestors: a directory is one row however many files it holds.
    folders = scratch.cut(rows.where("path IS NOT NULL").groupBy("dir").agg(F.count("*").alias("n")), "folders")
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = folders.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "ancestor"))
    nearest = above.join(licensed, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "inherited", "inherited_from")).alias("b")).select("dir", "b.inherited", "b.inherited_from")
    nearest = scratch.cut(folders.join(nearest, "dir", "left"), "nearest")
    total = folders.agg(F.sum("n")).first()[0] or 0
    nowhere = rows.where("path IS NULL").select("dir", "path", "body", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("inherited"), F.lit(None).cast("string").alias("inherited_from"))
    rows = hot_join(rows.where("path IS NOT NULL"), nearest, "dir", total).unionByName(nowhere)
    rows = rows.join(own.select(F.col("path").alias("__path"), F.col("body").alias("__body"), "own", "score"), F.col("path").eqNullSafe(F.col("__path")) & (F.col("body") == F.col("__body")), "left")
    status = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return rows.select("path", "body", F.coalesce("own", "inherited").alias("licence"), status.alias("status"), "score", F.when(F.col("own").isNull(), F.col("inherited_from")).alias("inherited_from"))


def document_path(docs: DataFrame) -> F.Column:
    """Where a document would lie as a file: source, language, a folder of 500 consecutive ids."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.expr("CAST(doc_id DIV 500 AS STRING)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_licences(docs.select(document_path(docs).alias("path"), "text"))
    return found.select(F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long").alias("doc_id"), "path", "licence", "status", "score", "inherited_from")


QUERIES = {"op9_licence_scan": op9_licence_scan}

_VALUES = ", ".join(f"({i}, '{name}', '{term}', {n})" for i, name, term, n in terms_of())
ORACLE_SQL = {
    "op9_licence_scan": f"""
WITH templates(template, licence, term, tf) AS (VALUES {_VALUES}),
files AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id // 500 AS VARCHAR), CAST(doc_id AS VARCHAR) || '.txt') AS path FROM documents),
total AS (SELECT count(*)::DOUBLE AS n FROM files),
seen AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) AS term FROM files),
idf AS (
  SELECT term, ln((1 + (SELECT n FROM total)) / (1.0 + coalesce(d.df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM templates) t FULL JOIN (SELECT term, count(*) AS df FROM seen GROUP BY term) d USING (term)),
weighed AS (SELECT template, licence, term, tf * idf AS tw FROM templates JOIN idf USING (term)),
norms AS (SELECT template, sqrt(sum(tw * tw)) AS tnorm FROM weighed GROUP BY template),
lines AS (
  SELECT doc_id, path, words, place, list_filter(string_split_regex(lower(parts[place]), '[^a-z0-9]+'), lambda x: x <> '') AS terms
  FROM (SELECT doc_id, path, words, parts, unnest(range(1, len(parts) + 1)) AS place FROM (
    SELECT doc_id, path, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS words,
           string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS parts
    FROM files WHERE text IS NOT NULL))),
terms AS (
  SELECT doc_id, path, words, place, size, term, count(*) AS tf
  FROM (SELECT doc_id, path, words, place, len(terms) AS size, unnest(terms) AS term FROM lines) GROUP BY ALL),
scaled AS (SELECT t.*, tf * i.idf AS w FROM terms t JOIN idf i USING (term)),
norm AS (SELECT doc_id, place, sqrt(sum(w * w)) AS norm FROM scaled GROUP BY ALL),
scores AS (
  SELECT s.doc_id, s.path, s.words, s.place, s.size, g.template, g.licence, round(sum(s.w * g.tw) / (min(n.norm) * min(m.tnorm)), 6) AS score
  FROM scaled s JOIN weighed g ON s.term = g.term JOIN norm n ON n.doc_id = s.doc_id AND n.place = s.place JOIN norms m ON m.template = g.template
  GROUP BY ALL),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY score DESC, template) = 1),
said AS (SELECT * FROM best WHERE score >= {LEAST}),
own AS (
  SELECT doc_id, path, arg_min(licence, (-score, place)) AS own, max(score) AS score, sum(size) AS covered, max(words) AS words FROM said GROUP BY doc_id, path),
licensed AS (
  SELECT dir, arg_min(own, (-score, path)) AS licence, arg_min(path, (-score, path)) AS source_path
  FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM own WHERE covered >= {COVER} * words) GROUP BY dir)
SELECT f.doc_id, f.path, coalesce(o.own, l.licence) AS licence,
       CASE WHEN o.own IS NOT NULL THEN 'own' WHEN l.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS status,
       o.score, CASE WHEN o.own IS NULL THEN l.source_path END AS inherited_from
FROM files f LEFT JOIN own o ON o.doc_id = f.doc_id LEFT JOIN licensed l ON l.dir = regexp_replace(f.path, '/[^/]*$', '')
"""
}
