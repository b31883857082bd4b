"""Common words of a corpus: statistics, decisions, marks, compounds, holdout, language of lines."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import Scratch, ship

# Words that announce a person, as they stand before a name.
TITLES = ("Herr", "Herrn", "Frau", "Monsieur", "Madame", "Signor", "Signora", "Mr", "Mrs", "Ms", "Dr.", "Me", "Rechtsanwalt", "Rechtsanwältin", "avocat", "avocate")
# Titles, salutations and offices that make the word behind them a name, as patterns.
TITLE_FORMS = (
    "Herrn?", "Frau", "Monsieur", "Madame", "Mme", "M\\.", "Me", "Dr\\.", "Prof\\.", "Signor[ae]?", "Sig\\.", "Sig\\.ra", "avv\\.", "Mr\\.?", "Mrs\\.?", "Ms\\.?", "Miss", "Judge",
    "Rechtsanw[äa]lt(?:in)?", "F[üu]rsprecher(?:in)?", "Advokat(?:in)?", "Bundesrichter(?:in)?", "Oberrichter(?:in)?", "Richter(?:in)?", "Gerichtsschreiber(?:in)?",
    "Präsident(?:in)?", "juge", "greffi(?:er|ère)", "procureur", "giudice", "cancelliere", "Staatsanw[äa]lt(?:in)?",
)
#: A title counts if it begins at most so many characters before the word, with nothing but white space between.
TITLE_REACH = 40
# Offices that context alone does not make names.
OFFICES = ("präsident", "präsidentin", "richter", "richterin", "direktor", "direktorin", "notar", "président", "juge", "giudice", "judge")
# Letters that join the parts of a compound.
LINKS = ("", "s", "es", "n", "en", "er", "e")
SOFT_HYPHEN = "­"
# Function words that tell German from the other languages.
GERMAN = "der|die|das|und|ist|nicht|mit|von|zu|den|dem|ein|eine|auf|für|im|des|sich|als|auch"
OTHER = "le|la|les|et|est|des|du|une|que|qui|dans|par|pour|il|di|che|non|the|of|and|to|in|is"


@dataclass(frozen=True)
class Rules:
    """Limits of the decision which words are common."""

    min_docs: int = 5
    min_courts: int = 2
    or_docs: int = 30
    named: float = 0.25
    ratio: float = 100.0
    name_context: float = 0.1
    unknown_min_docs: int = 2000
    unknown_word_docs: int = 100
    unknown_word_courts: int = 10
    noun_docs: int = 500


def dehyphenated(text: Column) -> Column:
    """Text without soft hyphens and line-end hyphens, and with mail and web addresses blanked."""
    joined = F.regexp_replace(text, f"{SOFT_HYPHEN}|-[ \t]*\r?\n(?=[a-zäöüéèàç])", "")
    return F.regexp_replace(joined, r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|https?://[^ \n]+|www[.][^ \n]+", " ")


def admitted(docs: DataFrame, holdout: int = 0, least: int = 300) -> DataFrame:
    """Rows (id, court, text) whose text is long enough and not held out."""
    return docs.where((F.length("text") >= least) & ~held_out(F.col("id"), holdout))


def held_out(identity: Column, n: int) -> Column:
    """Whether the MD5 of an id, read as a number, is divisible by *n*; never if n is 0."""
    if n <= 0:
        return F.lit(False)
    digits = F.md5(F.coalesce(identity.cast("string"), F.lit("")).cast("binary"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0).cast("long"), lambda a, i: (a * 16 + F.conv(F.substr(digits, i, F.lit(1)), 16, 10).cast("long")) % n) == 0


def word_rows(docs: DataFrame) -> DataFrame:
    """id, court, word (lower case), cap, upper, lead, context of every word of two letters or more.

    A text is cut before every word, so a piece holds a word and what follows it. *lead* is the capitalised word in front
    if exactly one space lies between; *context* is what stands before the word, up to ``TITLE_REACH`` characters of the
    two pieces in front.
    """
    begin, end = "\x01", "\x02"
    bare = F.translate(F.col("text"), begin + end, "  ")
    split = docs.select("id", "court", F.split(F.regexp_replace(bare, r"\p{L}{2,}", f"{begin}$0{end}"), begin).alias("ps"))
    none = F.array(F.lit(None).cast("string"))
    zipped = F.arrays_zip(F.col("ps").alias("piece"), F.concat(none, "ps").alias("one"), F.concat(none, none, "ps").alias("two"))
    pieces = split.select("id", "court", F.explode(zipped).alias("p")).select("id", "court", "p.*").where(F.col("piece").contains(end))
    token = F.substring_index("piece", end, 1)
    rows = pieces.select("id", "court", token.alias("token"), F.lower(token).alias("word"), "one", F.concat(F.coalesce("two", F.lit("")), F.col("one")).alias("before"))
    lead = F.when(F.col("one").rlike(rf"^\p{{Lu}}\p{{L}}+{end} $"), F.lower(F.substring_index("one", end, 1)))
    first = F.substring("token", 1, 1)
    context = F.right(F.translate("before", end, ""), F.lit(TITLE_REACH))
    return rows.select("id", "court", "word", (first != F.lower(first)).alias("cap"), (F.col("token") == F.upper("token")).alias("upper"), lead.alias("lead"), context.alias("context"))


#: Entries that a task counts before it hands its counts on.
COUNTED = 500_000
_TOLD = "word string, court string, id string, lead string, docs long, cap long, low long, upper long, titled long, firsted long"


#: Runs of two letters or more, as a group of their own, in a text without numbers that are no digits.
_LETTERS = re.compile(r"([^\W\d_]{2,})")


@cache
def _no_letters() -> dict[int, str]:
    """What the pattern takes for a letter and is none, and the marks of :func:`word_rows`, with what stands for it."""
    other = {c: "*" for c in range(128, sys.maxunicode + 1) if chr(c).isalnum() and unicodedata.category(chr(c)) in ("No", "Nl")}
    return other | {1: " ", 2: " "}


def _split(text: str) -> list[str]:
    """What stands between the words of a text, and the words, in turn."""
    some = _no_letters()
    return _LETTERS.split(text.translate(some) if any(ord(c) in some for c in set(text)) else text)


_WHITE = frozenset(" \t\n\v\f\r")
_TITLED = re.compile(rf"(?:{'|'.join(TITLE_FORMS)})[ \t-\r]+$")


def counted_words(text: str) -> tuple[Counter, Counter, Counter]:
    """Of a text: how often each word stands as it is written, each titled one, and each (word, lead) that is capitalised and untitled."""
    parts = _split(text)
    tokens, titled, led = parts[1::2], Counter(), Counter()
    counts = Counter(tokens)
    capital = {t for t in counts if t[0] != t[0].lower()}
    for i in [i for i, t in enumerate(tokens) if t in capital]:
        token, gap = tokens[i], parts[2 * i]
        if gap[-1:] not in _WHITE:
            continue
        before = "".join(parts[max(0, 2 * i - 3 if i > 1 else 0) : 2 * i + 1])[-TITLE_REACH:]
        if _TITLED.search(before):
            titled[token] += 1
        elif i and gap == " " and unicodedata.category(tokens[i - 1][0]) == "Lu":
            led[token.lower(), tokens[i - 1].lower()] += 1
    return counts, titled, led


def _told(docs: DataFrame) -> DataFrame:
    """Counts of words by court (and id, where *docs* keeps it because it repeats), and of words by lead, summed up in every task."""
    ship(docs.sparkSession)
    schema = pa.schema([(n.split()[0], pa.string() if n.endswith("string") else pa.int64()) for n in _TOLD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[str, list[int]]] = {}
        pairs: Counter = Counter()
        forms: dict[str, tuple[str, bool, bool]] = {}

        def batch_of(columns: dict[str, list], n: int) -> pa.RecordBatch:
            given = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
            return pa.RecordBatch.from_arrays(given, schema=schema)

        def told() -> Iterator[pa.RecordBatch]:
            for (court, identity), words in sums.items():
                numbers = zip(("docs", "cap", "low", "upper", "titled"), zip(*words.values(), strict=True), strict=True) if words else ()
                yield batch_of({"word": list(words), "court": [court] * len(words), "id": [identity] * len(words)} | dict(numbers), len(words))
            yield batch_of({"word": [w for w, _ in pairs], "lead": [x for _, x in pairs], "firsted": list(pairs.values())}, len(pairs))
            sums.clear()
            pairs.clear()
            forms.clear()

        entries = 0
        for batch in batches:
            for identity, court, text in zip(*(batch.column(n).to_pylist() for n in ("id", "court", "text")), strict=True):
                tokens, titled, led = counted_words(text)
                words, seen = sums.setdefault((court, identity), {}), set()
                size = len(words)
                for token, n in tokens.items():
                    form = forms.get(token)
                    if form is None:
                        form = forms[token] = (token.lower(), token[0] != token[0].lower(), token == token.upper())
                    word, cap, upper = form
                    row = words.get(word)
                    if row is None:
                        row = words[word] = [0, 0, 0, 0, 0]
                    if word not in seen:
                        seen.add(word)
                        row[0] += 1
                    if cap:
                        row[1] += n
                        if upper:
                            row[3] += n
                    else:
                        row[2] += n
                for token, n in titled.items():
                    words[forms[token][0]][4] += n
                pairs.update(led)
                entries += len(words) - size
                if entries + len(pairs) + len(forms) > COUNTED:
                    yield from told()
                    entries = 0
        yield from told()

    return docs.select("id", "court", "text").mapInArrow(run, _TOLD)


def word_statistics(docs: DataFrame, first_names: DataFrame) -> DataFrame:
    """word, docs, courts, cap, low, upper, titled, firsted over the admitted rows of *docs* (id, court, text).

    A capitalised word is titled if a title stands close before it, else firsted if a capitalised first name does. Words
    are counted in every task before they are dealt out, so that what is dealt out are sums by word and court and by word
    and lead. Only rows of an id that repeats keep it, as they make one document; a null id is one document.
    """
    names = first_names.select(F.col("name").alias("__first")).distinct()
    again = docs.groupBy("court", "id").count().where("count > 1").select(F.col("court").alias("__court"), F.col("id").alias("__id"))
    same = F.col("court").eqNullSafe(F.col("__court")) & F.col("id").eqNullSafe(F.col("__id"))
    kept = F.when(F.col("__again"), F.concat(F.lit("="), F.coalesce(F.col("id").cast("string"), F.lit("\0"))))
    rows = docs.join(again.withColumn("__again", F.lit(True)), same, "left").select(kept.alias("id"), "court", "text")
    told = Scratch(docs.sparkSession).cut(_told(rows), "counts")  # counted once, read twice
    counts = ["cap", "low", "upper", "titled"]
    # An id that repeats is one document, however many rows it has.
    per = told.where("lead IS NULL").groupBy("word", "court", "id").agg(F.sum("docs").alias("docs"), *[F.sum(n).alias(n) for n in counts])
    per = per.groupBy("word", "court").agg(F.sum(F.when(F.col("id").isNull(), F.col("docs")).otherwise(1)).alias("docs"), *[F.sum(n).alias(n) for n in counts])
    base = per.groupBy("word").agg(F.sum("docs").alias("docs"), F.count("court").alias("courts"), *[F.sum(n).alias(n) for n in counts])
    led = told.where("lead IS NOT NULL").groupBy("word", "lead").agg(F.sum("firsted").alias("n"))
    led = led.join(names, F.col("lead") == F.col("__first"), "left_semi").groupBy("word").agg(F.sum("n").alias("firsted"))
    return base.join(led, "word", "left").select("word", "docs", "courts", *counts, F.coalesce("firsted", F.lit(0).cast("long")).alias("firsted"))


def name_bearers(names: DataFrame) -> DataFrame:
    """part, bearers, given of names (name, bearers, given): sums over the parts of double names, particles left out."""
    part = names.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("part"), "bearers", "given")
    return part.where(~F.col("part").isin("von", "van", "de", "da", "di", "del", "della", "du", "des", "der", "le", "la", "zur", "zum")).groupBy("part").agg(F.sum("bearers").alias("bearers"), F.sum(F.when(F.col("given"), F.col("bearers")).otherwise(0)).alias("given"))


def decide(stats: DataFrame, names: DataFrame, residents: int, total_docs: int, rules: Rules = Rules()) -> DataFrame:
    """word, verdict, mark of the words that are frequent enough.

    *names* is (part, bearers). Verdicts: acronym, name_by_context (dropped), word, name_as_word, noun_name (dropped,
    mark ^) and name (dropped); mark ~ is a name that is ordinary in lower case only.
    """
    r = rules
    rows = stats.where((F.col("docs") >= r.min_docs) & ((F.col("courts") >= r.min_courts) | (F.col("docs") >= r.or_docs)))
    # The word and its stems meet the names in one join, as rows of their own.
    stem = lambda s: F.when(F.col("word").endswith(s), F.expr(f"substring(word, 1, length(word) - {len(s)})"))
    stems = rows.select("word", F.posexplode(F.array(F.col("word"), stem("s"), stem("es"), stem("in"))).alias("nth", "part")).where("part IS NOT NULL")
    met = stems.join(names.select("part", F.col("bearers").alias("b")), "part")
    best = F.min(F.when(F.col("nth") > 0, F.struct("nth", "b")))
    met = met.groupBy("word").agg(F.max(F.when(F.col("nth") == 0, F.col("b"))).alias("__b0"), F.bool_or(F.col("nth") == 0).alias("__listed"), best.alias("__stem"))
    rows = rows.join(met, "word", "left")
    listed, is_name = F.coalesce("__listed", F.lit(False)), F.col("__listed").isNotNull()
    inflected = F.col("__stem.b")
    people = F.when(F.coalesce("__b0", F.lit(0)) > 0, F.col("__b0")).otherwise(F.coalesce(inflected, F.lit(0)))
    marked = F.col("titled") + F.col("firsted")
    caps = F.greatest(F.lit(1), F.col("cap"))
    used_lower = F.col("low") >= F.col("cap")
    ratio = F.when(people > 0, (F.col("docs") / F.lit(float(total_docs))) / (people / F.lit(float(residents)))).otherwise(F.lit(float("inf")))
    never = (F.col("docs") >= r.unknown_word_docs) & (F.col("courts") >= r.unknown_word_courts) & (marked < 0.01 * caps)
    acronym = (F.col("upper") * 2 >= F.col("cap")) & (F.col("cap") >= 5) & (F.length("word") <= 6) & ~listed
    context = ~F.col("word").isin(*OFFICES) & (marked >= r.named * caps) & (F.col("low") < F.col("cap")) & (F.col("cap") >= 5)
    unknown = (people == 0) & (F.col("docs") < r.unknown_min_docs) & ~used_lower & ~never
    ordinary = used_lower | ((ratio >= r.ratio) & (marked / caps < r.name_context))
    noun = (F.col("docs") >= r.noun_docs) & (marked / caps < 0.05) & (F.col("low") * 10 < F.col("cap"))
    verdict = F.when(acronym, "acronym").when(context, "name_by_context").when(~is_name, "word").when(unknown, "name").when(ordinary, "name_as_word").when(noun, "noun_name").otherwise("name")
    rows = rows.withColumn("verdict", verdict)
    mark = F.when(F.col("verdict") == "noun_name", "^").when((F.col("verdict") == "name_as_word") & (F.col("cap") * 10 <= F.col("low")), "~").otherwise("")
    return rows.select("word", "verdict", mark.alias("mark"))


def compound_of_two(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, head, link, tail: words that are two words of the lexicon (head 3 letters or more, tail 4) with a link."""
    split = words.where(F.length("word") >= 7).select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 4)).alias("i"))
    split = split.select("word", F.expr("substring(word, 1, i)").alias("head"), F.expr("substring(word, i + 1)").alias("tail"))
    tails = split.join(lexicon.select(F.col("word").alias("tail")), "tail", "left_semi")
    linked = tails.select("word", "tail", F.col("head").alias("whole"), F.explode(F.array(*map(F.lit, LINKS))).alias("link")).where("endswith(whole, link)")
    heads = linked.withColumn("head", F.expr("substring(whole, 1, length(whole) - length(link))")).where(F.length("head") >= 3)
    return heads.join(lexicon.select(F.col("word").alias("head")), "head", "left_semi").select("word", "head", "link", "tail").distinct()


def compounds(words: DataFrame, lexicon: DataFrame, depth: int = 3) -> DataFrame:
    """Words that are two or more words of the lexicon joined: heads may be compounds themselves, to *depth* levels."""
    found = compound_of_two(words, lexicon).select("word").distinct()
    heads = words.select("word", F.col("word").alias("rest"))
    for _ in range(depth):
        # Strip one listed tail (and link); what is left must be a compound of two.
        split = heads.where(F.length("rest") >= 11).select("word", F.col("rest").alias("r"), F.explode(F.sequence(F.lit(3), F.length("rest") - 4)).alias("i"))
        split = split.select("word", F.expr("substring(r, 1, i)").alias("whole"), F.expr("substring(r, i + 1)").alias("tail")).join(lexicon.select(F.col("word").alias("tail")), "tail", "left_semi")
        heads = split.select("word", "whole", F.explode(F.array(*map(F.lit, LINKS))).alias("link")).where("endswith(whole, link)").select("word", F.expr("substring(whole, 1, length(whole) - length(link))").alias("rest")).where(F.length("rest") >= 7).distinct()
        two = compound_of_two(heads.select(F.col("rest").alias("word")).distinct(), lexicon).select(F.col("word").alias("rest")).distinct()
        found = found.unionByName(heads.join(two, "rest", "left_semi").select("word")).distinct()
    return found


def language_of_lines(docs: DataFrame) -> DataFrame:
    """id, line, german: by function words of the line; a line without any takes the document's language."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    count = lambda words: F.regexp_count(F.lower("t"), F.lit(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")).cast("long")
    lines = lines.select("id", F.col("line").cast("long").alias("line"), count(GERMAN).alias("de"), count(OTHER).alias("other"))
    w = Window.partitionBy("id")
    whole = F.sum("de").over(w) >= F.sum("other").over(w)
    return lines.select("id", "line", "de", "other", F.when(F.col("de") + F.col("other") > 0, F.col("de") >= F.col("other")).otherwise(whole).alias("german"))


def unknown_runs(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, run, first, n: islands of neighbouring lower-case words that the lexicon does not have."""
    pieces = docs.select("id", F.posexplode(F.split("text", "[ \n]")).alias("at", "piece"))
    words = pieces.where(F.col("piece").rlike(r"^\p{Ll}{2,}$"))
    unknown = words.join(lexicon.select(F.col("word").alias("piece")), "piece", "left_anti")
    by_doc = Window.partitionBy("id").orderBy("at")
    marked = unknown.withColumn("new", F.when(F.col("at") - F.lag("at").over(by_doc) == 1, 0).otherwise(1))
    run = marked.withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("id", "run").agg(F.min("at").cast("long").alias("first"), F.count("*").alias("n"))


def given_name_runs(docs: DataFrame, given: DataFrame, most: int = 3) -> DataFrame:
    """id, first, n, surname: given names in a row before a capitalised word, *most* at most; titles are skipped.

    Positions count from 0 over the words without titles. Only the given names reach the window.
    """
    words = F.filter(F.split(F.translate("text", "\n", " "), " "), lambda w: ~w.isin(*TITLES))
    pairs = docs.select("id", words.alias("w")).select("id", F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.size("w")).alias("after"))).alias("at", "p"))
    capital = r"^\p{Lu}\p{L}+$"
    named = pairs.select("id", "at", F.col("p.word").alias("word"), F.coalesce("p.after", F.lit("")).alias("after")).where(F.col("word").rlike(capital))
    named = named.withColumn("name", F.lower("word")).join(given.select("name"), "name", "left_semi")
    runs = named.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("id").orderBy("at")))
    found = runs.groupBy("id", "run").agg(F.min("at").cast("long").alias("first"), F.least(F.count("*"), F.lit(most)).cast("long").alias("n"), F.max_by("after", "at").alias("surname"))
    return found.where(F.col("surname").rlike(capital)).select("id", "first", "n", "surname")
