"""Anonymization check of one document: what names and numbers in it are not explained.

A text's words are explained by the vocabulary, by an office that makes a name public, or by being part of something
masked; the rest is shown, grouped into entries and people. The rules build on one another in the order of the
document, so each document is one call; documents are spread over the cluster.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.identifiers import PLACEHOLDER, Claims, folded, resolve_people, scan
from lexforge.operators.vocabulary import GERMAN, LINKS, OTHER
from lexforge.session import ship

VISIBLE = ("body", "footnote", "endnote", "header", "footer")
#: Compounds are looked for on lines that are not German too from this many letters.
LONG_COMPOUND = 13
#: The naming of the bench reaches so many characters at most.
BENCH = 700
#: Parts of a compound, at most.
MOST_PARTS = 5


def _any(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


# Words of German, French and Italian prose, by what they say of the word beside them.
SALUTATIONS = "Herr Herrn Frau Monsieur Madame Mme Signor Signora Mr Mrs Ms"
PARTIES = (
    "Kläger Klägerin Beklagte Beklagter Beklagten Beschwerdeführer Beschwerdeführerin Beschwerdegegner Beschwerdegegnerin Gesuchsteller Gesuchstellerin "
    "Beschuldigte Beschuldigter Beschuldigten recourant recourante intimé intimée demandeur demanderesse défendeur défenderesse prévenu prévenue "
    "ricorrente opponente attore attrice convenuto convenuta imputato imputata"
)
DETERMINERS = (
    "der die das dem den des ein eine einer eines einem einen im am zum zur vom beim ins ans kein keine dieser diese dieses jeder jede "
    "le la les du des au aux un une ce cette il lo gli i un uno una del della dello dei alla al nel nella"
)
SHORTENED = "prof dr lic vgl bzw usw abs ziff rz art nr st avv sig mme al ch cpv lit bd hrsg ca resp sog inkl"
ROLES = {
    "court": "Richter Richterin Richterinnen Bundesrichter Bundesrichterin Oberrichter Oberrichterin Gerichtsschreiber Gerichtsschreiberin Präsident Präsidentin Vorsitz "
    "Juge Juges juge juges Greffier Greffière greffier greffière Président Présidente président présidente Giudice Giudici giudice giudici Cancelliere cancelliere",
    "counsel": "Rechtsanwalt Rechtsanwältin Rechtsanwälte Fürsprecher Fürsprecherin Advokat Advokatin avocat avocate Me Maître maître avvocato avvocata avv.",
    "official": "Staatsanwalt Staatsanwältin Procureur Procureure procureur procureure Procuratore procuratore Notar Notarin",
}
BENCH_OPENINGS = "Besetzung Mitwirkend Mitwirkende Composition composition Composizione composizione"
BEFORE_NUMBERS = "Art Abs al cpv lit Ziff ch cifra Nr n° Rz Rn S p E Erw consid SR BGE ATF DTF Bd act Beilage pièce doc § Kap"
UNITS = "% Prozent Fr. CHF EUR USD Franken francs franchi Tage Tagen jours giorni Wochen Monate Monaten mois mesi Jahre Jahren ans anni Stunden heures ore km m m2 m² kg Seiten pages"
EDITIONS = "Aufl éd ed Bd Hrsg Kommentar Commentaire Commentario Handbuch Festschrift"

_WORD = re.compile(r"[^\W\d_]{2,}")
_CODE = re.compile(r"(?<!\w)[\w.'’/-]*\d[\w.'’/-]*")
_TITLE = re.compile(rf"\b(?:{_any(SALUTATIONS)})\.? (?:[A-Z]\. ?)*$")
_PARTY = re.compile(rf"\b(?:{_any(PARTIES + ' ' + SALUTATIONS)})\.? $")
_DETERMINER = re.compile(rf"(?i)\b(?:{_any(DETERMINERS)})\s+$")
_FULL_STOP = re.compile(r"(?:^|\n|[.!?:;«»\"„“(\[])\s*$")
_SHORTENED = re.compile(rf"(?i)\b(?:{_any(SHORTENED)}|[^\W\d_])\.\s*$")
_ROLE = re.compile("|".join(rf"(?P<{role}>(?<!\w)(?:{_any(words)}))" for role, words in ROLES.items()))
_AFTER_ROLE = re.compile(r"(?:\s*:)?\s+")
_BENCH_OPEN = re.compile(rf"\b(?:{_any(BENCH_OPENINGS)})\b")
_BENCH_CLOSE = re.compile(rf"{PLACEHOLDER}|\b(?:{_any(PARTIES)})\b|\n[^\n]*\b(?:Parteien|Verfahrensbeteiligte|Parties|Parti|Objet|Gegenstand)\b")
_RUN = re.compile(r"(?:(?:Dr|Prof|lic|iur)\.? )*((?:[A-Z]\. ?)*[A-ZÄÖÜÉÈ][\w'’-]+(?: (?:von|van|de|di|du|[A-ZÄÖÜÉÈ][\w'’-]+)){0,4})")
_JOIN = re.compile(r"\s*(?:,|;|und|et|e|sowie|ed)\s+")
_CITED = re.compile(r"(?:[(\[;/]|\b(?:vgl|cf)\.|\b(?:siehe|voir|vedi|in:))\s*(?:\w+\s+){0,2}$")
_EDITION = re.compile(rf"\b(?:{_any(EDITIONS)})\b|\b(?:N|Rz|Rn)\.? ?\d")
_FILED = re.compile(r"(?i)\b(?:act|beilage|pièce|doc|allegato)\.? ?\d")
_VERSUS = re.compile(r"\s*(?:c|v|vs|ca)\.\s+")
_REFERENCE = re.compile(rf"(?:{_any(BEFORE_NUMBERS).replace('.', '[.]')})\.?\s*(?:[IVX]+ )?$")
_DOCKET = re.compile(r"\b[A-Z]{1,4} ?\d{2,4} $")
_UNIT = re.compile(rf"\s*(?:{'|'.join(re.escape(u) for u in sorted(UNITS.split(), key=len, reverse=True))})(?!\w)")
_INITIAL = re.compile(r"(?<!\w)[A-Z]\.(?:[A-Z]\.)?(?=[\s,;)])")
# Numbers that explain themselves: dates, amounts, sections, spans, references, file numbers.
_SHAPES = [
    re.compile(p)
    for p in (
        r"\d{1,2}[./]\d{1,2}[./](?:\d\d|\d{4})|\d{4}-\d\d-\d\d",
        r"\d{1,3}(?:['’]\d{3})+(?:\.\d\d)?|\d+\.\d\d",
        r"\d{1,3}(?:\.\d{1,3})+[a-z]?\.?",
        r"\d{1,4}[-–]\d{1,4}",
        r"\d{1,6}(?:/\d{1,6})+|[A-Za-z]+\d*(?:[._/-][A-Za-z0-9]+)+",
        r"\d[A-Z]{1,2}[_.]\d{1,5}/\d{4}",
    )
]
_LANGUAGES = {word: sign for words, sign in ((GERMAN, 1), (OTHER, -1)) for word in words.split("|")}


@dataclass
class Words:
    """The vocabulary: common words, and words with a mark (``!`` not by compound, ``~`` lower case only, ``^`` noun)."""

    common: frozenset[str]
    marks: dict[str, str] = field(default_factory=dict)
    _known: dict[str, bool] = field(default_factory=dict, repr=False)

    def compound(self, word: str) -> bool:
        """Whether the word is common words joined: a first one of three letters or more, others of four, links between."""
        if len(word) < 7:
            return False
        found = self._known.get(word)
        if found is None:
            found = self._joined(word)
            if len(self._known) < 200_000:
                self._known[word] = found
        return found

    def _joined(self, word: str) -> bool:
        # parts[j]: the least number of common words that word[:j] is made of.
        parts = {j: 1 for j in range(3, len(word)) if word[:j] in self.common}
        for end in range(7, len(word) + 1):
            for start in range(3, end - 3):
                if start in parts and parts[start] < parts.get(end, MOST_PARTS + 1) - 1:
                    rest = word[start:end]
                    if any(rest.startswith(link) and len(rest) - len(link) >= 4 and rest[len(link) :] in self.common for link in LINKS):
                        parts[end] = parts[start] + 1
        return len(word) in parts

    def genitive(self, word: str) -> bool:
        """Whether a word looks like a name's genitive: what is left without its s is nothing known."""
        stem = word[:-1]
        return len(word) >= 5 and word.endswith("s") and stem not in self.common and not self.compound(stem)


class Page:
    """The parts of a document as one text, with what is claimed in it."""

    def __init__(self, parts: list[tuple[str, int, str]]):
        texts = [unicodedata.normalize("NFC", t or "") for _, _, t in parts]
        self.kinds = [kind for kind, _, _ in parts]
        self.starts = [0]
        for t in texts[:-1]:
            self.starts.append(self.starts[-1] + len(t) + 2)
        self.text = "\n\n".join(texts)
        self.claims = Claims()
        self._german: dict[int, bool] = {}

    def part(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def visible(self, at: int) -> bool:
        return bool(self.kinds) and self.kinds[self.part(at)] in VISIBLE

    def before(self, at: int, width: int = 40) -> str:
        return self.text[max(0, at - width) : at]

    def german(self, at: int) -> bool:
        """Whether the function words of a line, or of the document where it has none, are German rather than others."""
        start = self.text.rfind("\n", 0, at) + 1
        if start not in self._german:
            end = self.text.find("\n", at)
            said = self._balance(self.text[start : end if end >= 0 else len(self.text)])
            self._german[start] = said >= 0 if said is not None else self._whole()
        return self._german[start]

    @staticmethod
    def _balance(text: str) -> int | None:
        signs = [_LANGUAGES[w] for w in map(str.lower, _WORD.findall(text)) if w in _LANGUAGES]
        return sum(signs) if signs else None

    def _whole(self) -> bool:
        if -1 not in self._german:
            self._german[-1] = (self._balance(self.text) or 0) >= 0
        return self._german[-1]


@dataclass
class Public:
    """Names that offices make public: surnames with the given names beside them, the places, the roles that are masked."""

    given: dict[str, set[str]] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    places: Claims = field(default_factory=Claims)
    masked: set[str] = field(default_factory=set)
    contested: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, page: Page, words: Words) -> Public:
        public = cls()
        found: list[tuple[str, int, str]] = []  # role, place, run of names
        for m in _ROLE.finditer(page.text):
            if page.visible(m.start()) and (gap := _AFTER_ROLE.match(page.text, m.end())):
                if re.match(PLACEHOLDER + r"|[A-Z]\.(?=[ ,;)])", page.text[gap.end() : gap.end() + 40]):
                    public.masked.add(m.lastgroup)
                else:
                    found += [(m.lastgroup, *run) for run in _runs(page.text, gap.end())]
        for m in _BENCH_OPEN.finditer(page.text):
            if page.visible(m.start()):
                found += [("court", *run) for run in _bench(page, m.end())]
        for role, at, run in found:
            names = [n for n in _WORD.finditer(run) if n[0][0].isupper() and n[0].lower() not in words.common]
            if role in public.masked or not names:
                continue  # a role that is masked anywhere makes nobody public
            for n in names:
                public.places.take(at + n.start(), at + n.end())
            surname = names[-1][0].lower()
            public.given.setdefault(surname, set()).update(n[0].lower() for n in names[:-1])
            public.roles[surname] = role
        public._contest(page, words)
        return public

    def _contest(self, page: Page, words: Words) -> None:
        """Surnames that a party bears too, or somebody with another given name."""
        last = None
        for m in _WORD.finditer(page.text):
            name = m[0].lower()
            if name in self.given and m[0][0].isupper() and self.places.free(*m.span()):
                beside = last if last and page.text[last.end() : m.start()] == " " else None
                stranger = beside and beside[0][0].isupper() and beside[0].lower() not in words.common | self.given[name]
                if _PARTY.search(page.before(m.start())) or stranger and not _ROLE.fullmatch(beside[0]):
                    self.contested.add(name)
            last = m

    def explains(self, m: re.Match, following: str) -> bool:
        """Whether a word is a public person's surname, or a given name in front of it."""
        word = m[0].lower()
        if not self.places.free(*m.span()):
            return True
        if word in self.given and word not in self.contested:
            return True
        return following in self.given and following not in self.contested and word in self.given[following]


def _runs(text: str, at: int, most: int = 8) -> Iterator[tuple[int, str]]:
    """Names from *at* on that commas and conjunctions join."""
    for _ in range(most):
        run = _RUN.match(text, at)
        if not run:
            return
        yield run.start(1), run[1]
        joined = _JOIN.match(text, run.end())
        if not joined:
            return
        at = joined.end()


def _bench(page: Page, at: int) -> Iterator[tuple[int, str]]:
    """Names between the words that open the naming of the bench and the first party, within one part."""
    part = page.part(at)
    end = min(at + BENCH, page.starts[part + 1] if part + 1 < len(page.starts) else len(page.text))
    close = _BENCH_CLOSE.search(page.text, at, end)
    end = close.start() if close else end
    for piece in re.finditer(r"[^.,;:()\n]+", page.text[at:end]):
        for m in _RUN.finditer(piece[0]):
            yield at + piece.start() + m.start(1), m[1]


def _named(page: Page, words: Words, m: re.Match, following: str) -> bool:
    """Whether a capitalised word is a name by its marks, its place and the vocabulary."""
    word, low, before = m[0], m[0].lower(), page.before(m.start())
    mark = words.marks.get(low)
    if _TITLE.search(before):
        return True
    if mark == "~":
        sentence = _FULL_STOP.search(before) and not _SHORTENED.search(before)
        return not (sentence or word.isupper() or _DETERMINER.search(before))
    if mark == "^":
        adjective = low.endswith("er") and following in words.common
        return not (adjective or _DETERMINER.search(before))
    if low in words.common:
        return False
    joined = mark != "!" and (page.german(m.start()) or len(low) >= LONG_COMPOUND) and words.compound(low)
    return not joined or words.genitive(low)


def _cited(page: Page, start: int, end: int) -> bool:
    """Whether a name is an author's or stands in the title of a case; exhibits are no literature."""
    if _VERSUS.match(page.text, end):
        return True
    line = page.text[end : end + 180].split("\n")[0].split(";")[0]
    found = _EDITION.search(line) if _CITED.search(page.before(start)) else None
    return bool(found) and not _FILED.search(line[: found.end() + 4])


def _self_explained(page: Page, start: int, code: str) -> bool:
    before = page.before(start, 25)
    few = sum(map(str.isdigit, code)) <= 4
    return few or any(p.fullmatch(code) for p in _SHAPES) or bool(_REFERENCE.search(before) or _DOCKET.search(before) or _UNIT.match(page.text, start + len(code)))


def check(parts: list[tuple[str, int, str]], words: Words) -> dict:
    """anonymized, placeholders, entries, people, ambiguous and counts of a document's parts (kind, index, text)."""
    page = Page(parts)
    counts = Counter(common=0, numbers=0, unassessed=0, public=0)
    shown: list[dict] = []

    def show(kind: str, start: int, text: str, label: str = "") -> None:
        shown.append({"kind": kind, "label": label, "start": start, "end": start + len(text), "text": text})

    masks = list(re.finditer(PLACEHOLDER, page.text))
    for m in masks:
        page.claims.take(*m.span())
    sites = []
    for s in scan(page.text):
        if page.claims.take(s["start"], s["end"]):
            if s["status"] == "public":
                counts["public"] += 1
                sites += [s] if s["label"] == "web" else []
            else:
                show("identifier", s["start"], s["value"], s["label"])

    public = Public.of(page, words)
    found = [m for m in _WORD.finditer(page.text) if page.claims.free(*m.span())]
    usual: list[re.Match] = []  # capitalised words that the list explains
    unknown: list[re.Match] = []  # lower-case words that nothing explains
    for m, after in zip(found, [*found[1:], None], strict=False):
        following = after[0].lower() if after and page.text[m.end() : after.start()] == " " else ""
        low = m[0].lower()
        if m[0][0] != low[0]:
            explained = not _TITLE.search(page.before(m.start())) and public.explains(m, following)
            if low in public.contested and public.places.free(*m.span()):
                named = True
            else:
                named = not explained and _named(page, words, m, following) and not _cited(page, *m.span())
            if named:
                show("word", m.start(), m[0])
            else:
                counts["common"] += 1
                usual.append(m)
        elif low in words.common:
            counts["common"] += 1
        else:
            unknown.append(m)

    stems = {folded(s["text"]) for s in shown if s["kind"] == "word"}
    stem_of = lambda word: next((f[: -len(x)] for x in ("s", "es") if (f := folded(word)).endswith(x) and f[: -len(x)] in stems), None)
    for m in usual:  # a name's inflected form may be a common word
        if stem_of(m[0]) and public.places.free(*m.span()) and m[0].lower() not in public.given:
            counts["common"] -= 1
            show("word", m.start(), m[0])
    islands: list[list[re.Match]] = []
    for m in unknown:
        if folded(m[0]) in stems:
            show("word", m.start(), m[0])
        elif words.compound(m[0].lower()):
            counts["common"] += 1
        elif islands and re.fullmatch(r"[ ‐‑-]", page.text[islands[-1][-1].end() : m.start()]):
            islands[-1].append(m)
        else:
            islands.append([m])
    for run in islands:
        if len(run) > 1:
            for m in run:
                show("word", m.start(), m[0])
        else:
            counts["unassessed"] += 1

    names = {n for n in (folded(s["text"]) for s in shown if s["kind"] == "word") if len(n) >= 4}
    for s in sites:  # the address of a person's own site
        if any(n in folded(s["value"]) for n in names):
            counts["public"] -= 1
            show("identifier", s["start"], s["value"], "profile")

    for m in _CODE.finditer(page.text):
        code = m[0].rstrip(".,'’/-")
        if code and page.claims.free(*m.span()):
            if _self_explained(page, m.start(), code):
                counts["numbers"] += 1
            else:
                show("number", m.start(), code)

    shown.sort(key=lambda s: s["start"])
    known, ambiguous = resolve_people(_mentions(page, shown))
    return {
        "anonymized": len(masks) >= 3 or len(_INITIAL.findall(page.text)) >= 5,
        "placeholders": dict(Counter(re.sub("_{2,}", "________", m[0]) for m in masks)),
        "entries": _entries(page, shown, stem_of),
        "people": [p["name"] for p in known],
        "ambiguous": [p["name"] for p in ambiguous],
        **{k: counts[k] for k in ("common", "numbers", "unassessed", "public")},
        "masked_roles": sorted(public.masked),
    }


def _entries(page: Page, shown: list[dict], stem_of) -> list[dict]:
    """What is shown, by key: identifiers first, then words, then numbers, each in the order of first appearance."""

    def key(s: dict) -> str:
        if s["kind"] == "identifier":
            return f"i:{s['label']}:{re.sub(r'[^0-9a-z]', '', s['text'].lower())}"
        return f"n:{s['text']}" if s["kind"] == "number" else f"w:{stem_of(s['text']) or folded(s['text'])}"

    grouped: dict[str, list[dict]] = {}
    for s in shown:
        grouped.setdefault(key(s), []).append(s)
    order = ("identifier", "word", "number")
    out = []
    for k, found in sorted(grouped.items(), key=lambda kv: (order.index(kv[1][0]["kind"]), kv[1][0]["start"])):
        forms = Counter(s["text"] for s in found)
        hidden = not any(page.visible(s["start"]) for s in found)
        out.append({"key": k, "kind": found[0]["kind"], "label": found[0]["label"], "text": forms.most_common(1)[0][0], "forms": sorted(forms), "n": len(found), "hidden": hidden})
    return out


def _mentions(page: Page, shown: list[dict]) -> list[tuple[int, str, str | None]]:
    """Shown words side by side as names, each with its place and the initial before it."""
    mentions: list[tuple[int, str, str | None]] = []
    end = -1
    for s in shown:
        if s["kind"] != "word":
            continue
        if mentions and page.part(end) == page.part(s["start"]) and page.text[end : s["start"]] in (" ", " ", "-"):
            start, name, initial = mentions[-1]
            mentions[-1] = (start, f"{name} {s['text']}", initial)
        else:
            initial = re.search(r"(?<![\w.])([A-Z])\. ?$", page.before(s["start"], 4))
            mentions.append((s["start"], s["text"], initial[1] if initial else None))
        end = s["end"]
    return mentions


COLUMNS = ("anonymized", "placeholders", "entries", "people", "ambiguous", "common", "numbers", "unassessed", "public", "masked_roles")
SCHEMA = (
    "anonymized boolean, placeholders map<string,int>, entries array<struct<key:string,kind:string,label:string,text:string,forms:array<string>,n:int,hidden:boolean>>, "
    "people array<string>, ambiguous array<string>, common int, numbers int, unassessed int, public int, masked_roles array<string>"
)
#: A vocabulary of so many words is sent to every worker; of a larger one each document gets the part that it can use.
SENT_WORDS = 2_000_000


def vocabulary(rows: DataFrame) -> Words:
    """The vocabulary of (word, mark) rows as one object; :func:`check_with` takes tables of any size."""
    found = [(r["word"], r["mark"] or "") for r in rows.select("word", "mark").toLocalIterator()]
    return Words(frozenset(w for w, m in found if m in ("", "~")), {w: m for w, m in found if m})


def _whole(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("index", "kind", "text"))).alias("parts"))


def _listed(document) -> list[tuple[str, int, str]]:
    return [(p["kind"], p["index"], p["text"]) for p in document]


def check_documents(parts: DataFrame, words: Words) -> DataFrame:
    """id and the result of :func:`check` for documents given as (id, kind, index, text) rows."""
    ship(parts.sparkSession)
    sent = parts.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(SCHEMA)
    def run(documents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check(_listed(d), sent.value) for d in documents], columns=COLUMNS)

    return _whole(parts).select("id", run("parts").alias("r")).select("id", "r.*")


def check_with(parts: DataFrame, rows: DataFrame, sent_words: int = SENT_WORDS) -> DataFrame:
    """As :func:`check_documents`, with a vocabulary table (word, mark) of any size.

    A larger one than *sent_words* is joined: the words of each document, composed as the check reads them, and all their
    pieces from three letters up to the vocabulary's longest word are what the rules may ask for.
    """
    if rows.limit(sent_words + 1).count() <= sent_words:
        return check_documents(parts, vocabulary(rows))
    ship(parts.sparkSession)

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t or ""))

    longest = max(3, rows.agg(F.max(F.length("word"))).first()[0] or 0)
    word = F.col("w")
    ends = lambda i: F.least(F.lit(longest), F.length(word) - i + 1)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.transform(F.sequence(F.lit(3), ends(i)), lambda n: F.substr(word, i, n))))
    asked = parts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(composed("text")), F.lit(r"\p{L}{2,}"), F.lit(0)))).alias("w")).distinct()
    asked = asked.select("id", F.explode(F.when(F.length("w") < 3, F.array("w")).otherwise(pieces)).alias("word")).distinct()
    known = asked.join(rows.select("word", F.coalesce("mark", F.lit("")).alias("mark")), "word").groupBy("id").agg(F.collect_list(F.struct("word", "mark")).alias("known"))

    @F.pandas_udf(SCHEMA)
    def run(documents: pd.Series, known: pd.Series) -> pd.DataFrame:
        found = []
        for d, k in zip(documents, known, strict=True):
            pairs = [] if k is None else [(x["word"], x["mark"]) for x in k]
            found.append(check(_listed(d), Words(frozenset(w for w, m in pairs if m in ("", "~")), {w: m for w, m in pairs if m})))
        return pd.DataFrame(found, columns=COLUMNS)

    return _whole(parts).join(known, "id", "left").select("id", run("parts", "known").alias("r")).select("id", "r.*")
