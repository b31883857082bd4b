"""The check of whole documents, with invented people."""

from lexforge.operators import anonymize, identifiers

WORDS = anonymize.Words(frozenset("der die das klagt gegen und wohnt in am hat ein haus gekauft wein flasche ist frau herr gericht urteil vom rechtsanwalt streit".split()), {"streit": "^", "hofmann": "!"})


def run(*texts, kind="body"):
    return anonymize.check([(kind, i, t) for i, t in enumerate(texts)], WORDS)


def test_names_numbers_and_masks():
    got = run("Anna Muster klagt gegen A.________ und B.________.", "Muster wohnt in der Weinflasche.", "Das Konto 123456789 ist vom Gericht.")
    assert [e["text"] for e in got["entries"] if e["kind"] == "word"] == ["Anna", "Muster", "Konto"]
    assert got["people"][0] == "Anna Muster" and got["placeholders"] == {"A.________": 1, "B.________": 1} and not got["anonymized"]


def test_offices_make_names_public():
    got = run("Der Rechtsanwalt Peter Beispiel hat ein Haus. Beispiel klagt.")
    assert not any(e["text"] == "Beispiel" for e in got["entries"])
    masked = run("Rechtsanwalt A.________ und Rechtsanwalt Peter Beispiel")
    assert masked["masked_roles"] == ["counsel"] and any(e["text"] == "Beispiel" for e in masked["entries"])


def test_marks():
    assert run("der Streit ist")["entries"] == [] and run("und Streit klagt")["entries"][0]["text"] == "Streit"
    assert run("der Hofmann klagt")["entries"][0]["text"] == "Hofmann"


def test_hidden_and_empty():
    assert run("Muster", kind="comment")["entries"][0]["hidden"]
    assert run()["entries"] == [] and run("", None)["entries"] == []


def test_unknown_runs():
    got = run("das qwx zzy ist ein vvt")
    assert [e["text"] for e in got["entries"]] == ["qwx", "zzy"] and got["unassessed"] == 1


def words_of(got):
    return [e["text"] for e in got["entries"] if e["kind"] == "word"]


def test_compounds_by_language_length_and_genitive():
    assert WORDS.compound("weinflasche") and WORDS.compound("weinflaschehaus") and not WORDS.compound("weinflaschen") and not WORDS.compound("haus")
    assert words_of(run("Die Weinflasche ist hoch.")) == [] and "Weinflasche" in words_of(run("le tribunal les Weinflasche est"))
    assert "Hausweinflasche" not in words_of(run("le tribunal les Hausweinflasche est"))
    assert WORDS.genitive("beispiels") and not WORDS.genitive("weinflasches")


def test_public_names_that_a_party_bears_are_shown():
    text = "Rechtsanwalt Peter Beispiel hat ein Haus. {} Beispiel klagt gegen Beispiel."
    assert words_of(run(text.format("Peter"))) == []
    assert words_of(run(text.format("Beschwerdeführer"))).count("Beispiel") == 1
    assert set(words_of(run(text.format("Ursula")))) == {"Ursula", "Beispiel"}


def test_the_bench_is_public_up_to_the_parties():
    got = run("Besetzung Oberrichter Hans Kunz, Vorsitz, Lena Ott-Frei, Gerichtsschreiberin Mia Roth.\nParteien\nUrs Frei gegen A.________\nKunz und Roth")
    assert set(words_of(got)) == {"Besetzung", "Parteien", "Urs", "Frei"}  # the tiny vocabulary has no headings


def test_common_words_that_inflect_a_shown_name_are_shown():
    words = anonymize.Words(WORDS.common | {"kellers", "haus"}, WORDS.marks)
    got = anonymize.check([("body", 0, "Frau Keller wohnt in Kellers Haus.")], words)
    assert [(e["text"], e["n"], e["forms"]) for e in got["entries"]] == [("Keller", 2, ["Keller", "Kellers"])]


def test_sites_with_a_shown_name_are_profiles():
    got = run("Anna Muster hat www.anna-muster.ch und www.gericht.ch")
    assert [(e["label"], e["text"]) for e in got["entries"] if e["kind"] == "identifier"] == [("profile", "www.anna-muster.ch")] and got["public"] == 1


def test_literature_and_exhibits():
    assert "Muster" not in words_of(run("das ist ein Streit (Muster, Kommentar, 3. Aufl. 2010)"))
    assert "Muster" in words_of(run("das Urteil (Muster, act. 12 Kommentar)"))


def test_a_vocabulary_that_is_joined_gives_the_same(spark):
    long = "a" * 300 + "weinflasche" + "b" * 300
    parts = [(1, "body", 0, "Anna Muster klagt gegen das Gericht."), (1, "body", 1, "Der Hofmann hat eine Weinflasche."), (2, "body", 0, None), (3, "body", 0, f"Das Gericht {long} Weinflasche"), (4, "body", 0, "Das Gera\u0308t im Geba\u0308ude klagt. Frau Mu\u0308nzer.")]
    docs = spark.createDataFrame(parts, "id long, kind string, index int, text string")
    rows = spark.createDataFrame([(w, "") for w in [*WORDS.common, "gerät", "gebäude", "münzer"]] + list(WORDS.marks.items()), "word string, mark string")
    sent, joined = (sorted(anonymize.check_with(docs, rows, **limit).collect()) for limit in ({}, {"sent_words": 3}))
    assert sent == joined and len(sent) == 4


def test_the_filter_before_the_scan_loses_no_digits(spark):
    texts = ["Parzelle Nr. １２３", "Parzelle Nr. 123", "Parzelle Nr. ١٢٣", "keine Zahl"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = sorted((i, s["start"], s["end"]) for i, t in enumerate(texts) for s in identifiers.scan(t))
    assert sorted((r.id, r.start, r.end) for r in identifiers.identifiers(docs).collect()) == want and {i for i, *_ in want} >= {0, 1}
