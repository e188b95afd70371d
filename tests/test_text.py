"""Exact examples for the text functions; each table is one DataFrame."""

from shelfmark.functions import text as X
from shelfmark.schemas import NAMES


def evaluate(spark, schema, inputs, column):
    data = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(data, f"n int, {schema}")
    return [r[0] for r in df.orderBy("n").select(column).collect()]


FORMATTED = {
    "MasłoEkstra200g": "masło ekstra 200 g",
    "wodaGaz15L": "woda gaz 15 l",
    "HTMLPage": "html page",
    "ABCDefGhi": "abc def ghi",
    "SOKJabłkowy": "sok jabłkowy",
    "SerŻółty": "ser żółty",
    "kg5g10": "kg 5 g 10",
    "a1b2": "a 1 b 2",
    "jajka;10,szt": "jajka 10 szt",
    ",;,": "",
    "ALLCAPS": "allcaps",
    "mixedUPPER": "mixed upper",
    "  wide   gaps\t here ": "wide gaps here",
    "nbsp gap em": "nbsp gap em",
    "7": "7",
    "x": "x",
    "1.5l;Sok": "1.5 l sok",
    "cześćĄĘ": "cześć ąę",
    "caféBar": "cafébar",
    "O'NeilBrew!": "o'neil brew!",
    "[a]{b}|c": "[a]{b}|c",
    "piwo٣Pak": "piwo ٣ pak",
    "": "",
    None: "",
    " \t\n ": "",
}


def test_format_query(spark):
    got = evaluate(spark, "s string", list(FORMATTED), X.format_query("s"))
    assert dict(zip(FORMATTED, got)) == FORMATTED


def names(*pairs):
    return [{"lang": lang, "text": text} for lang, text in pairs]


def test_product_names(spark):
    cases = [
        (names(("main", "Dżem"), ("en", "Jam"), ("de", "Dżem")), ["Dżem", "Jam"]),
        (names(("main", ""), ("pl", None), ("en", " ")), [" "]),
        ([], []),
        (None, []),
    ]
    schema = f"p {NAMES.simpleString()}"
    got = evaluate(spark, schema, [(c,) for c, _ in cases], X.product_names("p"))
    assert got == [want for _, want in cases]


# Validity is a name with content and a category that is plain or in the catalog's
# language; each state of one is crossed with each state of the other.
NAME_STATES = {
    "absent": (None, False),
    "no entries": ([], False),
    "only blank": (names(("main", " "), ("pl", "\t"), ("es", None)), False),
    "one of three": (names(("main", ""), ("es", "Aceite"), ("pl", None)), True),
    "without language": (names((None, "Olej")), True),
}
CATEGORY_STATES = {
    "absent": (None, False),
    "empty": ("", False),
    "separators": (",, ,", False),
    "foreign": ("es:aceites,it:oli", False),
    "plain": ("Oils", True),
    "plain after foreign": ("es:aceites,Oils", True),
    "own language": ("it:oli,pl:oleje", True),
    "own language in capitals": ("PL:oleje", True),
    "own language without a name": ("it:oli,pl: ", False),
}


def test_is_valid_product(spark):
    schema = f"product_name {NAMES.simpleString()}, categories string"
    grid = [(n, c) for n in NAME_STATES.values() for c in CATEGORY_STATES.values()]
    got = evaluate(spark, schema, [(n[0], c[0]) for n, c in grid], X.is_valid_product())
    assert got == [n[1] and c[1] for n, c in grid]


def given(categories, entries):
    """The rule in plain Python: the last usable category, else the main name, else any."""
    for c in reversed(categories):
        if ":" not in c:
            return c
        if c.lower().startswith("pl:") and c[3:]:
            return c[3:]
    main = [e["text"] for e in entries if e["lang"] == "main" and e["text"]]
    return (main or [e["text"] for e in entries if e["text"]] or [""])[0]


def test_given_name(spark):
    last = ["", "es:aceites", "pl:oleje", "PL:oleje", "pl:", "pl: z oliwek", "Oils"]
    categories = [",".join(filter(None, (first, c))) for first in ("Groceries", "it:oli", "") for c in last]
    entries = [[], names(("es", "Aceite")), names(("es", "Aceite"), ("main", "Olej")), names(("main", ""), ("it", "Olio"))]
    rows = [(c, e) for c in categories for e in entries]
    want = [given([x.strip() for x in c.split(",") if x.strip()], e) for c, e in rows]
    schema = f"c string, p {NAMES.simpleString()}"
    for listed in (X.split_list("c"), X.list_items("c")):
        assert evaluate(spark, schema, rows, X.given_name(listed, "p")) == want


def test_lists(spark):
    inputs = ["a, b ,,c,", "", None, " , "]
    assert evaluate(spark, "s string", inputs, X.split_list("s")) == [
        ["a", "b", "", "c", ""],
        [],
        [],
        ["", ""],
    ]
    assert evaluate(spark, "s string", inputs, X.list_items("s")) == [["a", "b", "c"], [], [], []]


def test_search_text(spark):
    schema = f"product_name {NAMES.simpleString()}, quantity string, brands string, categories string, labels string"
    rows = [
        (names(("main", "Jam"), ("pl", "Dżem")), "1 kg", "Łowicz, X", "Food,Jams", None),
        (names(("main", " ")), "", None, "A", "B,C"),
    ]
    assert evaluate(spark, schema, rows, X.search_text()) == [
        "jam dżem 1 kg łowicz  x food jams",
        "  a b c",
    ]


def test_clean_tag_and_tokens(spark):
    tags = ["en:dark-chocolate", "xyz:a-b", "EN:a", "plain"]
    assert evaluate(spark, "s string", tags, X.clean_tag("s")) == [
        "dark chocolate",
        "xyz:a b",
        "EN:a",
        "plain",
    ]
    texts = ["Twaróg TŁU-sty 500g", "", None, "---"]
    assert evaluate(spark, "s string", texts, X.tokens("s")) == [
        ["twarog", "tlu", "sty", "500g"],
        [],
        [],
        [],
    ]


def test_strip_is_unicode(spark):
    chars = X.K.WHITESPACE
    got = evaluate(spark, "s string", [chars + "a b" + chars, chars], X.strip("s"))
    assert got == ["a b", ""]
