from __future__ import annotations

import random
import re
from re import _parser

import pytest

from indexloom.llm import residue as module
from indexloom.llm.cues import cues_of, prefilter
from indexloom.llm.residue import BITS, flags_of, lines_of, normalised, residue

S = "doc_id long, text string, source string, k int, h string, x int"


def bits(line):
    return flags_of(line, normalised(line))


@pytest.mark.parametrize(
    "line",
    ["Dear {{ client.name | upper }},", "Rule book, ${month} edition", "From [ISSUER NAME] to [[float_pct]]", "a %%CCY%% b", "pays __amount__ per share", "on ______ the board", "am <w:fld DATE/> verlor",
     "of &lt;issuer_name&gt; was", "<TBC: date>", "the level of «indexTitle»", "losing {0} today", "at a price of [●] on", "[please add company name]", "[hier Betrag einfügen]", "loss of %.2f per %s", "zero on #REF! and", "of [object Object] is",
     "receive undefined new shares", "with ex-date NaN.", "review None companies join", "on XX/XX/20XX and", "TODO write notice text", "<!-- BODY -->", "at @@time@@ today", "<?= header ?>", "The free float of [[companyName]] moves to 3% after a pension fund reported its stake.", "(R-12) TODO write notice text", "Avis (à compléter)", "Das Kürzel (noch einzutragen) geht am 16.", "pagará (por completar) SEK", "détaché le [EX DATE]"],
)
def test_placeholders_in_any_notation(line):
    assert bits(line) & BITS["placeholder"]


@pytest.mark.parametrize(
    "line, reason",
    [("Dolor sit amet consectetur adipiscing elit", "filler"), ("bla bla bla bla bla bla bla", "filler"), ("Sample text, to be replaced before release.", "filler"), ("Ceci est un faux texte pour la mise en page.", "filler"),
     ("Please enable JavaScript to view this announcement.", "script"), ("Los scripts están desactivados en su navegador.", "script"), ("Diese Seite benötigt JavaScript und Cookies.", "script"), ("<noscript Turn on JavaScript and reload.", "script"),
     ("Coming soon.", "filler"), ("Your headline here.", "filler"), ("-- no text entered --", "filler"), ("Überschrift eingeben.", "filler"), ("Escriba aquí el titular.", "filler"), ("Votre titre ici.", "filler"), ("Korea, 11 January 2021 - Content for this tab has not been added yet.", "filler"), ("Click to edit this paragraph.", "filler"), ("This section is under construction.", "filler"), ("foo bar foo bar foo bar foo bar foo bar.", "filler"), ("500 Internal server error", "error"), ("404 Page not found", "error"), ('{"status": 404, "error": "The page you asked for does not exist", "trace": "1c"}', "error"), ("The page you asked for does not exist", "error"), ("(IX-190) Draft shell: title, lead, table, footer.", "filler"), ("US, 3 May 2024 - [this page intentionally holds sample data]", "filler"), ("Access denied Please try again in a few minutes.", "error"), ("ACCESS DENIED", "error"), ("Votre session a expiré", "error"), ('{"status": 503, "error": "Service unavailable"}', "error"),
     ("    at notices.load(Feed:754)", "error"), ("sql.DataAccessError: payload missing", "error"), ("Menu Search Login 503 Service unavailable", "error"), ("Error 500: Se ha producido un error", "error")],
)
def test_messages(line, reason):
    assert bits(line) & BITS[reason]


@pytest.mark.parametrize(
    "line",
    ["A client asked whether the capacity page needs JavaScript; the file download does not.", "The template marks open fields with %%NAME%% so that reviewers find them; all 12 were filled.", "In the data dictionary, null means not reported and NaN means not computable.",
     "We replaced the marker [●] in the term sheet by the final price of USD 2.14 before release.", "The undefined case, a divisor of zero, cannot occur while one member has a price.", "Too many requests for the same file came from one client, and we asked them to cache it.",
     'For 12 minutes clients saw "service unavailable" on the factsheet page.', "The layout team had left lorem ipsum in the Spring factsheet mock-up, which was never published.", "Der Blindtext im Entwurf wurde vor der Veröffentlichung am 3. Mai 2024 ersetzt.",
     "Members of the set {A, B, C} in the example have weights w(1) to w(3).", "Section [36.2] applies.", "Tracking error to the parent index was 1.0% over 33 months.", "El término «divisor» se define en el capítulo 24.", "Shares of Lamo Ltd (FTNN) were suspended", "Net income  n/a  n.m.  5.8", ""],
)
def test_authored_text_is_no_evidence(line):
    assert not bits(line) & (BITS["weak"] - 1)


@pytest.mark.parametrize(
    "line",
    ['"Sponsor" means the {{sponsor_name}}.', "Trading day means the day on which {{exchange}} is open.", "CCY stands for ${currency}.", "We replaced the auditor by {{auditor}} on 3 May.", "Contact the open fields desk at {{phone}}.", "«Promoteur» désigne {{sponsor}}.",
     "Stichtag bedeutet {{date}}.", '"{{term}}" means the {{sponsor_name}}.', "The index is written as the sum of {{n}} terms.", "In this notation the weight of [COMPANY NAME] is w.", "The client sent it back to {{address}}.", "The data dictionary was sent to {{client}}."],
)
def test_an_unfilled_field_beside_words_of_explaining_is_evidence(line):
    assert bits(line) & BITS["placeholder"]


@pytest.mark.parametrize(
    "line",
    ['"{{issuer_name}}" stands for the full legal name.', "{{date}} means the day of record.", "null and NaN means not reported.", "The form's field ${amount} takes the gross figure.", "The draft still showed {{issuer_name}} in its title; the reviewer sent it back.", "The date is written as {{date}} in drafts.",
     "The draft named {{issuer}} twice, so the reviewer sent it back.", "Das Kürzel {{datum}} steht für den Stichtag."],
)
def test_a_mentioned_placeholder_is_no_evidence(line):
    assert not bits(line) & BITS["placeholder"]


@pytest.mark.parametrize(
    "line, reason",
    [("World shares fell to 30 | 503 Service unavailable", "error"), ("Internal server error Index rose to 12", "error"), ("Prices | users saw gains | Please enable JavaScript to view this page", "script"), ("Volume fell to 3, please enable JavaScript to view it.", "script"),
     ("The desk switched to Paris - Please try again later.", "error"), ("Please enable cookies | Weights rose to 3 %", "script")],
)
def test_a_message_beside_words_of_reporting_is_evidence(line, reason):
    assert bits(line) & BITS[reason]


@pytest.mark.parametrize("line", ["The page returned an error page: 503 Service unavailable.", "503 Service unavailable answers fell to 2 per day.", "Two users asked whether they must enable JavaScript for the list.", "Der Server meldete 503 Service unavailable."])
def test_a_reported_message_is_no_evidence(line):
    assert not bits(line) & (BITS["weak"] - 1)


# The start of what a pattern of the lists matches; each was lost for want of a cue or is one of its borders.
EVIDENCE = ["An error has occurred.", "An unexpected error has occurred.", "(figure to be confirmed)", "(ratio to be completed)", "Trace ID: 4f00aa91bc", "Add title", "Write the lead", "No text available yet", "Entrez le texte",
            "nan: change notice", "(nan)", "Sed sit sed nisi sit enim.", "SIT AMET ELIT SED", "Type title here", "  at a.b(C:12)", "the fee %s rises", "loss of %.2f", "x %name% y", "ADD TEXT", "Add a ſummary", "bla, bla, bla, bla, bla, bla and then a long sentence of other words follows it here", "foo,bar,foo,bar,foo,bar,foo,bar"]


@pytest.mark.parametrize("line", EVIDENCE)
def test_no_evidence_is_lost_before_the_patterns(line):
    assert flags_of(line, normalised(line)) & (BITS["weak"] - 1)
    assert flags_of(line, normalised(line)) == flags_of(line, normalised(line), prefilter=False)


def _example(items, choose, groups):
    """A text that a parsed pattern matches, as far as its assertions let it."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL" or name == "ANY":
            out += "q"
        elif name == "IN":
            ok = [c for c in "abqzABQ059_ .,:;-●•%?=wxé’'é\t" + "".join(chr(a) for o, a in arg if str(o) == "LITERAL") if re.fullmatch(_set(arg), c)]
            out += choose(ok) if ok else ""
        elif name == "SUBPATTERN":
            out += (part := _example(arg[3], choose, groups))
            groups[arg[0]] = part
        elif name == "BRANCH":
            out += _example(choose(arg[1]), choose, groups)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(_example(arg[2], choose, groups) for _ in range(choose([arg[0], min(arg[1], arg[0] + 1), min(arg[1], arg[0] + 3)])))
        elif name == "GROUPREF":
            out += groups[arg]
    return out


def _set(items):
    part = {"CATEGORY_SPACE": r"\s", "CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}
    one = lambda o, a: "^" if o == "NEGATE" else re.escape(chr(a)) if o == "LITERAL" else f"{re.escape(chr(a[0]))}-{re.escape(chr(a[1]))}" if o == "RANGE" else part[str(a)]
    return "[" + "".join(one(str(o), a) for o, a in items) + "]"


@pytest.mark.parametrize("pattern", [p for ps in [*module.REASONS.values(), module.WEAK] for p in ps])
def test_examples_of_every_pattern_pass_the_prefilter(pattern):
    r, matched = random.Random(pattern), 0
    for _ in range(300):
        body = _example(_parser.parse(pattern), r.choice, {})
        if r.random() < 0.3:
            body = r.choice([body.upper(), body.title(), body.lower()])
        line = r.choice(["", "", "  ", "It is: ", "x", "5"]) + body + r.choice(["", "", ".", " and more", "x", " X"])
        if re.search(pattern, line):
            matched += 1
            assert flags_of(line, normalised(line)) == flags_of(line, normalised(line), prefilter=False), line
            assert "\\1" in pattern or prefilter([pattern])(line), line
    assert matched > 20


def test_a_pattern_without_any_literal_is_refused():
    with pytest.raises(ValueError):
        cues_of(r"\w+|foo")
    assert cues_of(r"(?i)Foo(?: bar)?|\bx[yz]\d") == ({"foo", "foo bar", "\0xy", "\0xz"}, True)


def test_lines():
    assert lines_of("One. Two!\nThree <b>x</b></p>Four\n\n  \n") == ["One.", "Two!", "Three <b>x</b>", "Four"]
    assert normalised("  Rank 12,  ON 3.5%") == "rank 0, on 0.0%"


def run(spark, rows, **kw):
    return {r["doc_id"]: r for r in residue(spark.createDataFrame([(*r, 1, "h", 2) for r in rows], S), **kw).collect()}


def test_documents_copies_blank_null_and_long(spark):
    page = "Home | Notices\n404 Page not found\nGo back to the home page"
    long = "The index gained 1.0% on the day. " * 3000 + "Fees of {{ amount }} apply."
    rows = [(1, page, "Press_Wire"), (2, page, None), (3, "All is well.", "press-wire"), (4, None, "x"), (5, "  \n ", "x"), (6, long, "x"), (7, "", None), (3, "All is well.", "press-wire")]
    got = run(spark, rows)
    assert sorted(got) == [1, 2, 3, 6]
    assert {k for k, r in got.items() if r["is_residue"]} == {1, 2, 6}
    assert got[6]["n_lines"] == 3001 and got[6]["placeholder"] == 1 and got[1]["host"] == "press_wire" == got[3]["host"]


def test_recurrent_boilerplate_is_subtracted_per_host(spark):
    foot = "Cookies | Imprint"
    rows = [(i, f"Notice {i} on volume number {i} of company{chr(97 + i % 26)}{chr(97 + i // 26)}.\n{foot}", "wire") for i in range(40)] + [(100, foot, "wire"), (101, "Loading\nReload", "wire"), (102, foot, "other")]
    got = run(spark, rows, min_texts=20, share=0.1)
    assert got[0]["n_boilerplate"] == 1 and not got[0]["is_residue"]
    assert not got[100]["is_residue"] and got[101]["is_residue"] and got[102]["is_residue"]


# Messages of well-known servers, sites and editors, in their own words.
PUBLIC = {
    "error": ["404 Not Found", "HTTP 404 - File not found", "Not Found", "Not Found. The requested URL was not found on this server.", "The requested URL was not found on this server.", "403 Forbidden", "HTTP/1.1 502 Bad Gateway", "429 Too Many Requests", "HTTP Error 503. The service is unavailable.", "410 Gone",
              "Access to this page has been denied", "Error establishing a database connection", "Your session has expired.", "Internal Server Error", "504 Gateway Time-out", "Sorry, the page you are looking for could not be found.", "Sorry, this page isn't available.", "This site can’t be reached", "Fatal error: Uncaught Error",
              "Traceback (most recent call last):", "Unauthorized", "405 Method Not Allowed", "Oops! That page can’t be found."],
    "script": ["Please enable JS and disable any ad blocker", "Checking your browser before accessing the site.", "Please verify you are a human", "Bitte schalten Sie JavaScript ein", "Ce site requiert JavaScript", "You need to enable JavaScript to run this app.", "This website uses features that require you to turn on cookies",
               "Verifying you are human. This may take a few seconds.", "Habilite JavaScript para continuar", "Activez JavaScript dans votre navigateur", "JavaScript muss aktiviert sein"],
    "placeholder": ["Dear [First Name],", "[company name]", "Hello %(name)s", "Dear $CLIENT_NAME,", "Hello {{ user.first_name }}!", "[Your Name Here]", "Sincerely, [Your Title]", "%1$s has sent you a file", "Hi {firstName}", "<%= user.name %>"],
    "filler": ["Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium", "Lorem ipsum dolor sit amet", "At vero eos et accusamus et iusto odio dignissimos ducimus", "Nemo enim ipsam voluptatem quia voluptas sit aspernatur", "Your text goes here"],
}


@pytest.mark.parametrize("line, reason", [(x, r) for r, xs in PUBLIC.items() for x in xs])
def test_public_messages(line, reason):
    assert bits(line) & BITS[reason]


@pytest.mark.parametrize(
    "line",
    ["The request was denied by the regulator on 3 May.", "The agreement has expired.", "The account was not found in the register of 2021.", "Cookies and biscuits sold 4% more.", "The service is unavailable on public holidays, as the rule book says.", "The company name changed in 2022.", "Price (USD) and volume", "The page count was 404 in the printed edition.",
     "La enmienda requiere la firma de ambas partes.", "Sit down and be patient.", "It needs a script for the opera.", "Conflict of interest rules apply.", "The doors were locked.", "The human resources desk was told.", "Error rates fell to 2% in May."],
)
def test_plain_prose_is_no_evidence(line):
    assert not bits(line) & (BITS["weak"] - 1)


def test_the_whole_text_pass_flags_what_the_lines_do():
    lines = [x for xs in PUBLIC.values() for x in xs] + EVIDENCE + ["All is well.", "bla bla", "Ünïcode İ ſ and ı.", "No evidence here"]
    r = random.Random(3)
    for _ in range(20):
        r.shuffle(lines)
        text = "\n".join(lines)
        norm, flags = module.lines_and_flags(text)
        own = lines_of(text)
        assert [bits(x) for x in own] == flags and len(norm) == len(own)


def test_a_footer_on_every_page_of_a_host_is_subtracted_with_its_evidence(spark):
    foot = "<noscript>Please enable JavaScript to view this site.</noscript>"
    rows = [(i, f"Notice of company {chr(97 + i % 26)}{chr(97 + i // 26)} on its dividend.\n{foot}", "wire") for i in range(60)]
    rows += [(100, "Dear {{name}},\n" + foot, "wire"), (200, "Notice of company zz.\n" + foot, "memo"), (201, "All is well.", "memo"), (202, foot, "memo")]
    got = run(spark, rows)
    assert {k for k, r in got.items() if r["is_residue"]} == {100, 200, 202}
    assert got[0]["n_boilerplate"] == got[0]["n_lines"] - 1


def test_copies_of_one_text_are_no_boilerplate(spark):
    rows = [(i, "Please enable JavaScript to view this page.", "wire") for i in range(50)] + [(100 + i, f"Text {chr(97 + i)} of its own.", "wire") for i in range(20)]
    got = run(spark, rows)
    assert {k for k, r in got.items() if r["is_residue"]} == set(range(50))


def test_only_suspects_and_a_shuffled_join_give_the_same_verdicts(spark, monkeypatch):
    rows = [(i, f"Text {chr(97 + i)}.\nFooter of all.\n" + ("Dear {{name}}," if i % 3 == 0 else "Reload"), "wire") for i in range(20)]
    want = {k: r["is_residue"] for k, r in run(spark, rows).items()}
    assert {k for k, r in run(spark, rows, only_suspects=True).items() if r["is_residue"]} == {k for k, v in want.items() if v}
    monkeypatch.setattr(module, "BROADCAST_LINES", 0)
    assert {k: r["is_residue"] for k, r in run(spark, rows).items()} == want


def test_empty_table(spark):
    assert run(spark, []) == {}
