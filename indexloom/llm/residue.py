"""Template residue and error-page text.

Texts are cut into lines (at line ends, sentence ends and page tags). Lines are counted per host
after normalisation, one vote per different text, whatever they say; a line that recurs in
``share`` of a host's different texts is its boilerplate and is subtracted: a footer that asks for
scripts on every page of a host makes none of its pages residue. What remains of a document, its
residual, is residue if

* a line of it holds evidence: an unfilled placeholder, filler copy, an error or session message,
  or a notice that scripts or cookies are needed; or
* nothing but such hints remains: every line of the residual merely names an error or a script
  setting (a weak hint), so that no content of its own is left.

Evidence is told by form: a name between a template's delimiters, a machine's word for no value, a
run of pseudo-Latin or repeated words, a status code with its reason phrase, a message to the
reader about a page, session or server, a verb of enabling with its script or cookie. A placeholder
that is mentioned, or a message that is reported, is authored text and no evidence.
"""

from __future__ import annotations

import re
from functools import cache
from operator import and_, eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .cues import Prefilter

#: Tags of a page's own markup; placeholders in angle brackets are not among them.
TAGS = r"(?i)</?(?:html|head|body|title|h[1-6]|p|div|span|br|noscript|script|meta|center|hr|ul|li)\b[^<>]*>"

# A name as a template would hold it: one to four words, or joined by underscores or dots, maybe with a filter.
_NAME = r"[A-Za-z][A-Za-z0-9_.]*(?: [A-Za-z][A-Za-z0-9_.]*){0,3}(?: ?\| ?[a-z_]+(?:\([^)\n]*\))?)*"
# Field names that betray a placeholder even in quotation marks.
_FIELD = r"(?:[A-Za-z]+_[A-Za-z_]+|[a-z]+[A-Z][A-Za-z]+|[A-Z]{3,}|(?:Company|Index) ?Name|Index|issuer|symbol|ticker|date|time|month|amount|count|ratio|pct|percentage|ccy|currency|shares|country|market|sector|industry|ref)"

# Where a line's message may begin: at its start, or behind a reference, a dateline or a label.
_START = r"(?:^\W*|[-–)\]:>|.] ?)"

PLACEHOLDER = [
    r"\{\{[^{}\n]*\}\}",
    r"\{%[^%\n]*%\}",
    r"\{#[^#\n]*#\}",
    r"[$#]\{[^{}\n]*\}",
    r"<[%?]=?[^<>\n]*[%?]>",
    r"\[\[[^\[\]\n]+\]\]",
    r"<<[^<>\n]+>>",
    r"@@[^@\n]+@@",
    r"%%" + _NAME + "%%",
    r"(?<![\w%])%[A-Za-z_]{2,}%(?![\w%])",
    r"__[A-Za-z][A-Za-z_ ]*__",
    r"_{4,}",
    r"</?w:[a-zA-Z]+[^<>\n]*/?>",
    r"\bMERGEFIELD\b",
    r"&lt;" + _NAME + "&gt;",
    r"<TB[ACD]\b",
    r"<(?:insert|enter|add|your)\b[^<>\n]*>",
    r"<" + _FIELD + ">",
    r"«" + _FIELD + "»",
    r"‹" + _FIELD + "›",
    r"~" + _FIELD + "~",
    r"<!--\s*[A-Z ]+\s*-->",
    r"\{[A-Za-z][A-Za-z0-9_]+(?:[ .|][A-Za-z0-9_|(). ]*)?\}",
    r"\{\d{1,2}\}",
    r"\[\s*[●•]\s*\]",
    r"\[" + _FIELD + r"(?: ?[A-Z]+){0,3}\]",
    r"\[[A-Z]{2,}(?:[ _][A-Z]{2,}){0,3}\]",
    r"\[(?:TBC|TBD|TBA|xx+)\]",
    r"(?i:[\[(](?:please )?(?:insert|add|enter|fill in|your)\b[^\[\]()\n]+[\])])",
    r"(?i:[\[(][^\[\]()\n]*\b(?:einfügen|eintragen|einzufügen|einzutragen|auszufüllen|zu ergänzen|insérer|à compléter|à remplir|à préciser|insertar|completar|rellenar|to be (?:completed|filled in|added|confirmed|supplied))\b[^\[\]()\n]*[\])])",
    r"(?<![\w%])%(?:[sd]|\.\d+f)(?!\w)",
    r"#(?:REF|VALUE|DIV/0|NUM|NULL)!|#NAME\?|#N/A",
    r"\[object [A-Z]\w*\]",
    r"\bundefined\b",
    r"(?<![\w'/])(?:NaN|NaT|nan|NULL|null|nil)(?![\w'/])",
    r"\(null\)",
    r"(?<=[\w)\],] )None(?! of\b)(?![\w'])|\(None\)",
    r"\bXX[/.-]XX\b|\bXX+,XXX\b|\bX,XXX\b|\b20XX\b|(?<![\w])XX(?: ?%|\.XX)|\bXXXX+\b",
    _START + r"(?:TODO|FIXME)\b",
    r"(?<![\w%])%\([A-Za-z_]\w*\)[sdf](?!\w)",
    r"(?<![\w%])%\d\$[sdf](?!\w)",
    r"(?<![\w$])\$[A-Z][A-Z0-9]*_[A-Z0-9_]+\b",
    r"(?i:\[(?:(?:the|your|first|last|full|company|client|customer|issuer|security|fund|index|legal|short|contact|street|email|e-mail|phone|account|ex|record|pay|effective) )*(?:name|surname|date|address|title|number|amount|price|email|phone|city|currency|percentage|signature|salutation|company|client|recipient)\])",
    r"\bInvalid [Dd]ate\b|\b0000-00-00\b",
]

# The pseudo-Latin words of filler copy.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum perspiciatis unde omnis iste natus voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt vero accusamus iusto odio dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi".split()
#: Short words between them that other languages have too; they do not count.
_BETWEEN = "et|ut|in|ad|ex|ea|eu|non|qui|id|est|ab|at|a|e"

FILLER = [
    r"(?i:(?:\b(?:" + "|".join(LATIN) + r")\b[\s,.]+(?:(?:" + _BETWEEN + r")\b[\s,.]+)*){3}\b(?:" + "|".join(LATIN) + r")\b)",
    r"(?i:\b([a-z]{1,12})(?:[\s,.]+\1\b){5})",
    r"(?i:\b([a-z]{1,12}[\s,]+[a-z]{1,12})(?:[\s,.]+\1\b){3})",
    r"(?i:\b(?:asdf|qwer|qwertz?y?)(?:\s+(?:asdf|qwer|qwertz?y?|jkl))+)",
    r"(?i:" + _START + r"lorem ipsum)",
    r"(?i:\bdummy (?:notice|text|copy|content) for\b)",
    r"(?i:\bthis is (?:a )?(?:placeholder|dummy|sample|filler)\b)",
    r"(?i:\bplaceholder (?:copy|text) for\b)",
    r"(?i:" + _START + r"(?:sample|dummy|filler|placeholder|example) (?:text|copy|content)\b(?:,| to be replaced| goes here|\.|$))",
    r"(?i:" + _START + r"(?:insert|write|add) (?:a |the )?(?:summary|headline|title|notice text|text|body|lead|content)\b)",
    r"(?i:" + _START + r"draft shell\b)",
    r"(?i:\b(?:headline|text|copy|title|content) goes here\b)",
    r"(?i:" + _START + r"(?:(?:this|the) (?:section|page|tab) is )?(?:coming soon|under construction)\W*$)",
    r"(?i:\b(?:content|text|copy) for this (?:tab|page|section|box|field) has not been (?:added|written|entered)|\bno (?:text|content|copy) (?:entered|added|available yet)\b|\bclick (?:here )?to (?:edit|add|enter)\b)",
    r"(?i:\byour (?:headline|title|text|copy|content|message|logo) (?:goes )?here\b|" + _START + r"(?:enter|type|write) (?:your )?(?:headline|title|text) here)",
    r"(?i:" + _START + r"(?:überschrift|titel|text|inhalt) (?:hier )?(?:eingeben|einfügen)\b|" + _START + r"(?:demnächst(?: verfügbar)?|in kürze(?: verfügbar)?|(?:diese )?seite (?:ist )?im aufbau)\W*$)",
    r"(?i:\bvotre (?:titre|texte|contenu) ici\b|\b(?:saisissez|écrivez|entrez) (?:ici )?(?:votre|le) (?:titre|texte)|" + _START + r"(?:bientôt disponible|(?:cette page est )?en construction)\W*$)",
    r"(?i:\b(?:escriba|introduzca|escribe) (?:aquí )?(?:el|su|tu) (?:titular|título|texto)|\bsu (?:titular|título|texto) aquí\b|" + _START + r"(?:próximamente|(?:esta página está )?en construcción)\W*$)",
    r"(?i:\bintentionally (?:holds|contains|shows) (?:sample|dummy|placeholder|filler)\b)",
    r"(?i:\bblindtext für\b|\bhier steht (?:ein )?(?:beispiel|blind|muster)text|" + _START + r"(?:beispiel|blind|muster|platzhalter)text\b)",
    r"(?i:\bceci est un (?:faux )?texte\b|" + _START + r"texte d['’]exemple|\btexte de remplissage\b|" + _START + r"faux texte\b)",
    r"(?i:\beste es un texto de relleno|" + _START + r"texto de (?:ejemplo|relleno|prueba))",
]

SCRIPT = [
    r"<noscript",
    r"(?i:\b(?:enable|turn on|switch on|activate|allow)\b(?:\s\w+){0,3}\s(?:java ?scripts?|scripts?|scripting|cookies)\b)",
    r"(?i:\b(?:requires?|needs?)\b(?:\s\w+){0,2}\s(?:java ?script|scripting|cookies)\b)",
    r"(?i:\bworks best with (?:java ?)?script)",
    r"(?i:\bbrowser (?:does not|doesn't) (?:support|allow|run) (?:java ?)?script)",
    r"(?i:\b(?:java ?scripts?|scripts?|scripting|cookies) (?:is|are|may be|might be|seems?|appears?|must be)\b(?:\s\w+){0,4}\s(?:blocked|disabled|off|enabled|on)\b)",
    r"(?i:\b(?:enable|turn on|switch on|activate|allow) js\b|\b(?:disable|turn off|switch off|pause)\b(?:\s\w+){0,3}\s(?:ad[ -]?block(?:ers?|ing)?)\b)",
    r"(?i:\bchecking (?:if the site connection is secure|your browser)\b|\b(?:verify|verifying|confirm|checking|check|prove)\b(?: that| if)? you are (?:a |not a )?(?:human|robot|bot)\b)",
    r"(?i:\bschalten sie\b(?:\s\w+){0,3}\s(?:java ?script|skripte?|cookies) ein\b|\b(?:java ?script|cookies) (?:muss|müssen) (?:aktiviert|eingeschaltet|zugelassen)\b)",
    r"(?i:\b(?:requiert|requièrent) (?:java ?script|les cookies)|\b(?:activez|autorisez)\b(?:\s\w+){0,2}\s(?:java ?script|scripts|cookies)\b|\b(?:habilite|permita)\b(?:\s\w+){0,2}\s(?:java ?script|scripts|cookies)\b)",
    r"(?i:" + _START + r"loading ?(?:\.\.\.|…))",
    r"(?i:\b(?:aktivieren|erlauben) sie\b(?:\s\w+){0,3}\s(?:java ?script|skripte?|cookies))",
    r"(?i:\bbenötigt (?:java ?script|cookies)|\b(?:skripte|java ?script|cookies)\b(?:\s\w+){0,4}\s(?:ausgeschaltet|deaktiviert|blockiert|gesperrt))",
    r"(?i:\b(?:veuillez|merci d['’]) ?activer\b(?:\s\w+){0,3}\s(?:java ?script|les scripts|les cookies))",
    r"(?i:\bnécessite (?:java ?script|les cookies)|\b(?:scripts|java ?script|cookies) (?:sont|est) (?:désactivés?|bloqués?))",
    r"(?i:\bactive (?:java ?script|las cookies|los scripts)|\b(?:requiere|necesita) (?:java ?script|cookies) y\b|\b(?:scripts|java ?script|cookies) est[áa]n? (?:desactivad|bloquead))",
]

# Messages that are a page's title or whole answer: they stand alone, after a code, or before the next capital.
_TITLE = (
    r"page not found|the page you asked for does not exist|forbidden|access denied|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|request timed out|too many requests"
    r"|internal server error|your session has (?:expired|timed out)|something went wrong|we could not load this (?:notice|page)|an (?:unexpected )?error (?:has )?occurred|unauthori[sz]ed|not authori[sz]ed"
    r"|seite nicht gefunden|zugriff verweigert|interner serverfehler|dienst nicht verfügbar|ihre sitzung ist abgelaufen|es ist ein fehler aufgetreten|zu viele anfragen"
    r"|page introuvable|accès refusé|erreur interne du serveur|service indisponible|votre session a expiré|une erreur est survenue|trop de requêtes"
    r"|página no encontrada|acceso denegado|error interno del servidor|servicio no disponible|su sesión ha caducado|se ha producido un error|demasiadas solicitudes"
)
# The reason phrases of HTTP status codes from 400 on, as registered.
_REASONS = (
    "Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Proxy Authentication Required|Request Time-?out|Conflict|Gone|Length Required|Precondition Failed"
    "|(?:Content|Payload|Request Entity) Too Large|(?:Request-)?URI Too Long|Unsupported Media Type|Range Not Satisfiable|Expectation Failed|Misdirected Request|Unprocessable (?:Content|Entity)|Locked|Failed Dependency|Too Early"
    "|Upgrade Required|Precondition Required|Too Many Requests|Request Header Fields Too Large|Unavailable For Legal Reasons|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Time-?out"
    "|HTTP Version Not Supported|Variant Also Negotiates|Insufficient Storage|Loop Detected|Network Authentication Required"
)
# What a message to the reader is about, and what has become of it.
_THING = r"(?:page|file|url|web ?site|site|server|resource|content|document|link|session|connection|request|access|account|service|host|database|app(?:lication)?)"
_FAILED = r"(?:is(?: not|n['’]t) (?:available|accessible)|(?:was|is|were|could) ?not (?:be )?(?:found|reached|displayed|loaded|established)|couldn['’]t be (?:found|reached|displayed|loaded)|(?:can ?not|can['’]t) be (?:found|reached|displayed|loaded)|does(?: not|n['’]t) exist|no longer exists|has (?:expired|timed out|been (?:denied|blocked|moved|removed|reset))|took too long to respond|refused to connect)"
ERROR = [
    r"(?:^|[\s>:|])(?i:(?:error |http )?[45]\d\d\b[:\s-]*(?:" + _TITLE + r"))(?![\w\"»])",
    r"(?:^\W*|[a-z>] )(?:(?i:" + _TITLE + r"))(?=\s*(?:$|[.!<(|])|\s+[A-ZÀ-Ü0-9])",
    r"(?i:^\W*(?:" + _TITLE + r")\W*$)",
    r"(?i:\bplease try again (?:later|in a (?:few|moment)|in a few minutes)|\bsign in again to continue|\blog in again\b|\byou do not have permission to (?:view|access)|\bserver could not complete your request)",
    r"(?i:\bupstream host took too long|\bscheduled maintenance is in progress|\bwe have been told about the problem|\bgo back to the home ?page|\baddress may be mistyped|^\W*contact support\W*$)",
    r"(?i:\bversuchen sie es später erneut|\bmelden sie sich (?:bitte )?erneut an|\bkeine berechtigung für diesen inhalt|\bangeforderte seite existiert nicht|^\W*zur startseite\W*$)",
    r"(?i:\bveuillez réessayer|\bmerci de vous reconnecter|\bla page demandée n['’]existe|\bn['’]avez pas (?:les droits|la permission|l['’]autorisation)|^\W*retour à l['’]accueil\W*$)",
    r"(?i:\bvuelva a iniciar sesión|\bno tiene permiso para ver|\bla página solicitada ya no existe|\bint[ée]ntelo de nuevo|^\W*volver al inicio\W*$)",
    r"(?i:(?:^\W*|[>:|] ?)(?:error |http(?:/\d(?:\.\d)?)? ?(?:error )?)?[45]\d\d\b[\s:.,–—-]*(?:error[\s:.,–—-]*)?(?:file |page |the service is )?(?:" + _REASONS + r"|unavailable)\b)",
    r"^\W*(?:" + _REASONS.replace("|Conflict|Gone", "").replace("|Locked", "") + r")\W*$",
    r"(?i:" + _START + r"(?:sorry,? |oops!? |whoops!? )?(?:the requested|the|this|your|that) (?:\w+ )?" + _THING + r"(?: you (?:requested|are looking for|were looking for|tried to (?:open|view|reach)))? " + _FAILED + r"\b(?:\W*$|[^.!?]*\b(?:on this server|please|here)\b))",
    r"(?i:" + _START + r"access to (?:this|the requested) (?:page|resource|site|content) (?:has been|was|is) (?:denied|blocked|forbidden))",
    r"(?i:\berror (?:establishing|connecting to|opening) (?:a |the )?(?:database|server|connection|session)\b|" + _START + r"(?:a |an )?(?:fatal|uncaught|unhandled|unexpected|application|runtime|parse|syntax) (?:error|exception)\b\W*(?:$|[:(]))",
    r"\{\s*\"(?:status|error|code|message)\"\s*:",
    r"^\s*at [\w.$]+\([\w$.]+:\d+\)|(?:^|\s)(?:[a-z]\w*\.)+[A-Z]\w*(?:Error|Exception)\b|\bTraceback \(most recent call last\)|^\s*File \"[^\"\n]+\", line \d+",
    r"(?i:\b(?:request|incident|trace|correlation) ?(?:id)?: ?[0-9a-f]{8,})",
]

#: Names of such things without being one: evidence only if nothing else is left.
WEAK = [r"(?i:\b(?:java ?script|cookies|error [45]\d\d|lorem ipsum|placeholder|captcha|reload|retry|loading|réessayer|reintentar|erneut versuchen)\b)"]

#: Nouns for parts of a text or form, and little words that may stand between one and the placeholder it names.
_PART_OF_TEXT = r"(?:templates?|placeholders?|markers?|fields?|notations?|variables?|tokens?|tags?|slots?|wildcards?|platzhalter|feld|vorlage|marke|champ|balise|modèle|campo|plantilla|marcador)"
_LITTLE = r"(?:is|are|was|were|marked|marks|mark|shown|shows|written|printed|given|open|with|by|as|in|of|like|such|called|named|the|a|an|every|each|all|mit|durch|als|par|avec|comme|por|con|como)"
#: Verbs of meaning, of being written, and of showing.
_MEANS = r"(?:means (?:that|not|the)|stands for|denotes|is written as|cannot occur|is not (?:computable|defined|reported)|bedeutet|steht für|signifie|désigne|significa)"
_SHOWS = r"(?:shows?|showed|shown|displays?|displayed|reads?|named?|names|contains?|contained|printed|carried|held|zeigte|enthielt|affichait|contenait|mostraba|contenía)"
#: Words by which an author may explain a placeholder or a missing value; they clear only placeholders that are mentioned.
EXPLAIN = [
    r"(?i:\b" + _PART_OF_TEXT + r"\b)",
    r"(?i:\bdata dictionary\b|\b(?:undefined|null) (?:case|behaviou?r|term|value|variable)\b)",
    r"(?i:\b" + _MEANS + r"\b)",
    r"(?i:\b(?:drafts?|proofs?|mock-?ups?|versions?|previews?|entwurf|brouillon|borrador)\b)",
]
#: What stands right before a placeholder that is mentioned: what it is called, or in a draft the verb whose object it is.
MENTIONED_BEFORE = r"(?i:(?:\b" + _PART_OF_TEXT + r"(?: " + _LITTLE + r")*|\bin (?:the )?notation|\bis written as|\b(?:drafts?|proofs?|mock-?ups?|previews?|entwurf|brouillon|borrador)\b[^.;]* " + _SHOWS + r")\s*[\"'“„«‘(]?$)"
#: What follows one that is mentioned: the verb whose subject it is, also behind others of its kind, or what it is a case of.
MENTIONED_AFTER = r"(?i:[\"'”“»’)]?(?:(?:,| and| or| und| oder| et| ou| y| o) \S+){0,3} (?:" + _MEANS + r"|(?:field|placeholder|marker|variable|tag)s? takes?|takes the|(?:case|behaviou?r|term)\b)\b)"
_QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "`": "`"}
#: Verbs of asking, saying and seeing by which an author reports on a message, a notice about scripts, or filler copy ...
ASKED = [
    r"(?i:\b(?:asked|wanted to know|wondered|reported|saw|noticed|told|said|complained|explained|mentioned|quoted)\b)",
    r"(?i:\b(?:answered|replied|responded) with\b|\b(?:returned|showed|displayed) an?\b|\breturns error\b)",
    r"(?i:\b(?:fragte|fragten|meldete|meldeten|antwortete|berichtete)\b)",
    r"(?i:\b(?:a|ont) (?:demandé|renvoyé|répondu|signalé)\b)",
    r"(?i:\b(?:preguntó|devolvió|respondió|informó)\b)",
]
#: ... or what something became of.
BECAME = [
    r"(?i:\b(?:fell|rose|dropped|grew|switched) to\b|\b(?:was|were|had|has|have) (?:\w+ )?(?:\w+ed|left|been|shown|seen|sent)\b|\bnever \w+ed\b)",
    r"(?i:\bused the backup\b)",
    r"(?i:\b(?:wurde|wurden|lag|lagen) \w+|\bersetzt\.?$)",
    r"(?i:\b(?:a|ont) été \w+)",
    r"(?i:\bse (?:sustituyó|usó|cambió)\b)",
]
#: A weak hint is cleared by any of them in its line; evidence only by one that it is the object or subject of.
REPORT = [*EXPLAIN, *ASKED, *BECAME]
#: Most words of a line that is a hint and no sentence.
HINT_WORDS = 12

#: Reasons and their bits in a line's flags; ``weak`` is a hint only.
REASONS = {"placeholder": PLACEHOLDER, "filler": FILLER, "script": SCRIPT, "error": ERROR}
BITS = {r: 1 << i for i, r in enumerate([*REASONS, "weak"])}
#: Not a reason: the line repeats itself, so that a pattern with a back reference may match.
REPEATED = 1 << len(BITS)
ALL = 2 * REPEATED - 1


@cache
def _tools():
    union = lambda ps: re.compile("|".join(f"(?:{p})" for p in ps if "\\1" not in p))
    alone = {r: [re.compile(p) for p in ps if "\\1" in p] for r, ps in REASONS.items()}
    may_hold = Prefilter({BITS[r]: [p for p in ps if "\\1" not in p] for r, ps in (REASONS | {"weak": WEAK}).items()})
    return may_hold, {r: union(ps) for r, ps in REASONS.items()}, alone, union(WEAK), union(REPORT), union(EXPLAIN), re.compile(MENTIONED_BEFORE), re.compile(MENTIONED_AFTER), union([*EXPLAIN, *ASKED]), union([*EXPLAIN, *BECAME])


_NOSCRIPT = re.compile(r"(?i)<noscript[^<>]*>")
_TAG = re.compile(TAGS)
_OTHER_SPACE = re.compile(r"[^\S \r\n]")
_CUT = re.compile(r"(?<=[.!?])\s+(?=\S)|[\r\n]+")
_PART = re.compile(r"[^|A-ZÀ-Ü]*")
_DIGITS, _SPACE = re.compile(r"\d+"), re.compile(r"\s+")


def lines_of(text: str) -> list[str]:
    """The lines of a text: cut at line ends, sentence ends and page tags; blank ones left out."""
    if "<" in text:
        text = _TAG.sub("\n", _NOSCRIPT.sub("\n<noscript ", text))
    if _OTHER_SPACE.search(text):
        parts = _CUT.split(text)
    else:  # the same cuts where blanks are the only spaces within a line
        parts = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").replace("\r", "\n").split("\n")
    return [s for s in parts if s and not s.isspace()]


def normalised(line: str) -> str:
    """A line without case, numbers and spacing."""
    return _SPACE.sub(" ", _DIGITS.sub("0", line.lower())).strip()


def _repeats(low: str) -> bool:
    """Whether words repeat as in every line that a pattern of repetition matches: each is the one two before it, several times on end.

    Of such a line's pieces between blanks, commas and full stops all but the first and last are
    then plain words, so two following pieces at least are those two before them.
    """
    if "\u0131" in low or "\u017f" in low or "\u0307" in low:
        return True
    pieces = low.replace(",", " ").replace(".", " ").split()
    same = list(map(eq, pieces, pieces[2:]))
    return any(map(and_, same, same[1:]))


def _mentioned(line: str, found: re.Match, before: re.Pattern, after: re.Pattern) -> bool:
    """Whether a line that explains something explains this placeholder: it is quoted, the subject or object of the verb, or a value in a data dictionary."""
    a, b = found.span()
    quoted = a > 0 and _QUOTES.get(line[a - 1]) == line[b : b + 1]
    return bool(quoted or before.search(line, 0, a) or after.match(line, b) or (found.group().isalpha() and "data dictionary" in line.lower()))


def _reported(line: str, found: re.Match, asked: re.Pattern, became: re.Pattern) -> bool:
    """Whether a line reports on this message: a word of asking comes before it, or one of becoming after it and before the next capital, in its part between bars."""
    a, b = found.span()
    start = line.rfind("|", 0, a) + 1
    after = _PART.match(line, b)
    return bool(asked.search(line, start, a) or became.search(line, b, after.end()))


def flags_of(line: str, low: str, prefilter: bool = True, may: int | None = None) -> int:
    """The evidence bits of one line, 0 for none or for a report on such things.

    ``may`` are the bits that its cues leave possible, if they are known already. They save work
    and change nothing; without ``prefilter`` all patterns run.
    """
    may_hold, unions, alone, weak, report, explain, *mention, asked, became = _tools()
    if not prefilter:
        may = ALL
    elif may is None:
        may = may_hold(line) | (REPEATED if _repeats(low) else 0)
    if not may:
        return 0
    bits = 0
    for r, u in unions.items():
        if (may & BITS[r] and u.search(line)) or (alone[r] and may & REPEATED and any(p.search(line) for p in alone[r])):
            bits |= BITS[r]
    if not bits and may & BITS["weak"] and line.count(" ") < HINT_WORDS and weak.search(line):
        bits = BITS["weak"]
    if bits & BITS["placeholder"] and explain.search(line) and all(_mentioned(line, m, *mention) for m in unions["placeholder"].finditer(line)):
        bits &= ~BITS["placeholder"]
    if bits & ~BITS["placeholder"] and report.search(line):
        found = [m for r in REASONS if r != "placeholder" and bits & BITS[r] for p in (unions[r], *alone[r]) for m in p.finditer(line)]
        if all(_reported(line, m, asked, became) for m in found):
            bits &= BITS["placeholder"]
    return bits


def lines_and_flags(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, normalised, and their evidence bits. Cues are looked for in the whole text at once; patterns run on the lines that hold one."""
    lines = lines_of(text)
    if not lines:
        return [], []
    joined = "\n".join(lines)
    low = joined.lower()
    flags = [0] * len(lines)
    suspects = _tools()[0].lines(joined, low)
    if _repeats(low):
        for i, line in enumerate(low.split("\n")):
            if _repeats(line):
                suspects[i] = suspects.get(i, 0) | REPEATED
    norm = [" ".join(x.split()) for x in _DIGITS.sub("0", low).split("\n")]
    for i, may in suspects.items():
        flags[i] = flags_of(lines[i], norm[i], may=may)
    return norm, flags


def text_lines(texts: pa.Array) -> pa.Array:
    """Per text its lines as structs (x: 64-bit hash of the normalised line, r: flags, n: 1 for the first such line of the text, else 0)."""
    offsets, xs, rs, ns = [0], [], [], []
    for text in texts.to_pylist():
        norm, flags = lines_and_flags(text or "")
        own = [xxhash.xxh64_intdigest(x) for x in norm]
        seen: set[int] = set()
        for x in own:
            ns.append(x not in seen)
            seen.add(x)
        xs += own
        rs += flags
        offsets.append(len(xs))
    items = pa.StructArray.from_arrays([pa.array(np.array(xs, np.uint64).view(np.int64)), pa.array(rs, pa.int32()), pa.array(ns, pa.bool_())], names=["x", "r", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def host_of(source: Column) -> Column:
    """A source's one spelling: lower case, trimmed, with underscores; null is a host of its own."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_"), F.lit(""))


#: Most boilerplate lines that are sent to all executors; more are joined by a shuffle.
BROADCAST_LINES = 200_000


def residue(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", min_texts: int = 3, share: float = 0.02, only_suspects: bool = False) -> DataFrame:
    """One row per document that has text: ``key``, ``host``, ``n_lines``, ``n_boilerplate``, one count per reason, ``weak``, ``is_residue``.

    A line is boilerplate if it occurs in the given share of its host's different texts, and in
    ``min_texts`` of them; then it is no part of the residual, whatever it says. Reasons and
    ``weak`` count lines of the residual. ``only_suspects`` leaves out the documents in which no
    line holds evidence or a hint, none of which is residue.

    Every whole text is read once, in Arrow batches; from then on only hashes and flags move, from
    a checkpoint with one row per document. Lines are counted per host map-side, so a common line
    costs one partial row per task; different texts are told apart only for lines that occur
    often enough in copies. Boilerplate is broadcast if it is counted to be at most
    ``BROADCAST_LINES`` lines and joined by a shuffle otherwise.

    Defined cases: null and blank texts give no row; copies under other keys each give theirs, but
    have one vote on boilerplate; rows of one key are taken together; a null host is a host; extra
    columns are ignored.
    """
    d = docs.select(F.col(key).alias("k"), host_of(F.col(host)).alias("h"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    per_text = cut(d.select("k", "h", F.xxhash64("text").alias("t"), F.arrow_udf(text_lines, "array<struct<x:bigint,r:int,n:boolean>>")("text").alias("s")))
    first = per_text.select("h", "t", F.explode("s").alias("s")).where("s.n").select("h", "t", "s.x")
    of = per_text.groupBy("h").agg(F.count_distinct("t").alias("of")).withColumn("least", F.greatest(F.lit(min_texts), F.ceil(F.col("of") * share)))
    often = first.groupBy("h", "x").agg(F.count(F.lit(1)).alias("c")).join(of, "h").where("c >= least").select("h", "x", "least")
    often = _sent(cut(often))
    boiler = cut(first.join(often, ["h", "x"]).groupBy("h", "x", "least").agg(F.count_distinct("t").alias("c")).where("c >= least").select("h", "x", F.lit(True).alias("boiler")))
    asked = per_text.where(F.exists("s", lambda x: x["r"] != 0)) if only_suspects else per_text
    lines = asked.select("k", "h", F.explode("s").alias("s")).select("k", "h", "s.x", "s.r").join(_sent(boiler), ["h", "x"], "left")
    kept = F.col("boiler").isNull()
    per = lines.groupBy("k").agg(
        F.min("h").alias("host"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~kept).alias("n_boilerplate"),
        *[F.count_if(kept & (F.col("r").bitwiseAND(BITS[r]) != 0)).alias(r) for r in REASONS],
        F.count_if(kept & (F.col("r") == BITS["weak"])).alias("weak"),
    )
    evidence = F.greatest(*[F.col(r) for r in REASONS]) > 0
    only_weak = (F.col("weak") > 0) & (F.col("weak") + F.col("n_boilerplate") == F.col("n_lines"))
    return per.withColumnRenamed("k", key).withColumn("is_residue", evidence | only_weak)


def _sent(lines: DataFrame) -> DataFrame:
    """A checkpointed table of lines, marked for broadcast if its rows are few by count."""
    return F.broadcast(lines) if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else lines
