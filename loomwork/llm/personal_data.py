"""Personal information in free text, replaced by typed placeholders.

Found: e-mail addresses (also written out with "at" and "dot"), phone numbers, identity
numbers given by an authority, street addresses with a number, names of persons.
Names outside such contexts are found by :func:`learn_names`: words that the corpus mostly shows, with
a capital, where a label or greeting says that a name stands.
Dates of birth after their labels are replaced as well; they are no type of ``types_found``.
Method for the replacement: format-preserving Feistel pseudonyms.  The digits and
capital letters of a validated number are permuted by a keyed Feistel network within
their format, so separators, length and country code stay and equal values stay equal in
every document, while the value cannot be read back without the key.  A valid date becomes
another valid date in the same notation.  Values without a number format (names, addresses,
e-mail addresses) get a keyed token of 16 bytes.  The key is the caller's; there is no default.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.skew import lookup_join
from loomwork.session import written

TYPES = ("email", "phone", "id_number", "street_address", "name")

# ---------------------------------------------------------------- Feistel network


def _round(key: bytes, i: int, half: int, width: int, tweak: bytes, modulus: int) -> int:
    data = f"{i}.{width}.{half}.".encode() + tweak
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=16).digest(), "big") % modulus


def feistel(value: str, key: bytes, tweak: bytes = b"", radix: int = 10, back: bool = False, rounds: int = 10) -> str:
    """A keyed permutation of the digit strings of one length (a permutation of the values
    ``radix ** len``); ``back`` inverts it.  Strings of one digit are shifted by the key."""
    n = len(value)
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    if n == 0:
        return ""
    u = n // 2
    a, b = (int(value[:u], radix) if u else 0), int(value[u:], radix)
    widths = (u, n - u)
    order = range(rounds) if not back else range(rounds - 1, -1, -1)
    for i in order:  # alternate rounds change the left and the right part
        if i % 2 == 0:
            m = radix ** widths[0]
            f = _round(key, i, b, n, tweak, m)
            a = (a - f if back else a + f) % m
        else:
            m = radix ** widths[1]
            f = _round(key, i, a, n, tweak, m)
            b = (b - f if back else b + f) % m

    def text(x: int, w: int) -> str:
        out = ""
        for _ in range(w):
            x, r = divmod(x, radix)
            out = digits[r] + out
        return out

    return text(a, widths[0]) + text(b, widths[1])


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """Digits and capitals permuted in place, everything else kept; of a phone number also the country code."""
    kept = 0
    if kind == "phone" and (m := _COUNTRY.match(value)):
        kept = m.end()
    tweak, body = kind.encode(), value[kept:]
    digits = iter(feistel("".join(c for c in body if c in "0123456789"), key, tweak))
    caps = [c for c in body if "A" <= c <= "Z"]
    nums = feistel("".join("0123456789abcdefghijklmnop"[ord(c) - 65] for c in caps), key, tweak, radix=26)
    letters = iter(chr(65 + "0123456789abcdefghijklmnop".index(c)) for c in nums)
    return value[:kept] + "".join(next(digits) if c in "0123456789" else next(letters) if "A" <= c <= "Z" else c for c in body)


def read_date(value: str) -> tuple[datetime.date, str] | None:
    """A date of the calendar from 1900 to 2099 and its notation (``ymd``, ``dmy`` or ``mdy``); None if there is none."""
    m = _DATE.fullmatch(value)
    if not m:
        return None
    a, b, c = (int(x) for x in (m["a"], m["b"], m["c"]))
    orders = [("ymd", a, b, c)] if len(m["a"]) == 4 else [("dmy", c, b, a), ("mdy", c, a, b)]
    for order, y, month, day in orders:
        if 1900 <= y <= 2099:
            try:
                return datetime.date(y, month, day), order
            except ValueError:
                continue
    return None


def date_pseudonym(value: str, key: bytes) -> str:
    """Another date in the same notation: the days of two centuries, keyed-permuted."""
    found = read_date(value)
    if not found:
        return pseudonym(value, "birth_date", key)
    first = datetime.date(1900, 1, 1)
    days = (datetime.date(2099, 12, 31) - first).days + 1
    n = (found[0] - first).days
    while True:  # walks the cycle of a permutation of five digits until it is a day again
        n = int(feistel(f"{n:05d}", key, b"birth_date"))
        if n < days:
            break
    new, m = first + datetime.timedelta(n), _DATE.fullmatch(value)
    part = {"y": new.year, "m": new.month, "d": new.day}
    out = [str(part[x]).zfill(len(m[g])) for x, g in zip(found[1], "abc", strict=True)]
    return f"{out[0]}{m['s']}{out[1]}{m['s']}{out[2]}"


def token(value: str, key: bytes) -> str:
    """A keyed token of a value, the same for other case and spacing."""
    return hashlib.blake2b(re.sub(r"\s+", " ", value).strip().casefold().encode(), key=key, digest_size=16).hexdigest()


def plausible_number(value: str, kind: str, labelled: bool = False) -> bool:
    """Whether a number can be one of its kind: it is not one digit repeated; a phone number has 7 to 15 digits and no
    country code 0.  A number that only its shape makes a social security number (``labelled`` false) has no group of
    zeros and does not begin with 666."""
    digits = re.sub(r"\D", "", value)
    if len(set(digits)) < 2:
        return False
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not value.lstrip("( ").startswith("+0")
    groups = None if labelled else _SSN.fullmatch(value.strip())
    return not groups or (all(int(g) for g in groups.groups()) and groups[1] != "666")


# ---------------------------------------------------------------- patterns

_COUNTRY = re.compile(r"\+(?:1|7|\d{2,3}(?=[\s.(-])|\d{2})")
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})")
_DATE = re.compile(r"(?P<a>\d{1,4})(?P<s>[./-])(?P<b>\d{1,2})(?P=s)(?P<c>\d{1,4})")
#: Words before a date of birth.
_BIRTH_LABEL = (
    r"born\s(?:on|in)?|date\sof\sbirth|birth\s?date|birthday(?:\sis)?|dob|nacid[oa]\sel|fecha\sde\snacimiento|née?\sle|date\sde\snaissance|"
    r"geboren\sam|geburtsdatum|geboren\sop|geboortedatum|nascid[oa]\sem|data\sde\snascimento|生年月日は?"
)
_BIRTH = re.compile(rf"(?<!\w)(?:{_BIRTH_LABEL})\s?(?:is|es|est|ist|é)?\s?[:#]?\s?(?P<v>\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{1,4}})(?!\d)", re.I)

_FLAT = {0xA0: " ", 0x200B: " ", 0x200C: " ", 0x200D: " ", 0x2060: " ", 0xFEFF: " ", 0x3000: " ", 0x2019: "'"}

_EMAIL = re.compile(
    r"(?<![\w@])[\w.+%'-]*\w\s?@\s?(?:[\w-]+\.)+[A-Za-z]{2,}\b"
    r"|(?<![\w@])[\w.+%-]*\w\s?[\(\[\{<]\s?at\s?[\)\]\}>]\s?(?:[\w-]+\s?(?:\.|[\(\[\{<]\s?dot\s?[\)\]\}>]|\sdot\s)\s?)+[A-Za-z]{2,}\b"
    r"|(?<![\w@])[\w.+%-]*\w\sat\s(?:[\w-]+\s(?:dot)\s)+[A-Za-z]{2,}\b",
    re.I,
)

#: Words before numbers that belong to things, not to persons.
_THING = (
    r"orders?|order\s(?:number|no\.?)|case|ref(?:erence)?|ticket(?:\s(?:number|no\.?))?|tracking(?:\s(?:number|no\.?))?|invoice|part(?:\sno\.?)?|"
    r"serial(?:\snumber)?|imei|build|model|queue(?:\snumber)?|error(?:\scode)?|code|version|número\sde\s(?:caso|pedido)|numéro\sde\s(?:dossier|commande)|"
    r"número\sdo\s(?:chamado|pedido)|fallnummer|zaaknummer|bestellnummer|受付番号|注文番号|paid|floor"
)
_THING_NUMBER = re.compile(rf"(?:\b(?:{_THING})|受付番号|注文番号)(?:\s(?:number|no\.?|nr\.?|is))?\s?[:#]?\s?[A-Z]{{0,3}}-?\d[\w-]*", re.I)

#: Words before identity numbers.
_ID_LABEL = (
    r"passport|pasaporte|passeport|reisepass|passaporte|paspoort|ssn|social\ssecurity|national\sinsurance|ni\s(?:number|no)|nino|tax\s?(?:id|number|no)|tin|"
    r"driver'?s?'?\slicen[cs]e|driving\slicen[cs]e|licen[cs]e\s(?:number|no)|id\scard|national\sid|identity\s(?:card|number)|dni|nie|nif|nuss|curp|"
    r"(?:numéro\sde\s)?sécurité\ssociale|numéro\sfiscal|carte\sd'identité|permis\sde\sconduire|steuer-?\s?id(?:nr|nummer)?|steuernummer|personalausweis(?:nummer)?|"
    r"ausweis(?:nummer)?|sozialversicherungsnummer|führerschein(?:nummer)?|bsn|burgerservicenummer|sofinummer|rijbewijs(?:nummer)?|cpf|rg|cnh|"
    r"carta\sde\scondução|número\sde\scontribuinte|マイナンバー|個人番号|パスポート番号|運転免許証番号"
)
_ID = re.compile(
    rf"(?<!\w)(?:{_ID_LABEL})(?:\s(?:number|numbers|no\.?|nr\.?|num\.?|card|id|de|is|es|est|ist|é|lautet|was|:)(?!\w))*\s?[.:#は]?\s?"
    r"(?P<v>(?:[A-Z]{1,2}\s?)?\d+(?:[\s.\-/]\d+)*(?:-?\s?[A-Z])?)(?!\w)",
    re.I,
)
_ID_SHAPE = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z]{2}\s\d{2}\s\d{2}\s\d{2}\s[A-D])(?![\w-])")

_PHONE_LABEL = (
    r"my\s(?:number|phone|cell|mobile)(?:\snumber)?(?:\sis)?|reach\smy\smobile|reach\sme\s(?:at|on)|call\s(?:me\s)?(?:on|at|back\son)|call\sme|phone|text(?:\sme)?(?:\s(?:on|at))?|"
    r"mobile|cell|tel(?:ephone|éfono|efone|efon)?\.?|whatsapp|teléfono\ses|llámame\sal|móvil|appelez-moi\sau|mon\snuméro\sest|portable|meine\snummer\sist|"
    r"ruf(?:t|en\ssie)?\smich\s(?:an\s)?unter|handy|mijn\snummer\sis|bel\sme\sop|meu\s(?:número|telefone|celular)\sé|liga\spara|ligue\spara|me\sligue\sno|電話番号は?"
)
_PHONE = re.compile(
    r"(?<![\w+.,-])(?:"
    r"\+\d{1,3}(?:[\s.\-]?\(?\d{1,5}\)?){2,6}"
    r"|\(\d{3,4}\)\s?\d{3,4}[\s.\-]?\d{3,4}"
    r"|\d{3}([.\-])\d{3}\1\d{4}"
    r"|0\d{4}\s\d{5,6}|0\d{2}\s\d{4}\s\d{4}|0\d{2,3}\s\d{4,5}\s\d{3,4}|0\d(?:[\s.\-]\d{2}){4}|0\d{2,3}-\d{2,4}-\d{4}"
    r")(?![\w-])"
)
_PHONE_AFTER = re.compile(rf"(?<!\w)(?:{_PHONE_LABEL})\s?[:#]?\s?(?P<v>\+?\(?\d(?:[\s.\-()]{{0,2}}\d){{6,14}})(?![\w-])", re.I)

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_STREET_WORDS = (
    r"Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Drive|Dr|Terrace|Crescent|Boulevard|Blvd|Square|Gardens|Grove|Mews|Highway|Hwy"
)
_STREET_WEAK = r"Way|Close|Place|Pl|Sq|Hill|Row|Walk|Parade|Circle"
#: The ways to write a street address, by language; a text is searched for those it can hold only.
_STREETS = {
    "street en": re.compile(
    rf"(?<![\w.,:-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|FLAT|APT|flat|apt)\s\d+[A-Za-z]?,?\s)?\d{{1,5}}[A-Za-z]?,?\s(?:{_CAP}\s){{1,3}}(?i:{_STREET_WORDS})\b\.?"
    rf"(?:,?\s(?i:Apt|Flat|Unit|Suite)\.?\s\d+[A-Za-z]?)?"
    ),
    "street es": re.compile(rf"(?<!\w)(?i:Calle|C/|Avenida|Av\.|Avda\.?|Plaza|Paseo|Camino|Rua|Travessa|Praça|Alameda)\s(?:(?i:de|da|do|la|las|los|del|das|dos)\s){{0,2}}(?:{_CAP},?\s){{1,3}}(?:n\.?º?\s?)?\d{{1,5}}[A-Za-z]?(?:,\s?\d{{1,2}}\s?[ºª]\s?[A-Za-z]?)?"),
    "street fr": re.compile(rf"(?<![\w.,:-])\d{{1,5}}(?:\s?bis)?,?\s(?i:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours)\s(?:(?i:de|du|des|la|le|les)\s|(?i:de\sla|l'|d')\s?){{0,2}}{_CAP}"),
    "street de": re.compile(
        r"(?<!\w)[A-ZÄÖÜa-zäöü][\wäöüß-]{2,}(?i:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|straat|laan|plein|gracht|kade|singel|dreef)\s\d{1,5}\s?[a-z]?(?!\w|:\d)"
        r"|(?<!\w)(?:[A-ZÄÖÜ][\wäöüß-]+\s)?(?:Straße|Strasse|Weg|Platz|Allee)\s\d{1,5}\s?[a-z]?(?!\w|:\d)"
    ),
    "street ja": re.compile(r"\d{1,4}丁目(?:\d{1,4}(?:番地?)?(?:\d{1,4}号)?)?|\d{1,4}番地\d{0,4}"),
}
#: What every address of the first kind holds: a number before a capital.
_NUMBER_CAPITAL = re.compile(r"\d[A-Za-z]?,?\s[A-ZÀ-ÖØ-Þ]")
_PLACE_LABEL = (
    r"live\sat|living\sat|address\sis|address:|ship\s(?:it|them|that)?\s?to|send\s(?:it|someone|them|somebody)\sto|deliver(?:ed)?\s(?:it\s)?to|never\scame\sto|come\sto|moved\sto|"
    r"vivo\sen|vivo\sna|vivo\sno|moro\sna|moro\sno|habite\sau|habite|wohne\s(?:in\sder|im|am|in)|woon\s(?:op|aan|in)|住所は"
)
_STREET_AFTER = re.compile(
    rf"(?<!\w)(?:{_PLACE_LABEL})\s(?P<v>(?:(?:flat|apt\.?|unit)\s\d+[a-z]?,?\s)?\d{{1,5}}[a-z]?,?\s(?:(?:[^\W\d_][\w'-]*)\s){{1,3}}(?:{_STREET_WORDS}|{_STREET_WEAK})\b\.?)", re.I
)

#: Words that stand where a name could, but are none.
_NO_NAME = frozenset(
    "a an the there friend friends folks all everyone everybody team guys you we i it he she they this that these those my your our their his her its "
    "thanks thank sorry good hello hi hey welcome please is are was has have had did do does can could will would should may might "
    "let lets check go hold try when which what where who why how and or but so if then now just not no yes ok okay well oh day days reminder "
    "hm hmm um also still again anyway update edit ps help loyal user customer fan owner nobody somebody siri maps mail music photos safari notes news home health wallet "
    "books calendar podcasts facetime messages reminders icloud iphone ipad mac macbook imac airpods homepod apple app store voice memos agent support "
    "friday monday tuesday wednesday thursday saturday sunday today tomorrow yesterday in on at to for from with about as by of "
    "started since last seen working again case order ref ticket depuis desde seit sinds número numéro fallnummer zaaknummer "
    "gracias hola merci bonjour danke hallo bedankt obrigado olá vamos gern por para es el la los las le les un una der die das ein eine mit ist het een de "
    "signed never having here back going looking trying glad happy great nice "
    "wir ich sie er wie was wann welche kein keine hier nous vous je tu il elle on qué cómo não sim ik je jij wij hij zij wat".split()
)
_NAME_LABEL = (
    r"my\s(?:full\s|first\s|last\s)?name\sis|account\sis\sunder|(?:please\s)?ask\sfor|booked\s(?:for|under)|signed,|(?:best|kind)\sregards,|regards,|sincerely,|"
    r"me\sllamo|mi\snombre\ses|a\snombre\sde|(?:je\sm'appelle)|mon\snom\sest|au\snom\sde|ich\sheiße|ich\sheisse|mein\sname\sist|auf\sden\snamen|"
    r"(?:eu\s)?me\schamo|meu\snome\sé|em\snome\sde|ik\sheet|mijn\snaam\sis|op\snaam\svan|mi\schiamo|私の名前は|名前は"
)
_W = r"[^\W\d_](?:[\w'-]*[^\W\d_])?"
_NAME_AFTER = re.compile(rf"(?<!\w)(?:{_NAME_LABEL})\s?(?P<v>(?:[^\W\d_]\.|{_W})(?:,\s(?={_CAP}){_W}|\s(?:[^\W\d_]\.\s)?{_W})?)", re.I)
_JA_NAME = re.compile(r"(?:私の)?名前は(?P<v>[^\s。、です]{2,12})")
_GREETING = re.compile(
    rf"^\W*(?:@\w+\s+)*\W*(?:(?:hi|hello|hey|dear|good\s(?:morning|afternoon|evening|day)|hola|bonjour|hallo|olá|thanks|thank\syou|sorry\sabout\s(?:this|that)|(?:we're|were)\ssorry)(?P<c>,?)\s(?P<v>{_W})(?=\s?[,!.:;-]|\s[A-Z]|\s?$)|(?P<w>{_W}),\s(?=[A-Za-z]))",
    re.I,
)


def needed(pattern: re.Pattern) -> set[str]:
    """Lower-case literals, at least one of which is in every text that ``pattern`` matches,
    read from its alternatives; an empty set if there are none."""

    def score(words: set[str]) -> tuple[int, int]:
        return (min(map(len, words)), -len(words)) if words else (0, 0)

    def read(items) -> set[str]:
        best: set[str] = set()
        run = ""
        for op, arg in [*items, (None, None)]:
            if op is K.LITERAL:
                run += chr(arg)
                continue
            found = {run.lower()} if run else set()
            run = ""
            best = max(best, found, key=score)
            if op is K.SUBPATTERN:
                best = max(best, read(arg[3]), key=score)
            elif op is K.BRANCH:
                each = [read(x) for x in arg[1]]
                best = max(best, set().union(*each) if all(each) else set(), key=score)
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0]:
                best = max(best, read(arg[2]), key=score)
        return best

    words = read(list(_parser.parse(pattern.pattern, pattern.flags)))
    return {w for w in words if not any(v != w and v in w for v in words)}


#: Literals without which the patterns of a type cannot match.
_GATES = {
    "name": needed(_NAME_AFTER) | needed(_JA_NAME), "place": needed(_STREET_AFTER), **{k: needed(p) for k, p in _STREETS.items()}, "id": needed(_ID), "hello": needed(_GREETING), "born": needed(_BIRTH),
}
#: Characters that patterns without case take for i, s and k, but whose lower case is another.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k", 0x1E9E: "ß"}
_SEEN_GATES = None


def _gates(low: str) -> set[str]:
    """Which types a lower-case text can hold; one pass of an Aho-Corasick automaton."""
    global _SEEN_GATES
    if _SEEN_GATES is None:
        try:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w in set().union(*_GATES.values()):
                machine.add_word(w, frozenset(k for k, words in _GATES.items() if w in words))
            machine.make_automaton()
            _SEEN_GATES = lambda t: set().union(*{k for _, k in machine.iter(t)})
        except ImportError:
            each = {k: re.compile("|".join(map(re.escape, w))) for k, w in _GATES.items()}
            _SEEN_GATES = lambda t: {k for k, r in each.items() if r.search(t)}
    return _SEEN_GATES(low)


_BRACKET_AT = re.compile(r"[\(\[\{<]\s?at\s?[\)\]\}>]")
_DIGITS_GATE = re.compile(r"\d[\d\s.\-()/]{5,}\d")
_URL = re.compile(r"https?://\S+", re.I)
_DIGIT = re.compile(r"\d")
_TO_CUSTOMER = re.compile(r"\W*(?:@\d+\s+|[A-ZÀ-Þ][\w'’-]*,\s[A-Z])")
#: Small words inside street names.
_LITTLE = frozenset("de du la le l d el do da das dos lo st".split())


_NAME_WORD = re.compile(r"[^\W\d_][\w]*")


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    kind: str


def _name_span(m: re.Match, text: str) -> tuple[int, int] | None:
    """The part of a match after a label that is a name; None if it is none."""
    value, start = m.group("v"), m.start("v")
    words = [(w.start(), w.group()) for w in re.finditer(_W, value)]
    first = words[0][1]
    initial = value[words[0][0] + len(first) :][:1] == "." and len(first) == 1
    if (first.lower().split("'")[0] in _NO_NAME and not initial) or re.match(r"\s(?:to\sbe|day\b)", text[m.end("v") :]):
        return None
    end = words[0][0] + len(first)
    shouted = first.isupper() and len(first) > 1
    for at, w in words[1:]:
        if w.lower().split("'")[0] in _NO_NAME:
            break
        initial = len(w) == 1
        same = w[0].isupper() or (first[0].islower() and not shouted)
        if not (initial or same):
            break
        end = at + len(w)
    if value[end : end + 1] == "." and len(first) == 1:
        return None if end == 1 and len(words) == 1 else (start, start + end)
    return start, start + end


def find(text: str, names: frozenset[str] = frozenset()) -> list[Hit]:
    """The personal details of one text, by place, without overlaps; ``names`` are known names in lower case."""
    flat = text if text.isascii() else text.translate(_FLAT)
    # keep the places: only the patterns see single blanks
    hits = _find_spaced(text, flat) if "  " in flat else _find(flat)
    return _known_names(text, hits, names) if names else hits


def _known_names(text: str, hits: list[Hit], names: frozenset[str]) -> list[Hit]:
    """``hits`` with the capitalised known names outside them; neighbours are one name."""
    taken = [(h.start, h.end) for h in hits] + [m.span() for m in _URL.finditer(text)]
    found: list[Hit] = []
    for m in _NAME_WORD.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if m.group().lower() not in names or before in ("@", "#", "^", "/") or any(a < m.end() and m.start() < b for a, b in taken):
            continue
        if found and text[found[-1].end : m.start()] == " ":
            found[-1] = Hit(found[-1].start, m.end(), "name")
        else:
            found.append(Hit(m.start(), m.end(), "name"))
    return sorted([*hits, *found], key=lambda h: h.start)


def _find_spaced(text: str, flat: str) -> list[Hit]:
    keep = [i for i, c in enumerate(flat) if not (c == " " and i and flat[i - 1] == " ")]
    squeezed = "".join(flat[i] for i in keep)
    return [Hit(keep[h.start], keep[h.end - 1] + 1, h.kind) for h in _find(squeezed)]


def _find(t: str, gated: bool = True) -> list[Hit]:
    taken: list[tuple[int, int]] = []
    hits: list[Hit] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            hits.append(Hit(start, end, kind))

    low = (t if t.isascii() else t.translate(_FOLD)).lower()
    gates = _gates(low) if gated else set(_GATES)
    numbers = not gated or ("id" in gates and len(_DIGIT.findall(t)) >= 5) or _DIGITS_GATE.search(t)
    at = not gated or t.find("@", 1) > 0 or ("at" in low and "dot" in low) or _BRACKET_AT.search(low)
    if not (numbers or at or gates):
        return hits
    if at:
        for m in _EMAIL.finditer(t):
            add(m.start(), m.end(), "email")
    if "http" in low:
        taken += [m.span() for m in _URL.finditer(t)]
    if "born" in gates:
        for m in _BIRTH.finditer(t):
            if read_date(m.group("v")):
                add(m.start("v"), m.end("v"), "birth_date")
    if numbers:
        for m in _ID.finditer(t):
            if sum(c.isdigit() for c in m.group("v")) < 5:
                continue
            if plausible_number(m.group("v"), "id_number", labelled=True):
                add(m.start("v"), m.end("v"), "id_number")
            else:
                taken.append(m.span("v"))  # no number of a person, and nothing else either
        taken += [m.span() for m in _THING_NUMBER.finditer(t)]
        for m in filter(lambda m: plausible_number(m.group(), "id_number"), _ID_SHAPE.finditer(t)):
            add(m.start(), m.end(), "id_number")
        for m in _PHONE_AFTER.finditer(t):
            if plausible_number(m.group("v"), "phone"):
                add(m.start("v"), m.end("v"), "phone")
        for m in _PHONE.finditer(t):
            if sum(c.isdigit() for c in m.group()) >= 8 and plausible_number(m.group(), "phone"):
                add(m.start(), m.end(), "phone")
    if _DIGIT.search(t):
        ways = [p for k, p in _STREETS.items() if k in gates and (not gated or k != "street en" or _NUMBER_CAPITAL.search(t))]
        done = 0
        for m in sorted((m for p in ways for m in p.finditer(t)), key=lambda m: m.start()):
            if m.start() >= done:
                done = m.end()
                if not any(w.lower() in _NO_NAME for w in re.findall(_W, m.group())[:-1] if not w.lower().rstrip("s") in _LITTLE):
                    add(m.start(), m.end(), "street_address")
        if "place" in gates:
            for m in _STREET_AFTER.finditer(t):
                add(m.start("v"), m.end("v"), "street_address")
    if "name" in gates:
        for m in _NAME_AFTER.finditer(t):
            span = _name_span(m, t)
            if span:
                add(*span, "name")
        for m in _JA_NAME.finditer(t):
            add(m.start("v"), m.end("v"), "name")
    if "hello" in gates:
        m = _GREETING.match(t)
        if m:
            which = "v" if m.group("v") else "w"
            word = m.group(which)
            thanks = which == "v" and not m.group("c") and re.match(r"\W*(?:@\w+\s+)*\W*(?:thank|sorry|we)", t, re.I)
            named = word[0].isupper() or (t.islower() and not thanks)
            if which == "w":  # a name and a comma open an answer to a customer
                named = word[0].isupper() and bool(_TO_CUSTOMER.match(t))
            if named and len(word) > 1 and word.lower().split("'")[0] not in _NO_NAME:
                add(m.start(which), m.end(which), "name")
    return sorted(hits, key=lambda h: h.start)


def redact(text: str, key: bytes, names: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """The text with placeholders, and the types found."""
    hits = find(text, names)
    if not hits:
        return text, []
    out, at = [], 0
    for h in hits:
        value = text[h.start : h.end]
        if h.kind == "birth_date":
            inner = date_pseudonym(value, key)
        else:
            inner = pseudonym(value, h.kind, key) if h.kind in ("phone", "id_number") else token(value, key)
        out += [text[at : h.start], f"<{h.kind}:{inner}>"]
        at = h.end
    return "".join(out) + text[at:], sorted({h.kind for h in hits})


_CAPITALS = r"\p{Lu}[\p{L}\p{M}\p{N}_]+"


def learn_names(rows: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """``word, n_context, n_capital`` of the words of ``rows (key, text)`` that are names by their contexts.

    A word is one if labels or greetings show it ``least`` times and more, these are ``share`` or more of its
    places with a capital, and it is not more frequent without one.  Counts are over all rows."""

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [w.lower() for t in pdf["text"] for h in find(t) if h.kind == "name" for w in _NAME_WORD.findall(t[h.start : h.end]) if len(w) > 2]
            yield pd.DataFrame({"word": pd.Series(got, dtype=object)})

    texts = rows.select("text").filter(F.col("text").isNotNull())
    shown = written(texts.mapInPandas(labelled, "word string").groupBy("word").agg(F.count("*").alias("n_context")).filter(F.col("n_context") >= least), "shown-names")
    every = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}\p{M}\p{N}_]+"), 0)).alias("w"))
    counts = every.select(F.lower("w").alias("word"), F.col("w").rlike(r"^\p{Lu}").alias("capital")).join(shown.select("word"), "word", "left_semi")
    counts = counts.groupBy("word").agg(F.count_if("capital").alias("n_capital"), F.count_if(~F.col("capital")).alias("n_small"))
    names = shown.join(counts, "word").filter((F.col("n_context") >= share * F.col("n_capital")) & (F.col("n_small") <= F.col("n_capital")))
    return names.select("word", "n_context", "n_capital")


def _with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows (key, text)`` with ``names``: the known names of each text, joined by word, so the list may have any length."""
    h = F.xxhash64("text")
    words = rows.filter(F.col("text").isNotNull()).select("key", h.alias("h"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_CAPITALS), 0))).alias("w"))
    found = lookup_join(words.select("key", "h", F.lower("w").alias("word")), written(names, "known-names"), "word", "n_capital")
    per = found.groupBy("key", "h").agg(F.collect_set("word").alias("names"))
    return rows.select("key", "text").withColumn("h", h).join(per, ["key", "h"], "left").drop("h")


def redact_rows(rows: DataFrame, key: bytes, names: DataFrame | None = None) -> DataFrame:
    """``key, redacted, types`` of ``rows (key, text)``, one row per input row.

    * Null texts stay null, with no types; blank texts stay as they are.
    * The same value gives the same pseudonym in every row and run with one ``key`` (16 to 64 bytes).
    * ``names``: the result of :func:`learn_names`; without it names are found in their contexts only.
    * An empty table gives an empty result; further columns are ignored.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf["names"] if "names" in pdf else [None] * len(pdf)
            done = [redact(t, key, frozenset(n) if n is not None else frozenset()) if isinstance(t, str) else (None, []) for t, n in zip(pdf["text"], known, strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "redacted": [d[0] for d in done], "types": [d[1] for d in done]})

    kind = rows.schema["key"].dataType.simpleString()
    source = rows.select("key", "text") if names is None else _with_names(rows, names)
    return source.mapInPandas(work, f"key {kind}, redacted string, types array<string>")


def types_found(rows: DataFrame, key: bytes) -> DataFrame:
    """Distinct ``key, pii_type`` of what was replaced (dates of birth left out)."""
    found = redact_rows(rows.filter(F.col("key").isNotNull()), key).select("key", F.explode("types").alias("pii_type"))
    return found.filter(F.col("pii_type").isin(*TYPES)).distinct()
