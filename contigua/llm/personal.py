"""Personal information in free text: cues found by one automaton, expanded and validated by local parsers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int, str]


def cased(words: list[str]) -> set[str]:
    """Words as they are, and with a capital at the start or throughout."""
    return {v for w in words for v in (w, w[:1].upper() + w[1:], w.upper())}


def inside_word(text: str, place: int) -> bool:
    """Whether a word goes on over this place."""
    return 0 < place < len(text) and text[place - 1].isalnum() and text[place].isalnum()


# ---- email -----------------------------------------------------------------------------------------------------------

#: How an at-sign and a dot are written; fixed values.
AT = r"(?:@|＠|%40|&#0*64;|&#[xX]0*40;|&commat;|\s?[(\[{<]\s?(?:at|AT|At|@|arroba|chez|ät)\s?[)\]}>]\s?|\s(?:AT|at|arroba|chez)\s)"
DOT = r"(?:\.|．|&#0*46;|&#[xX]0*2[eE];|&period;|%2[eE]|\s?[(\[{<]\s?(?:dot|DOT|Dot|punto|point|punkt|Punkt|\.)\s?[)\]}>]\s?|\s(?:DOT|dot|punto|punkt|point)\s)"
AT_CUES = ["@", "＠", "%40", "&#", "&commat;", "(at", "[at", "{at", "<at", "( at", "[ at", "(AT", "[AT", "{AT", "(At", "[At", "( AT", "[ AT", "(@", "[@", "(arroba", "[arroba", "(chez", "[chez", "(ät", "[ät", " AT ", "\nAT ", " arroba "]
#: Dots written as words, which tell that a plain `at` before them stands for the sign.
DOT_CUES = [" dot ", " DOT ", " punto ", " punkt ", " point ", "(dot)", "[dot]", " (dot", " [dot"]
AT_RE = re.compile(AT)
LABEL = r"[^\W_]+(?:-+[^\W_]+)*"
DOMAIN = re.compile(rf"{LABEL}(?:{DOT}{LABEL})+")
LAST_LABEL = re.compile(r"[A-Za-z]{2,24}\Z")
SPELLED_DOT = re.compile(r"[\s(\[{<](?:dot|DOT|Dot|punto|point|punkt|Punkt)[\s)\]}>]")
LOCAL_DOT = re.compile(r"\s?[(\[{]\s?(?:dot|DOT|punto|point|punkt)\s?[)\]}]\s?\Z|\s(?:dot|DOT)\s\Z")


def _local_char(c: str) -> bool:
    """Letters of Latin, Greek and Cyrillic script, digits and the signs of a local part."""
    return c in "._+%-'&" or c.isalnum() and (c < "ɐ" or "Ͱ" <= c < "԰")


def email_at(text: str, place: int) -> Span | None:
    """The address around the at-sign that begins near `place`: local part to its left, domain with a dot to its right."""
    m = (AT_RE.match(text, place - 1) if place and text[place - 1].isspace() else None) or AT_RE.match(text, place)
    if not m:
        return None
    domain = DOMAIN.match(text, m.end())
    if not domain or not LAST_LABEL.search(domain[0]):
        return None
    word = m[0].strip() in ("at", "chez")
    if word and not SPELLED_DOT.search(domain[0]):
        return None  # the word itself, as in "meet at example.org"
    k = m.start()
    while True:
        while k and _local_char(text[k - 1]):
            k -= 1
        # dots of the local part may be written out too
        dot = None if word else LOCAL_DOT.search(text[max(0, k - 12) : k])
        if not dot or not (k - len(dot[0]) and _local_char(text[k - len(dot[0]) - 1])):
            break
        k -= len(dot[0])
    local = text[k : m.start()]
    cut = len(local) - len(local.lstrip(".-+'%&"))
    if len(local) == cut or local.endswith(".") or word and (not any(c.isalpha() for c in local) or k and text[k - 1] in "@/"):
        return None
    return k + cut, domain.end(), "email"


def email_before(text: str, place: int, low: int) -> Span | None:
    """The address whose domain has a dot written as a word at `place`, and whose at-sign is the word `at` before that domain.

    A domain that reaches back to `low`, the last such dot, has been read from there.
    """
    k = place
    while True:
        while k and (text[k - 1].isalnum() or text[k - 1] == "-"):
            k -= 1
        dot = LOCAL_DOT.search(text[max(0, k - 12) : k])
        if not dot:
            break
        k -= len(dot[0])
        if k <= low:
            return None
    if text[max(0, k - 4) : k].lower() == " at ":
        return email_at(text, k - 4)
    return email_at(text, k - 6) if text[max(0, k - 6) : k].lower() == " chez " else None


# ---- numbers: phones and identity numbers ----------------------------------------------------------------------------

#: Words before a number that tell a phone, an identity number or another thing; fixed values.
PHONE_CUES = ["tel", "tél", "tfno", "phone", "telephone", "téléphone", "teléfono", "telefon", "fon", "mobile", "mobil", "móvil", "portable", "handy", "fax", "call", "rang", "ring", "whatsapp", "sms", "☎", "📞", "dial", "appeler", "llamar", "anrufen"]
ID_CUES = ["passport", "passeport", "pasaporte", "Reisepass", "Personalausweis", "Ausweisnummer", "Ausweis", "identity card", "identity", "carte d'identité", "identité", "identidad", "ID card", "resident ID", "national ID", "ID no", "ID", "SSN", "social security", "social insurance", "sécurité sociale", "seguridad social", "Sozialversicherungsnummer", "Sozialversicherung", "NIR", "DNI", "NIE", "NIF", "INSEE", "national insurance", "NINO"]
OTHER_CUES = ["isbn", "issn", "doi", "oldid", "permalink/", "serial", "lot", "map", "inv.", "plate", "file no.", "no.", "nr.", "page", "pp.", "p."]
#: What may stand between such a word and its number.
TO_NUMBER = re.compile(r"[^\W\d_]*[.)]?\s{0,2}(?:(?:me|us|him|her|them|on|at|under|unter|au|al|el|le|is|ist|est|es|was|number|numéro|número|nummer|card|no|nr|n°|nº|#|der|du|de)\b[.°]?\s{0,2}){0,4}[:=#–-]?[°]?\s{0,2}", re.I)
TO_OTHER = re.compile(r"\W{0,3}")

PHONE = re.compile(
    r"""(?<![\w+.,/-])(?:
    (?P<plus>(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(\d{1,4}\))?(?:[ .\-/]?\d{1,12}){1,6})
    |(?P<nanp>\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|(?:1[ .\-])?\d{3}(?P<sep>[.\- ])\d{3}(?P=sep)\d{4})
    |(?P<trunk>\(0\d{1,4}\)[ .\-/]?\d{2,8}(?:[ .\-]?\d{1,8}){0,3}|0[1-9]\d{0,3}[ .\-/]\d{2,8}(?:[ .\-/]\d{2,8}){0,4}|0[1-9]\d{8,10})
    )(?![\w-]|[.,/]\d|\(\d)""",
    re.X,
)
CUED = re.compile(r"(?<![\w+.,/-])\(?\+?\d(?:[ .\-/()]{0,2}\d){6,14}(?![\w-]|[.,/]\d)")
DATE_LIKE = re.compile(r"(?:19|20)\d\d[.\-/](?:0[1-9]|1[0-2])[.\-/]\d\d\Z")


def phone_at(text: str, start: int, label: str | None) -> Span | None:
    """A phone number that begins at `start`; without a label only in a form that phones alone have."""
    if m := PHONE.match(text, start):
        digits = sum(c.isdigit() for c in m[0])
        fits = not (m["plus"] and not 8 <= digits - 2 * m[0].startswith("00") <= 15 or m["trunk"] and not 9 <= digits <= 12)
        if fits and not DATE_LIKE.match(m[0]) and not (m["nanp"] and m["sep"] == " " and label != "phone"):
            return start, m.end(), "phone"
    if label == "phone" and (m := CUED.match(text, start)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
        return start, m.end(), "phone"
    return None


ID_SHAPE = re.compile(
    r"""(?<![\w+./-])(?:
    (?P<ssn>\d{3}-\d{2}-\d{4})
    |(?P<resident>[1-9]\d{16}[\dXx])
    |(?P<nir>[1-478][ ]?\d\d[ ]?(?:0[1-9]|[1-9]\d)[ ]?(?:\d\d|2[AB])[ ]?\d{3}[ ]?\d{3}[ ]?\d\d)
    |(?P<dni>(?:\d{8}|[XYZ]-?\d{7})-?[A-Z])
    |(?P<nino>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-D])
    |(?P<pass>[A-Z]{1,2}\d{6,8}|[CFGHJK][0-9CFGHJKLMNPRTVWXYZ]{8})
    )(?![\w-]|[./]\d)""",
    re.X,
)
#: What may stand before a number that has no label of its own.
ID_OPENS = re.compile(r"(?:[(\[,;:]|\b(?:under|unter|sous|bajo|con|mit|avec|with))\s?\Z")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
RESIDENT_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)


def _valid_id(kind: str, number: str, labelled: bool) -> bool:
    plain = re.sub(r"[\s-]", "", number).upper()
    if kind == "ssn":
        return not number.startswith("000") and number[4:6] != "00" and number[7:] != "0000"
    if kind == "resident":
        year, month, day = int(plain[6:10]), int(plain[10:12]), int(plain[12:14])
        dated = 1880 <= year <= 2100 and 1 <= month <= 12 and 1 <= day <= 31
        check = "10X98765432"[sum(int(d) * w for d, w in zip(plain[:17], RESIDENT_WEIGHTS, strict=True)) % 11]
        return dated and (labelled or check == plain[17])
    if kind == "nir":
        body = plain.replace("2A", "19").replace("2B", "18")
        return bool(re.fullmatch(r"\d{15}", body)) and (labelled or 97 - int(body[:13]) % 97 == int(body[13:]))
    if kind == "dni":
        digits = plain[:-1].translate(str.maketrans("XYZ", "012"))
        return labelled or DNI_LETTERS[int(digits) % 23] == plain[-1]
    return labelled


def id_at(text: str, start: int, label: str | None) -> Span | None:
    """An identity number that begins at `start`: with its label, or with valid check digits after a bracket, a sign or a preposition."""
    m = ID_SHAPE.match(text, start)
    if not m or m.lastgroup in ("nino", "pass") and label != "id":
        return None
    # the longest preposition above and its blank have seven characters
    if (label == "id" or ID_OPENS.search(text[max(0, start - 8) : start])) and _valid_id(m.lastgroup, m[0], label == "id"):
        return start, m.end(), "id_number"
    return None


NUMBER_SIGNS = frozenset("0123456789 .-/()+ ")


def numbers_around(text: str, place: int, low: int, labels: dict[int, str]) -> tuple[list[Span], int]:
    """Phones and identity numbers in the stretch of digits and their signs around `place`, not before `low`; and where it ends."""
    a = b = place
    while a > low and text[a - 1] in NUMBER_SIGNS:
        a -= 1
    while a > low and text[a - 1].isalnum():
        a -= 1  # letters that a number begins with
    while b < len(text) and (text[b] in NUMBER_SIGNS or text[b].isalnum() and text[b - 1] not in " ()/ " or text[b] in "ABCD" and text[b - 1] == " "):
        b += 1
    found, at = [], a
    while at < b:
        c = text[at]
        if (c in "+(" or c.isalnum()) and not (at and text[at - 1].isalnum()):
            label = labels.get(at)
            if label != "other":
                span = id_at(text, at, label) or phone_at(text, at, label)
                if span:
                    found.append(span)
                    at = max(at + 1, span[1])
                    continue
        at += 1
    return found, b


# ---- addresses -------------------------------------------------------------------------------------------------------

#: Words for streets; fixed values.
STREET_AFTER = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Close", "Crescent", "Terrace", "Court", "Ct", "Place", "Pl", "Square", "Sq", "Boulevard", "Blvd", "Way", "Row", "Gardens", "Grove", "Hill", "Mews", "Parade", "Walk", "Highway", "Alley", "Circle", "Parkway", "Quay", "Rise", "Green"]
SHORT = r"(?:(?:St|Rd|Ave|Ln|Dr|Ct|Pl|Sq|Blvd)\.)"
STREET_BEFORE = ["rue", "avenue", "av.", "boulevard", "bd", "place", "impasse", "chemin", "allée", "allées", "quai", "cours", "route", "passage", "square", "sentier", "ruelle", "calle", "c/", "avenida", "avda.", "avda", "plaza", "pza.", "paseo", "camino", "ronda", "travesía", "carretera", "via", "viale", "piazza"]
STREET_ENDING = ["straße", "strasse", "str.", "str", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig", "pfad", "chaussee", "markt", "graben", "stieg"]
_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_NO = r"\d{1,5}(?:\s?(?:bis|ter|quater)\b|[ ]?[a-zA-Z](?![\w'’]))?(?:\s?[-/–]\s?\d{1,4}[a-zA-Z]?)?"
_AFTER = "|".join(re.escape(s) for s in sorted(STREET_AFTER, key=len, reverse=True))
_BEFORE = "|".join(re.escape(s) if s.endswith((".", "/")) else re.escape(s) + r"\b" for s in sorted([w for s in STREET_BEFORE for w in (s, s.capitalize())], key=len, reverse=True))
_ENDING = "|".join(re.escape(s) for s in sorted(STREET_ENDING, key=len, reverse=True))
_LINK = r"(?:(?:de[ ]la|de[ ]los|de[ ]las|de[ ]l['’]|del|des|de|du|d['’]|l['’]|la|les|le|los|las|el)[ ]?)"
_NAMED = rf"{_LINK}?{_WORD}(?:[ ](?!Con\b|Que\b|Y\b|Et\b|Avec\b|Qui\b){_LINK}?{_WORD}){{0,3}}"
ADDRESS = re.compile(
    rf"""(?<![\w.,/+-])(?:
    (?P<en>{_NO},?[ ](?:(?:N|S|E|W|North|South|East|West)\.?[ ])?{_WORD}(?:[ ]{_WORD}){{0,2}}?[ ](?:{SHORT}|(?:{_AFTER})\b)(?:[ ](?:N|S|E|W|North|South|East|West)\b)?)
    |(?P<fr>{_NO},?[ ](?:{_BEFORE})[ ]?{_NAMED})
    |(?P<es>(?:{_BEFORE})[ ]?{_NAMED}(?:,?[ ](?:n[.º°o]+[ ]?)?|[ ]){_NO})
    |(?P<de>(?:{_WORD}[ -]){{0,2}}?[A-ZÄÖÜ][\w-]*?(?:{_ENDING}|[ -](?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer))[ ]{_NO})
    |(?P<swap>{_WORD}(?:[ ]{_WORD}){{0,2}}[ ](?:{SHORT}|(?:{_AFTER})\b),?[ ]{_NO})
    )(?![\w])""",
    re.X,
)
#: A word of an address or a name has at most so many characters; longer runs without a blank are no words.
LONGEST_WORD = 100


def word_starts(text: str, place: int, count: int) -> list[int]:
    """Where the word at `place` and the `count` words before it on the same line begin, from left to right."""
    out, k = [], place
    for _ in range(count + 1):
        a = k
        while a and not text[a - 1].isspace() and k - a <= LONGEST_WORD:
            a -= 1
        out.append(a)
        if k - a > LONGEST_WORD or not a or text[a - 1] == "\n":
            break
        k = a - 1
        if k and text[k - 1].isspace():
            break
    return out[::-1]


def address_at(text: str, place: int) -> Span | None:
    """An address whose street word stands at `place`. It begins at most six words before, as the pattern has no more of them."""
    for a in word_starts(text, place, 6):
        for start in (a, *(i for i in range(a + 1, min(place + 1, a + LONGEST_WORD)) if text[i - 1] in "([{|>=*:;\"“„«—–")):
            if start > place or text[start : start + 1].isspace():
                break
            m = ADDRESS.match(text, start)
            if m and place < m.end():
                return m.start(), m.end(), "address"
    return None


# ---- names -----------------------------------------------------------------------------------------------------------

CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*[\w]"
INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
DOUBLE = rf"{CAP}(?:[-–‑]{CAP})?"
#: Words in capitals that are no part of a name though they stand beside one; fixed values.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Professor", "Sir", "Lord", "Lady", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Don", "Doña", "Monsieur", "Madame", "Mme", "Mlle", "President", "Captain", "General", "Saint", "King", "Queen", "Prince", "Princess", "Pope", "Bishop", "Father", "Sister", "Brother", "Uncle", "Aunt", "Judge", "Major", "Colonel", "Senator", "Minister", "Mayor"]
FUNCTION_WORDS = ["The", "A", "An", "In", "On", "At", "By", "Of", "And", "Or", "But", "For", "From", "To", "With", "When", "While", "Then", "There", "This", "That", "These", "Those", "His", "Her", "Its", "Their", "He", "She", "It", "They", "We", "You", "If", "As", "After", "Before", "Since", "Until", "Now", "Today", "Yesterday", "However", "Also", "Yet", "Der", "Die", "Das", "Den", "Dem", "Ein", "Eine", "Und", "Oder", "Aber", "Im", "Am", "Von", "Mit", "Bei", "Nach", "Seit", "Als", "Wenn", "Le", "La", "Les", "Un", "Une", "Des", "Du", "De", "Et", "Ou", "Mais", "Par", "Pour", "Avec", "Sans", "Dans", "Sur", "Chez", "El", "Los", "Las", "Una", "Unos", "Y", "O", "Pero", "Por", "Para", "Con", "Sin", "En", "Sobre", "Desde", "Al", "Del"]
MONTHS_DAYS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
#: Words that make a thing named after a person of the name before them; fixed values.
THING_WORDS = ["Bridge", "Castle", "Hall", "Street", "Road", "Avenue", "Lane", "Square", "Park", "Prize", "Award", "Medal", "Cup", "Trophy", "School", "College", "University", "Institute", "Museum", "Library", "Hospital", "Stadium", "Tower", "Station", "Airport", "Foundation", "House", "Building", "Memorial", "Garden", "Gardens", "Theatre", "Theater", "Church", "Chapel", "Lecture", "Scholarship", "Chair", "Collection", "Gallery", "Centre", "Center", "Glacier", "Island", "Mountain", "Peak", "Lake", "River", "Canal", "Dam", "Line", "Effect", "Law", "Theorem", "Town", "County", "District", "Valley", "Bay", "Port", "Company", "Club", "Society", "Office", "Department", "Drive", "Crescent", "Close", "Terrace", "Court", "Place"]
THINGS = re.compile(rf"[ ]+(?:{'|'.join(THING_WORDS)})\b")
NO_NAME = frozenset(TITLES + FUNCTION_WORDS + MONTHS_DAYS + THING_WORDS + [w.capitalize() for c in PHONE_CUES + ID_CUES for w in c.split()])
USER_OR_FILE = re.compile(r"(?i)(?:user|benutzer|benutzerin|utilisateur|utilisatrice|usuario|usuaria|file|image|datei|fichier|archivo|special|category|kategorie|catégorie|categoría)(?: ?[\w ]{0,12})?:[ ]?\Z")
#: What a person's name follows, and what shows after a name that it is a person's; fixed values.
BEFORE_PERSON = ["signed", "signed by", "uploaded by", "released by", "written by", "taken by", "posted by", "hochgeladen von", "gezeichnet", "téléversé par", "publié par", "signé", "subido por", "firmado", "my name is", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "contact", "Kontakt", "contacto", "write to", "schreiben Sie an", "écrire à", "écrivez à", "escriba a", "ask for", "caretaker", "curator", "owner", "editor", "responsable", "Ansprechpartner", "anybody know", "anyone know", "kennt jemand", "quelqu'un connaît", "alguien conoce", "reverted", "this page is", "contact person", "Kontaktperson", "persona de contacto", "personne à contacter", "for the record", "zur Akte", "bitte an", "veuillez écrire à", "dirigirse a", "regards,", "Gruß", "cordialement,", "saludos,"]
TO_PERSON = re.compile(r"[ \t]*[:,=]?[ \t]*")
AFTER_PERSON = [" can be reached", " may be reached", " lives at", "? Lives at", " resides at", ", born in", ", born on", ", né à", ", née à", ", geboren in", ", nacido en", ", nacida en", " again, who edits", " est joignable", ", joignable", " ist erreichbar", ", erreichbar", " wohnt in", " habite au", " vive en", " schreiben:", ", opens the"]
#: Two words, or an initial and a word, in the order of a name or turned round.
PERSON = re.compile(rf"(?:{DOUBLE}|{INITIAL})(?:[ ](?:{CAP}|{INITIAL})){{0,2}}[ ]{DOUBLE}|{DOUBLE},[ ](?:{CAP}(?:[ ]{INITIAL})*|{INITIAL})")
#: Between a name and the contact that follows it.
TO_CONTACT = re.compile(r"[ \t]*(?:[,:(|*–—-]|\|\|)*[ \t]*(?:(?:resident ID|national ID|ID card|passport|passeport|pasaporte|Reisepass|Personalausweis|SSN|DNI|NIE|NIR|NIF|tel|tél|phone|mobile|fax|email|e-mail|mail|courriel|correo|can be reached|joignable|erreichbar|reached|at|on|au|unter|under|al|no|number)\b[.:]?[ ]?){0,4}[(:]?[ ]?\Z", re.I)


class Finder:
    """The automaton over the cues of every kind; made once in each Python worker."""

    def __init__(self, given: tuple[str, ...], family: tuple[str, ...]):
        self.given = frozenset(given) | {g.upper() for g in given}
        self.family = frozenset(family) | {f.upper() for f in family}
        cues: dict[str, set[str]] = defaultdict(set)
        for c in AT_CUES:
            cues[c].add("at")
        for c in DOT_CUES:
            cues[c].add("dot")
        for s in STREET_AFTER:
            cues[" " + s].add("street")
        for s in STREET_BEFORE:
            for w in {s, s.capitalize(), s.upper() if s == "c/" else s}:
                cues[w + ("" if w[-1] in "/." else " ")].add("street")
        for s in STREET_ENDING:
            cues[s + " "].add("street")
            cues[s.capitalize() + " "].add("street")
        for words, kind in ((PHONE_CUES, "phone"), (OTHER_CUES, "other"), (BEFORE_PERSON if self.given or self.family else [], "person"), (AFTER_PERSON if self.given or self.family else [], "after"), ([f"{w}:" for w in ("tel", "sms", "callto", "fax")], "phone")):
            for c in cased(words):
                cues[c].add(kind)
        for c in cased(ID_CUES) - {"Id", "id"}:
            cues[c].add("id")
        for d in range(100):
            cues[f"{d:02}"].add("digits")
        for words, kind in ((self.family, "family"), (self.given, "given")):
            for w in words:
                cues[w].add(kind)
        self.automaton = ahocorasick.Automaton()
        for c, kinds in cues.items():
            self.automaton.add_word(c, (len(c), tuple(sorted(kinds))))
        self.automaton.make_automaton()

    # -- parts of names

    def _maybe(self, w: str) -> bool:
        """Whether a word in capitals that no list has may be part of a name."""
        return w not in NO_NAME and w.capitalize() not in NO_NAME and len(w) > 1

    def _left(self, text: str, a: int) -> list[tuple[int, str]]:
        """Words in capitals and initials right before `a`, from the nearest on, at most four."""
        out, k = [], a
        while len(out) < 4:
            gap = k
            while gap and text[gap - 1] in " \t":
                gap -= 1
            if gap == k and not (k and text[k - 1] in ".-" and out == [] and k == a):
                if not (k and text[k - 1] == "."):
                    break
            b = gap
            if b and text[b - 1] == "-" and gap == k:
                b -= 1
            w = b
            if w and text[w - 1] == ".":
                w -= 1
                if not (w and text[w - 1].isupper() and (w == 1 or not (text[w - 2].isalnum() or text[w - 2] in "_@/'’"))):
                    break
                w -= 1
            else:
                while w and (text[w - 1].isalnum() or text[w - 1] in "_'’") and b - w <= LONGEST_WORD:
                    w -= 1
                if b - w < 2 or not text[w].isupper() or w and text[w - 1] in "@/.-–":
                    break
            out.append((w, text[w:b]))
            k = w
        return out

    def _not_a_person(self, text: str, a: int, b: int) -> bool:
        """Whether the words are part of a user name, a file, or of the name of a thing."""
        line = text.rfind("\n", 0, a) + 1
        return bool(USER_OR_FILE.search(text, max(line, text.rfind("[", line, a), text.rfind("{", line, a)), a) or THINGS.match(text, b))

    def _apart(self, text: str, a: int, b: int) -> bool:
        """Whether text[a:b] stands as words of its own."""
        return not (a and (text[a - 1].isalnum() or text[a - 1] in "_@.'’/") or b < len(text) and (text[b].isalnum() or text[b] in "_@") or EMAIL_NEXT.match(text, b))

    def _next(self, text: str, at: int) -> re.Match | None:
        return NEXT_WORD.match(text, at)

    def name_at(self, text: str, a: int, b: int) -> Span | None:
        """The name around the known family name text[a:b]: with given names or initials before it, after a comma, or after it."""
        if m := DOUBLED.match(text, b):  # a double family name
            b = m.end()
        if a and text[a - 1] in "-–‑":
            k = a - 1
            while k and (text[k - 1].isalnum() or text[k - 1] in "'’") and a - k <= LONGEST_WORD:
                k -= 1
            if not text[k].isupper():
                return None
            a = k
        if not self._apart(text, a, b):
            return None
        start = None
        for w, word in self._left(text, a):
            if word.endswith(".") or word in self.given or start is None and self._maybe(word) or start is not None and initial and self._maybe(word):
                start, initial = w, word.endswith(".")
                if not initial and word not in self.given:
                    break
            else:
                break
        if start is not None:
            return None if self._not_a_person(text, start, b) else (start, b, "name")
        end = None
        if m := TURNED.match(text, b):
            follows = self._next(text, m.end())
            # "A, B C" is a list of names, not a name turned round
            if m[2]:
                if (m[2] in self.given or self._maybe(m[2]) and not (follows and self._maybe(follows[1]))) and not (follows and follows[1] in self.family):
                    end = m.end()
            elif m[1].strip() and not (follows and follows[1] in self.family):
                end = m.start(1) + len(m[1].rstrip())
            if end and m[2] and m[2] not in self.given and self._left(text, a):
                end = None
        elif (m := AFTER_FAMILY.match(text, b)) and m[1] in self.given and not ((f := self._next(text, m.end())) and f[1] in self.family):
            end = m.end()
        return (a, end, "name") if end and not self._not_a_person(text, a, end) else None

    def name_of_given(self, text: str, a: int, b: int) -> Span | None:
        """The name around the known given name text[a:b] whose family name no list has."""
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@.'’/-"):
            return None
        for w, word in self._left(text, a):
            if word not in self.given and not word.endswith("."):
                break
            a = w
        if (m := FAMILY_AFTER.match(text, b)) and m[1] not in self.family and m[1] not in self.given and self._maybe(m[1].split("-")[0]):
            return (a, m.end(), "name") if self._apart(text, a, m.end()) and not self._not_a_person(text, a, m.end()) else None
        # turned round: a word, a comma, the given name, and then no word that could go with it
        if a > 2 and text[a - 2 : a] == ", " and text[a - 3].isalnum() and not ((f := self._next(text, b)) and self._maybe(f[1])) and CLOSES.match(text, b):
            k = a - 2
            while k and (text[k - 1].isalnum() or text[k - 1] in "'’-–‑") and a - k <= LONGEST_WORD:
                k -= 1
            word = text[k : a - 2]
            if word[:1].isupper() and word not in self.given and word not in self.family and self._maybe(word) and not self._left(text, k) and self._apart(text, k, b):
                e = m.end() if (m := INITIALS.match(text, b)) else b
                return None if self._not_a_person(text, k, e) else (k, e, "name")
        return None

    def person_at(self, text: str, place: int) -> Span | None:
        """A name none of whose parts a list has, which begins at `place`."""
        m = PERSON.match(text, place)
        if not m or not self._apart(text, place, m.end()) or self._not_a_person(text, place, m.end()) or not all(self._maybe(w) and w not in self.given and w not in self.family for w in re.findall(CAP, m[0])):
            return None
        return place, m.end(), "name"

    def before_contact(self, text: str, place: int) -> Span | None:
        """A name none of whose parts a list has, right before the contact that begins at `place`."""
        line = text.rfind("\n", 0, place) + 1
        gap = TO_CONTACT.search(text, max(line, place - LONGEST_WORD), place)
        return self.person_before(text, gap.start() if gap else place, line)

    def person_before(self, text: str, k: int, line: int) -> Span | None:
        """A name none of whose parts a list has, which ends at `k`."""
        while k > line and text[k - 1] in " \t":
            k -= 1
        words = word_starts(text, k, 3) if k > line else []
        for a in words:
            a += len(text[a:k]) - len(text[a:k].lstrip("*#:;([|'\"“„«"))
            m = PERSON.match(text, a)
            # turned round only at the start of a line or cell: "born in Paris, France" is none
            if m and m.end() == k and ("," not in m[0] or not text[line:a].strip(" \t*#:;|")):
                return self.person_at(text, a)
        return None

    def find(self, text: str) -> list[Span]:
        """Spans of every kind, in order and without overlaps: the earlier, then the longer, counts."""
        found: set[Span] = set()
        labels: dict[int, str] = {}
        numbers = 0  # where the last stretch of digits ended
        dots = -1  # the last dot written as a word
        for end, (size, kinds) in self.automaton.iter(text):
            start = end + 1 - size
            for kind in kinds:
                span = None
                if kind == "digits":
                    if start >= numbers:
                        more, numbers = numbers_around(text, start, numbers, labels)
                        found.update(more)
                elif kind == "at":
                    span = email_at(text, start)
                elif kind == "dot":
                    span, dots = email_before(text, start, dots), start
                elif kind == "street":
                    span = address_at(text, start + size // 2)
                elif kind in ("phone", "id", "other"):
                    if not inside_word(text, start):
                        m = (TO_OTHER if kind == "other" else TO_NUMBER).match(text, end + 1)
                        at = m.end()
                        if labels.get(at) not in ("id", "phone") or kind == "id":
                            labels[at] = kind
                        if kind == "id" and (span := id_at(text, at, "id")):
                            found.add(span)
                elif kind == "person":
                    if not inside_word(text, start) and not inside_word(text, end + 1):
                        span = self.person_at(text, TO_PERSON.match(text, end + 1).end())
                elif kind == "after":
                    span = self.person_before(text, start, text.rfind("\n", 0, start) + 1)
                elif kind == "family":
                    span = self.name_at(text, start, end + 1)
                elif not inside_word(text, end + 1):
                    span = self.name_of_given(text, start, end + 1)
                if span:
                    found.add(span)
        for a, _, _ in [s for s in found if s[2] != "name"] if self.given or self.family else ():
            if span := self.before_contact(text, a):
                found.add(span)
        rank = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
        out: list[Span] = []  # in order, apart from each other, so that only neighbours can overlap
        for span in sorted(found, key=lambda s: (rank[s[2]], s[0], -s[1])):
            k = bisect_left(out, span)
            if (k == 0 or out[k - 1][1] <= span[0]) and (k == len(out) or span[1] <= out[k][0]):
                out.insert(k, span)
        return out


EMAIL_NEXT = re.compile(r"\s?[(\[]at[)\]]|&#64;|\.[a-z]")
NEXT_WORD = re.compile(rf"[ ]+(?:{INITIAL}[ ]?)*({CAP})")
DOUBLED = re.compile(rf"[-–‑]({CAP})")
TURNED = re.compile(rf",[ ]+((?:{INITIAL}[ ]?)*)({CAP})?((?:[ ]{INITIAL})*)")
AFTER_FAMILY = re.compile(rf"[ ]+({CAP})((?:[ ]{INITIAL})*)(?![\w@])")
FAMILY_AFTER = re.compile(rf"[ \t]+(?:{INITIAL}[ ]?)*({DOUBLE})")
INITIALS = re.compile(rf"(?:[ ]{INITIAL})+")
CLOSES = re.compile(rf"(?:[ ]{INITIAL})*(?:[ ]*(?:\Z|[\n–—(|,.?!;:<&|-]|\|\||(?:again|at|can|lives|est|ist|on)\b))")


@lru_cache(maxsize=2)
def _made(given: tuple[str, ...], family: tuple[str, ...]) -> Finder:
    return Finder(given, family)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def _finder(documents: DataFrame, name_parts: DataFrame, most_parts: int) -> tuple:
    """The name parts as a broadcast, after a check of their number."""
    parts = name_parts.select(F.trim("name_part").alias("part"), "part_kind").where("part is not null and part <> ''").distinct()
    held = parts.limit(most_parts + 1).collect()
    if len(held) > most_parts:
        raise ValueError(f"there are more than {most_parts} name parts")
    kinds = tuple(tuple(sorted(r["part"] for r in held if r["part_kind"] == k)) for k in ("given", "family"))
    return documents.sparkSession.sparkContext.broadcast(kinds)


def personal_spans(documents: DataFrame, name_parts: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_parts: int = 200_000) -> DataFrame:
    """(doc_id, start_pos, end_pos, kind): email and street addresses, phone and identity numbers and personal names.

    One automaton over at-signs and their other spellings, street words, cues of phones and identity numbers, pairs of
    digits, known name parts and words that a person's name follows finds places; parsers expand each to its boundaries,
    however far these are, and validate it (domains, digit counts, check digits, dates). A name is a given name or initial
    with a family name: one part must be known, or the words stand after such a word or right before a contact. Words of
    addresses and names have at most 100 characters. Where spans overlap, one stays: emails first, then identity numbers,
    phones, addresses, names. Positions are 0-based, in characters.

    Only the name parts are sent to the workers, at most `most_parts`; texts are scanned where they lie, without a shuffle.

    Defined cases: null and empty texts give none; repeated documents are each reported; without name parts no names are
    found; an empty table gives no rows; other columns are not read.
    """
    sent = _finder(documents, name_parts, most_parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _made(*sent.value)
        for b in batches:
            found = [(d, *span) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for span in finder.find(t)]
            if found:
                yield pa.record_batch(dict(zip(("doc_id", "start_pos", "end_pos", "kind"), map(list, zip(*found, strict=True)), strict=True)))

    return documents.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string")).mapInArrow(scan, "doc_id long, start_pos long, end_pos long, kind string")


def without_personal(documents: DataFrame, name_parts: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_parts: int = 200_000) -> DataFrame:
    """(doc_id, text, n_replaced): each text with what personal_spans finds replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    All else stays as it is. Null texts stay null; the other cases are those of personal_spans.
    """
    sent = _finder(documents, name_parts, most_parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _made(*sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [finder.find(t) if t else [] for t in texts]
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()), "n_replaced": pa.array([len(s) for s in spans], pa.int64())})

    return documents.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string")).mapInArrow(scan, "doc_id long, text string, n_replaced long")
