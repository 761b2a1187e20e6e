"""Personal data inside free text: found, counted and replaced.

Detection is by form, most certain kind first: e-mail addresses, street addresses, identity numbers,
phone numbers and then names; what one kind has taken no later kind sees, so a name in an
address or a street doesn't count. Names are told by given names, initials, titles, forms of address, the endings of
surnames, and the places where people stand in a sentence.

Replacement is keyed: an entity's replacement is drawn from a keyed hash of its canonical form, so
one entity gets one replacement wherever it stands and in whatever case or layout, and
nobody without the key can trace it back. A part of a name (a surname with a title, a given name, an initial
and a surname) stands for the full name that its record has, if only one fits, and gets that part of its surrogate. A placeholder names the type; a surrogate
keeps the form instead: digits, separators, case, script and the gender of a given name. Replacements of
different entities that fall together, or on an entity of the input, are found over the whole input and drawn again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_with_hot_keys, written

#: Given names by the gender they are mostly given to; the surrogates are drawn from them too.
FEMALE = (
    "Sanna Noemi Ingrid Anneke Odile Chiara Farah Ayumi Mirela Greta Petra Rosalind Hanne Priya Leila Katrin Lucia Yuki Marisol Nadia "
    "Amara Paloma Aisling Valeria Elif Zofia Anna Maria Elena Laura Sofia Julia Clara Emma Olivia Alice Fatima Aisha Mei Hana Olga Irina Svetlana Marta Ines "
    "Carmen Isabel Camille Amelie Helene Birgit Heike Sabine Monika Agnieszka Katarzyna Ewa Magdalena Deborah Susan Linda Karen Nancy Emily Sarah Hannah Rachel Naomi Freya Astrid"
).split()
MALE = (
    "Viktor Kofi Ruben Jorun Bastian Olek Tomasz Tobias Lennart Mateo Rafael Felipe Benoit Kwame Teodor Ishaan Joaquin Milos Emre Soren "
    "Henrik Idris Dragan Dietmar Thomas David Daniel Michael Peter Paul Martin Andreas Stefan Juergen Wolfgang Matthias Pierre Antoine Julien Etienne Carlos Diego Javier Pablo Miguel "
    "Sergei Dmitri Ivan Nikolai Ahmed Omar Hassan Yusuf Rajesh Arjun Vikram Hiroshi Kenji Takeshi Wei Piotr Krzysztof Andrzej James Robert William Richard Joseph Charles Edward George Kevin Brian"
).split()
SYLLABLES = ("Abel Ber Cal Des Eld Fab Gar Hes Il Jor Kes Lom Mar Nes Ov Per".split(), "a e i o u ar en il on ur".split(), "bek dal fen gor lin mor nik ram sel tan vel wick".split())
#: Given names, surnames' beginnings and ends of other scripts, for surrogates.
CYRILLIC = ("Анна Мария Ольга Елена Ирина Дарья Вера Нина Софья Тамара".split(), "Иван Пётр Павел Сергей Андрей Олег Юрий Максим Роман Фёдор".split(), ("Бел Вор Гор Дуб Ерм Зим Кал Лав Мор Нов".split(), "ан ар ен ер ил ин ол он ор ух".split(), "ёв ин ов ский".split()))
JAPANESE = ("花美由千真里菜香葉結", "太郎健一翔大介誠隆浩", ("田中山川森林原松竹梅石高小大北南西東上下", "村本井野島崎沢口谷橋"))
STREETS = "Alder Birch Cedar Dogwood Elder Hazel Larch Myrtle Poplar Rowan Spruce Willow".split()
TOWNS = "Arnbeck Bellmore Carrow Dalvern Eastmere Fernhill Glenmoor Hartwell".split()

#: Rounds of draws after which numbers get longer, by a digit a round; names and streets do from the first round on.
WIDER = 4
KINDS = ("email", "address", "id_number", "phone", "person_name")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str


_TLD = r"(?:[a-z]{2,18})"
_AT = r"(?:@|\s?(?:\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\}|<at>|＠|&#64;|%40)\s?)"
_DOT = r"(?:\.|\s?(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\}|<dot>)\s?)"
_EMAIL = re.compile(
    rf"(?<![\w.+@/-])[\w](?:[\w.+'-]*[\w+])?(?:{_DOT}[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}{_TLD}\b(?!\.\w|:[\w~./-]+/|[\w@-])"
    rf"|(?<![\w.+@/-])[\w][\w.+-]*\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+\b",
    re.I,
)
_UNIT = r"(?:,?\s+(?:Apt|Suite|Ste|Unit|Flat|Room|Floor|APT|SUITE|UNIT|FLAT|apt|suite|unit|flat)\.?\s*#?\w{1,5}|,\s*(?:bajo|BAJO|ático|\d{1,2}\s?[ºª°]\s?\w{0,2}))"
_W = r"(?:[A-ZÀ-ÖØ-Ý][\w'’-]*|[A-Z]{2,})"
_TW = r"(?:[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿß'’]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)*|[A-ZÀ-ÖØ-Ý]{3,}(?:-[A-Z]+)*)"
_MORE = rf"(?:\s(?:(?:am|an der|im|de|del|la|el|sur|sous|AM|DE|DEL|LA)\s{_TW}|{_TW}(?=[,.;:\n\"<)]|\s[A-Z]{{2}}\d?\s\d|$)))?"
_TOWN = rf"(?:,?\s+\d{{4,5}}\s+{_TW}{_MORE}|,\s*{_TW}{_MORE})?(?:,?\s+(?:[A-Z]{{2}}\s\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}))?"
_US = r"(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Close|Crescent|Mews|Row|Way|Place|Pl|Square|Sq|Terrace|Gardens|Parkway|Pkwy|Grove|Walk)"
_DE = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|damm|ring|ufer|STRASSE|STRAẞE|STR\.|GASSE|WEG|ALLEE|PLATZ)"
_FR = r"(?:rue|avenue|chemin|boulevard|bd|allée|place|impasse|quai|route|cours|Rue|Avenue|Chemin|Boulevard|Allée|Place|Impasse|Quai|RUE|AVENUE|CHEMIN|BOULEVARD|ALLÉE|PLACE|IMPASSE|QUAI)"
_OF = r"(?:de la |des |du |de |d['’]|de l['’]|DE LA |DES |DU |DE |D['’]|DE L['’])"
_ES = r"(?:C/|Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrer|Ronda|CALLE|AVENIDA|PLAZA|PASEO|CAMINO)"
_ESOF = r"(?:de la |de los |de las |del |de |la |las |los |DE LA |DE LOS |DEL |DE )?"
_ADDRESS_CORES = (
    rf"(?<![\w./-])\d{{1,5}}[A-Za-z]?\s+(?:(?:[NSEW]\.?|North|South|East|West|NORTH|SOUTH|EAST|WEST)\s+)?(?:(?:{_W}\s+){{1,3}}{_US}\b\.?|(?:[A-Z]{{3,}}\s+){{1,3}}{_US.upper()}\b\.?(?=,))",
    rf"(?<!\w)[A-ZÄÖÜ][\wäöüß-]*\s?{_DE}\s+\d{{1,4}}\s?[a-zA-Z]?\b",
    rf"(?<![\w./-])\d{{1,4}}(?:\s?(?:bis|ter|quater|BIS|TER))?,?\s+{_FR}\s+{_OF}\s?(?:{_OF})?{_W}(?:[\s-]{_W}){{0,2}}",
    rf"(?<!\w){_ES}\s*{_ESOF}{_W}(?:\s{_W})?,?\s+(?:n[.º°]\s*)?\d{{1,4}}\b",
)
_ADDRESS = re.compile("(?:" + "|".join(_ADDRESS_CORES) + ")" + _UNIT + "?" + _TOWN)
# a text all in lower case: only with a town or code behind it
_ADDRESS_LOW = re.compile(
    rf"(?<![\w./-])(?:\d{{1,5}}[a-z]?\s+(?:(?:[nsew]\.?|north|south|east|west)\s+)?(?:[a-z'-]+\s+){{1,2}}{_US.lower()}\b\.?(?:,?\s+(?:apt|suite|unit|flat)\.?\s*\w{{1,5}},\s*[a-z]+|,\s*[a-z]+(?:\s[a-z]+)?,?\s+[a-z]{{2}}\d?\s\d\w{{2,4}})(?:,?\s+[a-z]{{2}}\d?\s\d\w{{2,4}})?"
    rf"|[a-zäöü-]+\s?{_DE.lower()}\s+\d{{1,4}}\s?[a-z]?,\s*\d{{5}}\s[a-zäöüß]+"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+{_FR.lower()}\s+{_OF.lower()}\s?(?:{_OF.lower()})?[a-zé-]+(?:[\s-][a-zé]+)?,\s*\d{{5}}\s[a-zé-]+"
    rf"|(?:c/|calle|avenida|plaza|paseo)\s*{_ESOF}[a-zñ]+,?\s+\d{{1,4}}\b(?:,\s*(?:bajo|\d{{1,2}}\s?º\s?\w?))?,\s*\d{{5}}\s[a-zñ]+)"
)
_ID = re.compile(
    r"(?<![\w./+-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Za-z]{2}(?P<s>[ -]?)\d{2}(?P=s)\d{2}(?P=s)\d{2}(?P=s)[A-Da-d]|[Xx]\d{7,8}|[Xx]{2}\d{6}[A-Za-z]|\d{8}-?[A-Za-z]|\d{11})(?![\w/-]|\.\d)"
    r"|(?:(?<=passport )|(?<=passport no. )|(?<=document )|(?<=card )|(?<=card no. )|(?<=Ausweis ))(?=[A-Z]*\d)[A-Z0-9]{8,11}\b",
)
_EXT = r"(?:,?\s*(?:ext\.?|extension|x|Ext\.?|EXT\.?|Durchwahl|poste)\s*\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w./+-])(?:\+\d{1,3}[\s.-]?\(?\d{1,4}\)?(?:[\s./-]?\d{2,6}){1,6}|00\d{10,13}|\(\d{3}\)\s?\d{3}[\s.-]\d{4}|\d{3}(?P<a>[.-])\d{3}(?P=a)\d{4}|\d{3} \d{3} \d{4}|\(?0\d{2,4}\)?[ /-]\d{3,6}[ -]\d{2,4}|0\d(?:(?P<b>[ .-])\d\d)(?:(?P=b)\d\d){3}|\+\d{10,14})" + _EXT + r"(?![\w/]|-\d|\.\d)",
)
_GIVEN = {n.casefold(): g for g, ns in (("f", FEMALE), ("m", MALE)) for n in ns}
_G = "(?:" + "|".join(sorted({n for n in FEMALE + MALE}, key=len, reverse=True)) + ")"
_GANY = f"(?i:{_G})"
_S1 = r"(?:(?:Mc|Mac|O'|O’|D'|De|Di|Van|Von|Le|La)\s?)?[A-ZÀ-ÖØ-Ý](?:[a-zà-öø-ÿß]{2,}|[A-ZÀ-ÖØ-Ý]{2,})"
_S = rf"(?:{_S1}(?:-{_S1})?)"
_SLOW = r"(?:[a-zà-öø-ÿß]{4,}(?:-[a-zà-öø-ÿß]{4,})?)"
_NAME = re.compile(
    rf"(?<![\w/._+-])(?:{_GANY}(?: [A-Z]\.)? {_S}|{_S}, {_GANY}(?: [A-Z]\.)?|{_GANY}(?: [A-Z]\.)? {_SLOW}(?=[ .,;:!?\"')<(]|$)|{_SLOW}, {_GANY}|{_GANY} [A-Z]\.|(?:[A-Z]\.\s?){{1,2}}{_S}|{_GANY})(?![\w/@_+]|\.\w|-\w)"
    rf"|(?<=Ms ){_S}|(?<=Mr ){_S}|(?<=Dr ){_S}|(?<=Mrs ){_S}|(?<=Dr\. ){_S}|(?<=Mr\. ){_S}|(?<=Ms\. ){_S}|(?<=MS ){_S}|(?<=DR\. ){_S}|(?<=Herr ){_S}|(?<=Frau ){_S}|(?<=Mme ){_S}|(?<=Prof\. ){_S}|(?<=Señor ){_S}|(?<=Señora ){_S}"
)
#: The same with titles in lower case, for texts all in lower case.
_LOW_NAME = re.compile(_NAME.pattern + rf"|(?<=\bms ){_SLOW}|(?<=\bmr ){_SLOW}|(?<=\bmrs ){_SLOW}|(?<=\bdr ){_SLOW}|(?<=\bms\. ){_SLOW}|(?<=\bmr\. ){_SLOW}|(?<=\bdr\. ){_SLOW}|(?<=\bprof\. ){_SLOW}")
_LOW_TITLE = re.compile(r"(?:^|[^\W\d_] |[^\w\s] )(?:ms|mrs?|dr|prof)\.? $")
#: Names of which no part is known: two capitalised words where a person is addressed, named as the doer, or does what people do.
_C = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ][a-zà-öø-ÿ'’-]*"
_PAIR = rf"{_C} (?:[A-Z]\. )?{_C}"
_ROLE = re.compile(
    rf"(?:(?:^|(?<=[.!?:;\n] ))(?i:cc|attn|ask|ping|thanks|thank you|dear|hi|hello|contact)|\b(?:cc|attn|ask|ping|thanks|dear|contact|told|(?:[Rr]eported|[Ww]ritten|[Aa]pproved|[Rr]eviewed|[Ss]igned|[Oo]wned|[Aa]ssigned|[Rr]aised|[Ff]iled|[Ss]uggested) (?:by|to))|\b(?i:owner|author|assignee|reviewer|on call):)[:,]? ({_PAIR})(?![\w/@-])"
    rf"|(?<![\w./@-])({_PAIR}) (?:asked|said|says|wrote|writes|thinks|wants|approved|reviewed|reported|replied|signed|confirmed|agreed|agrees|disagrees?|suggested|noted|told)\b",
)
_ROLE_WORDS = frozenset("cc attn ask ping thanks thank dear hi hello contact told reported written approved reviewed signed owned assigned raised filed suggested owner author assignee reviewer call "
                        "asked said says wrote writes thinks wants replied confirmed agreed agrees disagree disagrees noted".split())  # fmt: skip
_HAS_PAIR = re.compile(_PAIR)
_NO_NAME = frozenset("the a an of with from for this that these those we they it its our your their all any each every no not new old on in at by to and or but if when while where which who what how is are was were be has have had do does did can will please also then after before since over under".split())
_SLAVIC = re.compile(r"(?<!\w)[А-ЯЁ](?:[а-яё]+|\.) ?(?:[А-ЯЁ](?:[а-яё]+(?:вич|вна|чна)|\.) ?)?[А-ЯЁ][а-яё]+(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|чук|юк|як|ян|дзе|швили)(?!\w)")
_HONORED = re.compile(r"(?:[一-龠々]{2,4}(?:[ 　]?[一-龠々ぁ-ん]{1,4})??|[ァ-ヶー]{2,12}(?:[・ 　=][ァ-ヶー]{2,12}){0,2})(?=さん|様|氏(?![名])|先生|殿(?!堂))")
_OTHER_SCRIPT = re.compile(r"[А-Яа-яЁё]|さん|様|氏|先生|殿")
#: Words that follow a given name in a sentence and are no surnames (of a text in lower or upper case).
_NO_SURNAME = frozenset(
    "and or but before until asked thinks moved says said wants reproduced signed can could will would on at in from for to of the is was are with about by said has had have please today this that "
    "if when while where who what as an not be been let lets review reviewed approved wrote writes owner keep show see relates context works now lives disagree disagrees".split()
)
_CAN_BE_WORD = frozenset("may will mark grace rose hope summer june april iris ivy wei".split())
# what must be in a text for the long patterns to be tried on it
_HAS_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\sdot\s|＠|&#64;|%40", re.I)
_HAS_STREET = re.compile(r"\d\s?[A-Za-z]?\s+(?:\w+\.?\s+){0,4}?(?:Str|St\b|R[od]|Av|B[lo]|L[an]|D[r]|C[ltr]|M[ew]|Ro|Wa|P[lk]|S[q]|Te|Ga|Gr|Pa)|str\.|stra(?:ß|ss)e|gasse\s|weg\s|allee\s|platz\s|damm\s|ring\s\d|ufer\s|\d\s?(?:bis|ter)?,?\s(?:rue|avenue|chemin|boulevard|bd|allée|place|impasse|quai|route|cours)\s|C/|Calle|Avenida|Avda|Av\.|Plaza|Paseo|Camino|Carrer|Ronda")
_HAS_NUMBER = re.compile(r"\d[\d ().\-/+]{5,}\d|[A-Za-z]\d{6}")
_HAS_PERSON = re.compile(r"(?<![\w.])[A-Z]\.\s?[A-ZÀ-Ý][A-Za-zà-ÿ]|\b(?:Ms|Mrs?|Dr|Herr|Frau|Mme|Prof|Señora?|MS|DR)\b")
_HAS_LOW_TITLE = re.compile(r"(?<!\d )\b(?:ms|mrs?|dr|prof)\.? [a-z]")
_LETTERS = re.compile(r"[^\W\d_]+")
_INITIAL_BEFORE = re.compile(r"(?:^|[\s(<\"'“:;,>{\[|])$")


def _role_spans(text: str) -> list[tuple[int, int]]:
    """Names told by their place or by their script alone."""
    out = [m.span(1) if m.group(1) else m.span(2) for m in _ROLE.finditer(text)]
    out = [(a, b) for a, b in out if not any(w.casefold() in _NO_NAME for w in _LETTERS.findall(text[a:b]))]
    if _OTHER_SCRIPT.search(text):
        out += [m.span() for p in (_SLAVIC, _HONORED) for m in p.finditer(text)]
    return out


def _name_spans(text: str) -> list[tuple[int, int]]:
    out = []
    low_text = text.islower()
    name = _LOW_NAME if low_text else _NAME
    at = 0
    while m := name.search(text, at):
        a, b = m.span()
        said = m.group(0)
        words = said.replace(",", " ").split()
        given = [w for w in words if w.strip(".").casefold() in _GIVEN]
        low = said.split(", ")[0] if ", " in said else said.split(" ")[-1]
        if given and ", " in said and low.split()[-1].casefold().split("-")[0] not in _GIVEN:
            before = low.casefold()
            # 'surname, given' against a list of a word and a name: a surname is not an ordinary word
            if before in _NO_SURNAME or (low == before and not text[max(0, a - 1) : a].isspace() and a):
                a = text.index(given[-1], a) if given[-1] in text[a:b] else a
        elif given and len(words) > 1 and low.casefold().strip(".") in _NO_SURNAME:
            b = a + said.rindex(low)
            b = a + len(text[a:b].rstrip())
        elif given and len(words) > 1 and low == low.lower() and not low.endswith(".") and given[0] != given[0].lower():
            b = a + len(given[0])  # a capitalised given name before a word in lower case stands alone
        elif not given and said == said.lower() and (not low_text or said in _NO_SURNAME or not _LOW_TITLE.search(text[max(0, a - 9) : a])):
            at = b
            continue
        elif not given and not words[0].endswith(".") and not text[:a].rstrip(". ").endswith(("Ms", "Mr", "Dr", "Mrs", "MS", "DR", "Herr", "Frau", "Mme", "Prof", "Señor", "Señora", "ms", "dr")):
            at = b
            continue
        elif not given and words[0].endswith(".") and (len(words[0]) < 2 or not _INITIAL_BEFORE.search(text[:a])):
            at = b
            continue
        if given and len(words) == 1 and said == said.lower() and said in _CAN_BE_WORD:
            at = b
            continue
        out.append((a, b))
        at = b
    return out


def find(text: str | None) -> list[Found]:
    """Occurrences in a text, in order. Null and empty texts have none."""
    if not text:
        return []
    taken = text
    out: list[Found] = []

    def take(kind: str, spans: list[tuple[int, int]]) -> None:
        nonlocal taken
        for a, b in spans:
            out.append(Found(a, b, kind))
            taken = taken[:a] + "\x00" * (b - a) + taken[b:]

    if _HAS_AT.search(text):
        take("email", [m.span() for m in _EMAIL.finditer(taken)])
    upper, lower = text.isupper(), text.islower()
    if upper or lower or _HAS_STREET.search(text):
        take("address", [m.span() for m in (_ADDRESS_LOW if lower else _ADDRESS).finditer(taken)])
    if _HAS_NUMBER.search(taken):
        take("id_number", [m.span() for m in _ID.finditer(taken)])
        take("phone", [m.span() for m in _PHONE.finditer(taken)])
    words = set(_LETTERS.findall(taken.casefold()))
    if not _GIVEN.keys().isdisjoint(words) or _HAS_PERSON.search(taken) or lower and _HAS_LOW_TITLE.search(taken):
        take("person_name", _name_spans(taken))
    if not _ROLE_WORDS.isdisjoint(words) and _HAS_PAIR.search(taken) or _OTHER_SCRIPT.search(taken):
        take("person_name", _role_spans(taken))
    return sorted(out, key=lambda f: f.start)


def canonical(kind: str, said: str) -> str:
    """One form for all ways to write one entity."""
    x = said.casefold()
    if kind == "email":
        x = re.sub(r"\s*(?:\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\}|<at>|＠|&#64;|%40|\sat\s)\s*", "@", x)
        return re.sub(r"\s*(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\}|<dot>|\sdot\s)\s*", ".", x)
    if kind == "person_name":
        last, comma, first = x.partition(", ")
        return f"{first} {last}" if comma else x
    return re.sub(r"[\W_]+", "", x)


class Keyed:
    """Keyed draws for an entity: the same for the same key, kind, entity and round."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def bits(self, kind: str, entity: str, round_: int) -> bytes:
        return hmac.new(self.key, f"{kind}\0{entity}\0{round_}".encode("utf-8", "surrogatepass"), hashlib.sha512).digest()

    def placeholder(self, kind: str, said: str, round_: int = 0) -> str:
        return f"[{kind.upper()}_{self.bits(kind, canonical(kind, said), round_)[: 5 + round_].hex()}]"

    def surrogate(self, kind: str, said: str, round_: int = 0, entity: str | None = None) -> str:
        """Another value of the same form: digits for digits, names of the same gender, script and layout, the same case. entity is the
        canonical full form where said is a part of it."""
        entity = canonical(kind, said) if entity is None else entity
        first_widened = True

        def stream(role: str) -> Iterator[int]:
            """Bytes for a part of the entity, whatever stands before that part in the layout at hand."""
            for k in count():
                yield from self.bits(kind, f"{entity}\0{role}\0{k}", round_)

        pick = lambda draws, xs: xs[(next(draws) << 8 | next(draws)) % len(xs)]

        def cased(new: str, old: str) -> str:
            return new.upper() if old.isupper() and len(old) > 1 else new.lower() if old.islower() else new

        def digits(x: str) -> str:
            draws, at = stream("digits"), count()

            def one(m: re.Match) -> str:
                zero = ord(m.group(0)) - unicodedata.digit(m.group(0))
                return m.group(0) if next(at) == 0 and ord(m.group(0)) == zero else chr(zero + next(draws) % 10)

            return re.sub(r"\d", one, x) + "".join(str(next(draws) % 10) for _ in range(round_ - WIDER))

        def more(draws: Iterator[int]) -> str:
            """Syllables by which the draws of a later round are more than those of the round before."""
            return "".join(pick(draws, x) for _ in range(round_) for x in SYLLABLES[1:])

        def surname(draws: Iterator[int], wide: bool = True) -> str:
            return "".join(pick(draws, x) for x in SYLLABLES) + (more(draws) if wide else "")

        if kind == "person_name":
            whole = _LETTERS.findall(entity)
            widened = max((r for r, w in enumerate(whole) if len(w) > 1), default=-1)
            left = list(range(len(whole)))

            def role(w: str) -> int:
                """Which word of the full name a written word is; an initial stands for the word that it begins."""
                w = w.casefold()
                at = next((r for r in left if whole[r] == w), None)
                at = next((r for r in left if len(w) == 1 and whole[r].startswith(w)), len(whole)) if at is None else at
                if at in left:
                    left.remove(at)
                return at

            def new_word(at: int, old: str) -> str:
                wide = more if at == widened else (lambda draws: "")
                draws, gender = stream(str(at)), _GIVEN.get(old)
                if "А" <= old[0].upper() <= "Я" or old[0] in "ёЁ":
                    women, men, parts = CYRILLIC
                    if at == 0 and len(whole) > 1:
                        return pick(draws, women if whole[-1].endswith(("а", "я")) else men)
                    end = pick(draws, parts[2])
                    end = {"ский": "ская"}.get(end, end + "а") if old.endswith(("а", "я")) else end
                    return pick(draws, parts[0]) + "".join(pick(draws, parts[1]) for _ in range(1 + (round_ if at == widened else 0))) + end
                if "\u3041" <= old[0] <= "\u30ff":
                    return "".join(chr(0x30AB + next(draws) % 40) for _ in range(len(old) + (round_ if at == widened else 0)))
                if "\u3400" <= old[0] <= "\u9fff":
                    if at and len(whole) > 1:
                        return "".join(pick(draws, JAPANESE[next(draws) % 2]) for _ in range(max(1, len(old))))
                    return "".join(pick(draws, JAPANESE[2][k % 2]) for k in range(len(old) + (round_ if at == widened else 0)))
                if gender or at == 0 and len(whole) > 1:
                    return pick(draws, FEMALE if gender == "f" else MALE if gender else FEMALE + MALE) + wide(draws)
                return surname(draws, at == widened)

            def word(m: re.Match) -> str:
                w = m.group(0)
                at = role(w)
                old = whole[at] if at < len(whole) else w.casefold()
                if len(old) == 1:
                    pool = "АБВГДЕИКЛМНОПРСТ" if "А" <= old.upper() <= "Я" else "ABCDEFGHJKLMNPRSTVW"
                    return cased(pool[next(stream(str(at))) % len(pool)], w) if old.isascii() or "А" <= old.upper() <= "Я" else new_word(at, old)
                new = new_word(at, old)
                return cased(new[:1] if len(w) == 1 else new, w)

            return _LETTERS.sub(word, said)
        if kind == "email":
            draws = stream("email")
            return cased(f"{pick(draws, FEMALE + MALE)}.{surname(draws)}{next(draws) % 100}@{pick(draws, STREETS)}.example".lower(), said)
        if kind == "address":
            keep = re.compile(rf"^(?:{_US}|{_DE}|{_FR}|{_ES}|apt|suite|unit|flat|bis|ter|bajo|de|la|des|du|del|los|las|el|am|der|im|n|s|e|w|[nsew]\.?|.{{1,2}})$", re.I)

            def swap(m: re.Match) -> str:
                nonlocal first_widened
                if keep.match(m.group(0)):
                    return m.group(0)
                draws = stream(str(len(canonical(kind, said[: m.start()]))))
                new, first_widened = pick(draws, STREETS + TOWNS) + (more(draws) if first_widened else ""), False
                return cased(new, m.group(0))

            return digits(_LETTERS.sub(swap, said))
        if kind == "id_number":
            said = re.sub(r"(?<![A-Za-z])[A-Za-z](?=-?$)", lambda m: cased("ABCD"[next(stream("letter")) % 4], m.group(0)), said)
        return digits(said)


def entities(text: str, found: list[Found]) -> list[str]:
    """The canonical entity of each occurrence; a part of a name stands for the text's only full name that has it."""
    own = [canonical(f.kind, text[f.start : f.end]) for f in found]
    full = {n: _LETTERS.findall(n) for f, n in zip(found, own, strict=True) if f.kind == "person_name" and sum(len(w) > 1 for w in _LETTERS.findall(n)) > 1}

    def resolved(name: str) -> str:
        words = _LETTERS.findall(name)
        fits = [n for n, whole in full.items() if n != name and len(whole) >= len(words) and all(any(x == w or len(w) == 1 and x.startswith(w) for x in whole) for w in words)]
        return fits[0] if len(fits) == 1 and any(len(w) > 1 for w in words) else name

    return [resolved(n) if full and f.kind == "person_name" and n not in full else n for f, n in zip(found, own, strict=True)]


_OCCURRENCE = pa.schema([("part", pa.string()), ("id", pa.int64()), ("kind", pa.string()), ("no", pa.int32()), ("said", pa.string()), ("entity", pa.string())])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for part, rid, text in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "text")), strict=True):
            seen: dict[str, int] = {}
            got = find(text)
            for f, entity in zip(got, entities(text, got) if got else [], strict=True):
                seen[f.kind] = seen.get(f.kind, 0) + 1
                rows.append((part, rid, f.kind, seen[f.kind], text[f.start : f.end], entity))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OCCURRENCE)], schema=_OCCURRENCE)


def occurrences(records: DataFrame) -> DataFrame:
    """part, id, kind, no, said, entity: every occurrence in text, numbered from 1 within the record and kind.

    records: part, id, text. Null and empty texts give none; repeated rows repeat their occurrences.
    Texts are read whole; rows never meet, so nothing is shuffled.
    """
    return records.select("part", "id", "text").mapInArrow(_occurrences, "part string, id long, kind string, no int, said string, entity string")


_ENTITY = "kind string, entity string, said string, round int, again boolean, drawn string"


def _draws(key: str, surrogates: bool):
    """Draws of new entities and of those that draw again; the others keep theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Keyed(key.encode())
        for batch in batches:
            made = []
            for kind, entity, said, r, again, drawn in zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "said", "round", "again", "drawn")), strict=True):
                if again:
                    drawn = canonical(kind, k.surrogate(kind, entity if kind == "person_name" else said, r, entity)) if surrogates else k.placeholder(kind, entity, r)
                made.append(drawn)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "entity", "said", "round", "again")), pa.array(made, pa.string())], names=["kind", "entity", "said", "round", "again", "drawn"])

    return run


def redrawn(held: DataFrame, key: str, surrogates: bool) -> DataFrame:
    """kind, entity, round: the entities that don't keep their first draw, because another entity has the same, or it is itself an entity of the input.

    held: kind, entity, said of all occurrences. Of the entities that share a replacement the first keeps it and the others draw again, until none share one.
    """
    named = held.groupBy("kind", "entity").agg(F.min("said").alias("said"))
    now = named.select("kind", "entity", "said", F.lit(0).alias("round"), F.lit(True).alias("again"), F.lit(None).cast("string").alias("drawn"))
    while True:  # ends, as each round draws from a larger space
        drawn = written(now.mapInArrow(_draws(key, surrogates), _ENTITY), "drawn")
        who = F.struct("round", "entity")
        values = drawn.select("kind", F.col("drawn").alias("value"), who.alias("who"), F.lit(False).alias("real"))
        values = values.unionByName(drawn.select("kind", F.col("entity").alias("value"), F.lit(None).cast(values.schema["who"].dataType).alias("who"), F.lit(True).alias("real")))
        shared = values.groupBy(F.col("kind"), F.col("value").alias("drawn")).agg(F.min("who").alias("first"), F.count("who").alias("n"), F.max("real").alias("real")).filter("n > 1 or n = 1 and real")
        met = drawn.drop("again").join(shared, ["kind", "drawn"], "left")
        again = F.coalesce(F.col("real") | (F.col("entity") != F.col("first.entity")), F.lit(False))
        now = written(met.select("kind", "entity", "said", (F.col("round") + again.cast("int")).alias("round"), again.alias("again"), "drawn"), "entities")
        if now.filter("again").isEmpty():
            return now.filter("round > 0").select("kind", "entity", "round")


def replacements(records: DataFrame, key: str, surrogates: bool = True) -> DataFrame:
    """occurrences() with the replacement of each: a surrogate of the same form (or a placeholder), distinct for distinct entities of the whole input."""
    held = written(occurrences(records), "occurrences")
    clash = written(redrawn(held, key, surrogates), "redrawn")
    met = join_with_hot_keys(held, clash, "entity", "left", also=["kind"])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Keyed(key.encode())
        for batch in batches:
            cols = zip(*(batch.column(c).to_pylist() for c in ("kind", "said", "entity", "round")), strict=True)
            made = [k.surrogate(kind, said, r or 0, entity) if surrogates else k.placeholder(kind, entity, r or 0) for kind, said, entity, r in cols]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in _OCCURRENCE), pa.array(made, pa.string())], names=[*_OCCURRENCE.names, "replacement"])

    return met.mapInArrow(replace, "part string, id long, kind string, no int, said string, entity string, replacement string")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column("text").to_pylist():
            got = find(text)
            spans.append([{"a": f.start, "b": f.end, "kind": f.kind, "said": text[f.start : f.end], "entity": e} for f, e in zip(got, entities(text, got) if got else [], strict=True)])
        yield batch.append_column("spans", pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("said", pa.string()), ("entity", pa.string())]))))


def masked(records: DataFrame, key: str, surrogates: bool = False) -> DataFrame:
    """part, id, text, found: each text with its occurrences replaced by keyed placeholders (or surrogates), all else unchanged, and how many there were.

    A null text stays null. Each text is searched once. Entities whose replacements fall together are drawn again: records that hold such
    an entity are joined with its new draw.
    """
    held = written(records.select("part", "id", "text").mapInArrow(_spans, "part string, id long, text string, spans array<struct<a: int, b: int, kind: string, said: string, entity: string>>"), "spans")
    each = held.select("part", "id", F.explode("spans").alias("s")).select("part", "id", "s.kind", "s.entity", "s.said")
    clash = written(redrawn(each, key, surrogates), "redrawn")
    if clash.isEmpty():
        rows = held.withColumn("rounds", F.lit(None).cast("map<string,int>"))
    else:
        rounds = join_with_hot_keys(each.select("part", "id", "kind", "entity").distinct(), clash, "entity", also=["kind"])
        own = rounds.groupBy("part", "id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "entity"), "round"))).alias("rounds"))
        rows = held.join(own, ["part", "id"], "left").select(*held.columns, "rounds")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Keyed(key.encode())
        for batch in batches:
            texts, counts = [], []
            for text, spans, rounds in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("rounds").to_pylist(), strict=True):
                again = dict(rounds or [])
                out, at = [], 0
                for f in spans:
                    r = again.get(f"{f['kind']}\0{f['entity']}", 0)
                    out += [text[at : f["a"]], k.surrogate(f["kind"], f["said"], r, f["entity"]) if surrogates else k.placeholder(f["kind"], f["entity"], r)]
                    at = f["b"]
                texts.append(None if text is None else "".join(out) + text[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["part", "id", "text", "found"])

    return rows.mapInArrow(replace, "part string, id long, text string, found int")
