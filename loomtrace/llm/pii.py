"""Personal information in free text: found by form and context, replaced by typed placeholders or by surrogates.

Detection runs over Arrow batches. One linear-time pass (RE2, and an automaton of the known name parts) picks the texts
that can hold anything; only these are searched entity by entity. Names are told by what stands around them (labels,
titles, greetings, closings, introductions, what people do) or by known parts, in any script that has capitals; in
others by labels. Replacement is keyed: a placeholder bears a tag of the entity, a surrogate is the image of the entity
under a keyed permutation of all strings of its format (consonants stay consonants, vowels vowels, digits digits, other
letters in their alphabet, case and separators stand; so do words of the format, such as Street, but only at their place
in an address or a mail domain). The permutation of words is one cycle, so no word stays as it is. The last letter of a
part of a name stays where it is one by which many languages tell gender, and becomes none of these elsewhere. Equal
entities so get equal replacements everywhere; distinct ones of a format get distinct surrogates by construction, and
tags and surrogates are checked for collisions.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import text_batches

TYPES = ("email", "id_number", "address", "phone", "name")
#: A table of known name parts has so many rows at most; it is a parameter and goes into the plan.
MAX_PARTS = 100_000
#: Words that are names as well as plain words; alone they prove no name.
PLAIN = frozenset(
    "art bill bishop branch brook brown chase cook dean drew faith field fields forest frank french gene grace grant green "
    "hill hope hunter iris ivy jack joy king lane long major mark mason may miles miller noble olive page park parker penny "
    "pierce pope price reed rich robin rose ruby rusty sage scout sky stone summer taylor wade ward water west will wood young".split()
)
#: Words before a name, words of streets, and what follows a name.
LABELS = "Author|Visitor|Reviewer|Signed-off-by|Reviewed-by|Co-authored-by|Acked-by|Tested-by|Reported-by|Assignee|assignee|Owner|owner|Customer|Contact|Maintainer|Patient|Client|Employee|Attn|Attention|Autor|Autora|Auteur|Verfasser|Kunde|Nombre|Nom|Автор|Имя"
LOOSE_LABELS = "Name|name|Full name|From|from|To|Cc|By|Sender|Recipient|Speaker|Manager|Participant|Caller"
SCRIPT_LABELS = "氏名|姓名|名前|お名前|作者|担当者|担当|联系人|用户|이름|성명|담당자|작성자|الاسم|المؤلف|שם|नाम"
TITLES = "Dr|Mr|Mrs|Ms|Miss|Mister|Prof|Professor|Herr|Frau|Sir|Señor|Señora|Sra|Monsieur|Madame|Mme|Signor|Signora"
GREETINGS = "Dear|Hi|Hello|Hey|Hola|Hallo|Bonjour|Ciao|Liebe|Lieber|Querido|Querida|Cher|Chère|Sehr geehrte Frau|Sehr geehrter Herr"
CLOSINGS = "Thanks|Thank you|Many thanks|Regards|Best|Best regards|Kind regards|Warm regards|Cheers|Sincerely|Yours|Yours sincerely|Grüße|Viele Grüße|Cordialement|Saludos"
INTRODUCTIONS = "[Mm]y name is|I am|I'm|[Tt]his is|[Mm]e llamo|[Ii]ch heiße|[Jj]e m'appelle|[Mm]eet|[Cc]ontact|[Ee]mail|[Ss]poke (?:to|with)|[Tt]alk(?:ed)? (?:to|with)|[Mm]et(?: with)?|[Pp]airing with|(?:[Aa]ssigned|[Ff]orwarded|[Ss]ent) to|(?:[Ww]ritten|[Rr]eviewed|[Aa]pproved|[Rr]eported|[Ss]igned|[Oo]wned|[Ff]iled|[Mm]aintained|[Ff]ixed) by|on behalf of"
DEEDS = "approved|wants|wanted|needs|reported|reviewed|asked|asks|called|calls|wrote|writes|said|says|replied|emailed|noted|mentioned|confirmed|requested|suggested|complained|joined|works|worked|lives|lived|signed|filed|told|thinks|prefers|agreed|disagreed|moved|phoned|texted|visited|thanked|and I own"
STREETS = "Street|Road|road|Lane|Ave|Avenue|Blvd|Boulevard|Drive|Court|Square|Terrace|Close|Way|Crescent|Parkway|Highway|Circle|Grove|Gardens|Mews|Row|Place|Trail|St|Rd|Ln|Dr|Ct"
SUFFIXES = "straße|strasse|str\\.|weg|gasse|platz|allee|straat|gracht|laan|gatan|vägen"
FRENCH = "rue|avenue|boulevard|place|chemin|quai|impasse|allée|cours|Rue|Avenue|Boulevard|Place|Chemin|Quai|Impasse|Allée|Cours"
SPANISH = "Calle|Avenida|Plaza|Paseo|Rua|Praça|Viale|Piazza|Corso"
RUSSIAN = "ул\\.|улица|проспект|пр\\.|переулок|пер\\."
PARTICLES = "Ó|Ní|Mac|Nic|y|de|da|di|del|della|van|von|der|den|la|le|bin|ibn|al|el|ten|ter|dos|du|af|zu"
#: What a bare number of seven digits counts, where it is no telephone number.
COUNTED = "version|release|build|revision|rev|issue|ticket|part|model|line|lines|page|pages|section|chapter|range|order|invoice|sku|case|port|id|no|number|commit|error|code|bug|task|chunk|bytes|offset|rows"


def _letters(categories: str) -> str:
    """The letters of some categories as ranges of a character class."""
    out, start = [], None
    for i in range(0x10001):
        of = i < 0x10000 and unicodedata.category(chr(i)) in categories.split()
        if of and start is None:
            start = i
        elif not of and start is not None:
            out.append(f"\\u{start:04x}-\\u{i - 1:04x}")
            start = None
    return "".join(out)


_UP, _LOW, _OTHER = _letters("Lu Lt"), _letters("Ll") + "\\u0300-\\u036f", _letters("Lo")
_CAP = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:[{_UP}][{_LOW}]+)?(?:['’-][{_UP}]?[{_LOW}]+)?"
_CAPS = rf"[{_UP}]{{2,}}"
_PAIR = rf"(?:{_CAP} (?:[{_UP}]\. |(?:(?:{PARTICLES}) ){{1,3}})?{_CAP}|{_CAPS} {_CAPS})(?![\w@])"
_ONE = rf"(?:[{_UP}]\. )?(?:{_CAP}|{_CAPS})(?![\w@])"
_TOWN = _CAP

EMAIL = re.compile(
    r"(?<![\w.+-])\w[\w.+-]*\s?@\s?(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])"
    r"|(?<![\w.+-])[A-Za-z0-9][\w.+-]* ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]+)+"
    r"|(?<![\w.+-])[A-Za-z0-9][\w.+-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+"
)
PHONE = re.compile(
    r"(?<![\w.+/:-])(?:"
    r"\+\d{10,14}"
    r"|\+\d{1,3} ?\(\d{1,4}\) ?\d{2,4}(?:[ -]?\d{2,4}){1,3}"
    r"|\+\d{1,3}(?:[ -]\d{1,6}){2,6}"
    r"|00\d{2}[ -]\d{3,5}[ -]\d{5,7}"
    r"|\(0?\d{2,4}\) ?\d{3,4}[ -]\d{3,4}"
    r"|(?:1\.)?\d{3}\.\d{3}\.\d{4}"
    r"|0\d{4} \d{3} \d{3}"
    r"|0\d{2,4} \d{3,4} \d{3,4}"
    r"|0\d{3} \d\d \d\d \d\d"
    r"|0\d(?: \d\d){4}"
    r"|0\d{2,4}/\d{6,9}"
    r"|(?:1[ -])?\d{3}[ -]\d{3}[ -]\d{4}"
    r"|\d{3} \d{4} ext\. ?\d{1,5}"
    r"|(?P<bare>\d{3}-\d{4})"
    r")(?:,? ?(?:ext\.?|x) ?\d{1,5})?(?![\w/:-]|\.\d)"
)
_COUNTED = re.compile(rf"(?i)(?<!\w)(?:{COUNTED})\.?(?: is)?[ :#=]*\Z")
IDNUM = re.compile(
    r"(?i:\b(?:ssn|social security (?:number|no\.?)|national[ _]?(?:id|insurance)(?: number| no\.?)?|ni number|tax (?:id|number)|driv(?:ing|er'?s?) licen[cs]e(?: no\.?| number)?"
    r"|passport(?: no\.?| number)?|(?:personal)?ausweis(?:nummer)?|dni|nie|id (?:card|number)|aadhaar(?: number)?|steuer-?id|personnummer|nhs number))"
    r"(?:(?i: is| was)|)[\s:#=\"'\\.]{1,8}(?P<v>(?:[A-Z]{1,3}[ -]?)?\d(?:[ -]?[A-Z0-9]){5,13})(?![A-Za-z0-9])"
)
#: Its groups are the words of the format; all else tells one address from another.
ADDRESS = re.compile(
    rf"(?<![\w.])(?:(Flat|Apt\.?|Unit|Suite) \w+, )?\d{{1,5}}[A-Za-z]?,? (?:([NSEW])\.? )?{_CAP}(?: {_CAP})? ({STREETS})\b\.?(?:, (Apt|Flat|Unit|Suite)\.? \w+)?(?:,? ?\n?{_TOWN}(?: [A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}}| \d{{4,5}})?)?"
    rf"|\b(P\.? ?O\.? ?Box) \d+(?:, {_TOWN})?"
    rf"|\b(Postfach|Apartado|Casilla|Postbus) \d+(?:, {_TOWN})?"
    rf"|(?<!\w)[{_UP}][{_LOW}]+({SUFFIXES}) \d+ ?[a-z]?(?!\w)(?:, (?:\d{{4,5}} )?{_TOWN})?"
    rf"|(?<![\w.])\d{{1,4}}( bis| ter)?,? ({FRENCH}) (de la |des |du |de |d'|l')?{_CAP}(?:, (?:\d{{5}} )?{_TOWN})?"
    rf"|\b({SPANISH}) (de (?:la |los )?|da |do |della )?{_CAP},? \d+(?:, \d+(º) ?[A-Z]?)?(?:, (?:\d{{5}} )?{_TOWN})?"
    rf"|(?<!\w)({RUSSIAN}) {_CAP},? (д\. ?)?\d+"
)
#: Names that what stands before them proves.
NAME = re.compile(
    rf"\b(?:{LABELS}): ?(?P<a>{_PAIR}|[{_UP}]\. (?:{_CAP}|{_CAPS})(?![\w@]))"
    rf"|\b(?:{CLOSINGS}),?\s+(?P<b>{_PAIR})(?=\s*(?:$|[\n.,;!]))"
    rf"|\bThanks, ?(?P<g>{_PAIR})"
    rf"|\b(?:{TITLES})\b\.? (?P<c>{_PAIR}|{_ONE})"
    rf"|\b(?:[Mm]y name is|[Aa]sk|[Cc]all|[Pp]ing) (?P<d>{_PAIR})(?= about\b| and\b|[.,;]|$| \w)"
    rf"|\b(?:{GREETINGS}) (?P<h>{_PAIR})(?=\s*(?:[,!:.\n]|$))"
    rf"|(?<![\w.])(?P<e>{_PAIR})(?= ?<[^<>\s]+ ?@)"
    rf"|(?:{SCRIPT_LABELS})\s?[:：]\s?(?P<i>[{_OTHER}]{{2,8}}(?:[ ・·][{_OTHER}]{{1,8}})?)(?!\w)"
)
#: Names that what stands around them makes likely, if their words name nothing else.
LIKELY = re.compile(
    rf"\b(?:{LOOSE_LABELS}): ?(?P<a>{_PAIR})"
    rf"|\b(?:{INTRODUCTIONS}) (?P<b>{_PAIR})"
    rf"|(?<![\w.])(?P<c>{_PAIR})(?= (?:{DEEDS})\b)"
    rf"|(?<![\w.])(?P<d>{_CAP}, {_CAP})(?= (?:{DEEDS})\b)"
)
_BEFORE_PHONE = re.compile(rf"(?<![\w.])(?P<x>{_PAIR}), (?=[+(\d])")
_TWO = re.compile(rf"(?<![\w.@-])(?P<x>{_CAP}|{_CAPS}|[{_UP}]\.)(?P<s> |, )(?P<y>{_CAP}|{_CAPS})(?![\w@])")
_LOWER_TWO = re.compile(rf"(?<![\w.@/-])(?P<x>[{_LOW}]{{3,}}) (?P<y>[{_LOW}]{{3,}})(?![\w@/-])")
_LED = re.compile(r"(?:^|\W)(?:with|ask|ping|tell|contact|meet|hi|hey|hello|dear|thanks|by|cc)[:,]? \Z", re.I)
#: What a text must hold for any of the above but known parts in lower case; RE2 reads it in linear time, its classes
#: being those of all scripts.
TRIGGER = (
    r"@|[\[(]at[\])]| at [A-Za-z0-9-]+ dot "
    r"|\+\d|\d{2}[-.) ] ?\d{3,4}|\d \d\d \d\d|\d/\d{6}"
    r"|(?i:ssn|social security|national|ni number|tax |licen[cs]e|passport|ausweis|\bdni|\bnie\b|\bid (card|number)|aadhaar|steuer|personnummer|nhs number)"
    rf"|\d[A-Za-z]?,? (?:[NSEW]\.? )?[{_UP}]\S+ (?:\S+ )?(?:{STREETS})|Box \d|Postfach|Apartado|Casilla|Postbus|(?:{SUFFIXES}) \d|(?:{FRENCH}) |(?:{SPANISH}) |(?:{RUSSIAN}) "
    rf"|[{_UP}][{_UP}{_LOW}'’-]+,? (?:[{_UP}][{_UP}{_LOW}'’.]|(?:{PARTICLES}) )|[{_UP}]\. [{_UP}]"
    rf"|\b(?:{TITLES})\b\.? [{_UP}]|(?:{SCRIPT_LABELS})"
).replace(_UP, r"\p{Lu}\p{Lt}").replace(_LOW, r"\p{Ll}\x{300}-\x{36f}").replace(r"\d", r"\p{Nd}")


@dataclass(frozen=True)
class Lexicon:
    """Name parts that are known to be borne, in lower case."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()


def read_lexicon(df: DataFrame) -> Lexicon:
    """From a table name_part, part_kind (given, family) of bounded size."""
    rows = df.filter("name_part IS NOT NULL").select("name_part", "part_kind").limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} name parts")
    return Lexicon(*(frozenset(r[0].lower() for r in rows if r[1] == k) for k in ("given", "family")))


#: Words that begin sentences and so bear capitals without being names.
_STARTS = frozenset(
    "after also and ask atomic author before below but call can could done error every file first for from here idle if in into it its last lazy let may "
    "merge move my next nested new no not nothing now of on only or our page please private read reading remember review run see send session set she ship should show since so stable step "
    "street take test tests than thank thanks that the then there these they this those to tree under until update use version visitor was we what when where which while who why will with without you your".split()
)
#: Words for things that are said to do what people do, and adverbs after a name.
_THINGS = frozenset(
    "action adapter agent alert api app application archive array batch branch browser budget buffer build bundle button cache callback channel checkpoint class client cluster code command commit compiler component config "
    "connection console container controller core cursor customer data database deadline debug default device directory driver editor emitter engine entry event exception executor factory feature field fixture folder form function gateway "
    "group handler header hook image index input interface item job journal kernel key layer layout leader ledger library lint list listener loader lock log machine manager map marker master memory menu message method model module monitor "
    "network node object office operator output package panel parser patch path payload pipeline plan plugin policy pool port process product profile project protocol provider proxy query queue record registry release report request response "
    "result router rule runner runtime sandbox scanner schema script search security server service shard shell signal snapshot socket source stack state storage store stream support symlink system table task team template terminal thread "
    "timeout token tool trace transaction trigger unit user validator value view virtual watcher web widget window worker workflow wrapper".split()
)
_WHEN = frozenset("tomorrow today yesterday again soon later now tonight about because before after and for from the when while who".split())
_ABSTRACT = re.compile(r"(?:ing|tion|sion|ment|ness|ity|ware|ism|able|ible|ology|ance|ence|izer|ized)s?\Z")


def _nameable(name: str, lexicon: Lexicon) -> bool:
    """Whether the words of a likely name can be one: none begins sentences, names a thing or is abstract, unless it is
    a known part."""
    for w in re.findall(r"[^\W\d_]{2,}", name.lower()):
        if w in lexicon.given or w in lexicon.family:
            continue
        if w in _STARTS or w in _THINGS or (len(w) > 5 and _ABSTRACT.search(w)):
            return False
    return True


def _names(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    for m in NAME.finditer(text):
        yield m.span(m.lastgroup)
    for m in LIKELY.finditer(text):
        if _nameable(m[m.lastgroup], lexicon):
            yield m.span(m.lastgroup)
    for m in _BEFORE_PHONE.finditer(text):
        if PHONE.match(text, m.end()) and _nameable(m["x"], lexicon):
            yield m.span("x")
    at = 0
    while m := _TWO.search(text, at):
        x, y = m["x"].lower(), m["y"].lower()
        at = m.start("y")
        if m["s"] == ", ":
            known = x in lexicon.family and y in lexicon.given and not {x, y} & PLAIN
        elif x.endswith("."):
            known = y in lexicon.family and y not in PLAIN
        else:
            sure = (x in lexicon.given and x not in PLAIN) + (y in lexicon.family and y not in PLAIN)
            other = y if x in lexicon.given else x
            known = sure == 2 or (sure == 1 and (x in lexicon.given or len(x) > 3) and y not in lexicon.given and x not in lexicon.family and (y in lexicon.family or len(y) > 3))
            known = known and ((x in lexicon.given and y in lexicon.family) or not (sure == 1 and (other in _STARTS or other in _THINGS)))
        if known:
            yield m.span()
            at = m.end()
    at = 0
    while m := _LOWER_TWO.search(text, at):
        x, y = m["x"], m["y"]
        at = m.start("y")
        sure = (x in lexicon.given and x not in PLAIN) + (y in lexicon.family and y not in PLAIN)
        other = y if x in lexicon.given else x
        if sure == 2 or (sure == 1 and not {x, y} & PLAIN and other not in _STARTS | _THINGS | _WHEN and _LED.search(text, max(0, m.start() - 12), m.start())):
            yield m.span()
            at = m.end()


def entities(text: str, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """(type, start, end) of the entities in a text, in code points, by start; none overlaps another."""
    found: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if start < end and all(end <= s or e <= start for _, s, e in found):
            found.append((kind, start, end))

    for m in EMAIL.finditer(text):
        add("email", *m.span())
    for m in IDNUM.finditer(text):
        add("id_number", *m.span("v"))
    for m in ADDRESS.finditer(text):
        add("address", *m.span())
    for m in PHONE.finditer(text):
        if not (m["bare"] and _COUNTED.search(text, max(0, m.start() - 24), m.start())):
            add("phone", *m.span())
    for s, e in _names(text, lexicon):
        add("name", s, e)
    return sorted(found, key=lambda x: x[1])


def normal_form(kind: str, value: str) -> str:
    """What two mentions of one entity have in common."""
    v = value.casefold()
    if kind == "email":
        v = re.sub(r"\s*(@|[\[(]at[\])]|\bat\b)\s*", "@", v)
        return re.sub(r"\s*([\[(]dot[\])]|\bdot\b)\s*", ".", v)
    if kind == "name":
        return " ".join(sorted(re.findall(r"\w+", v)))
    return "".join(re.findall(r"\w" if kind != "phone" else r"\d", v))


def placeholder(kind: str, value: str, key: bytes) -> str:
    """[TYPE:tag], the tag (60 bits) being the keyed hash of the entity's normal form."""
    tag = hmac.new(key, f"{kind}\0{normal_form(kind, value)}".encode(), hashlib.sha256).digest()
    return f"[{kind.upper()}:{int.from_bytes(tag[:8], 'big') >> 4:015x}]"


_CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çðñþ", "ßÿ")


def _paired(low: str) -> bool:
    """Whether the letter has one capital, which stands in the same block of 256 characters."""
    up = low.upper()
    return len(up) == 1 and up != low and up.lower() == low and ord(up) >> 8 == ord(low) >> 8


@lru_cache(maxsize=4_096)
def _block(block: int, category: str, paired: bool) -> str:
    block <<= 8
    return "".join(c for c in map(chr, range(max(block, 0x80), block + 256)) if c.isalnum() and unicodedata.category(c) == category and _paired(c) == paired and _small(c) == c and not any(c in x for x in _CLASSES))


@lru_cache(maxsize=65_536)
def _small(ch: str) -> str:
    low = ch.lower()
    return low if len(low) == 1 and low.upper() == ch and _paired(low) else ch


@lru_cache(maxsize=65_536)
def _class_of(small: str) -> str:
    """The characters that may stand in place of a letter or digit."""
    return next((c for c in _CLASSES if small in c), None) or _block(ord(small) >> 8, unicodedata.category(small), _paired(small))


def _feistel(n: int, size: int, key: bytes, back: bool = False) -> int:
    """The image of n under a keyed permutation of range(size), or what n is the image of: a Feistel network, walked
    until it lands inside."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1

    def f(i: int, x: int) -> int:
        return int.from_bytes(hmac.new(key, b"%d|%d|%d" % (i, half, x), hashlib.sha256).digest(), "big") & mask

    while True:
        a, b = n >> half, n & mask
        for i in range(6):
            a, b = (b ^ f(5 - i, a), a) if back else (b, a ^ f(i, b))
        n = a << half | b
        if n < size:
            return n


def _permute(n: int, size: int, key: bytes) -> int:
    """The image of n under a keyed permutation of range(size) that is one cycle: no n is its own image, if size > 1."""
    return _feistel((_feistel(n, size, key) + 1) % size, size, key, True)


#: Last letters by which many languages tell gender (Anna, Mario; Иванова, Мария; Ελένη).
_GENDERED = "aoаяηα"


def _surrogate_token(token: str, key: bytes, named: bool = False) -> str:
    low = [_small(ch) for ch in token]
    classes = [_class_of(ch) for ch in low]
    if named and len(low) > 2:
        classes[-1] = low[-1] if low[-1] in _GENDERED else "".join(c for c in classes[-1] if c not in _GENDERED)
    size, n = 1, 0
    for ch, c in zip(low, classes):
        n, size = n * len(c) + c.index(ch), size * len(c)
    if size == 1:
        return token
    n = _permute(n, size, key + "|".join(str(_CLASSES.index(c)) if c in _CLASSES else f"{len(c)}{c[0]}" for c in classes).encode())
    out = []
    for ch, c, old in zip(reversed(low), reversed(classes), reversed(token)):
        n, r = divmod(n, len(c))
        out.append(c[r].upper() if old != ch else c[r])
    return "".join(reversed(out))


#: Whole labels of mail domains that carry format, not identity.
_LABELS = frozenset("example test invalid com org net mail dev".split())
_MAIL = re.compile(r"(?P<local>[\w.+-]+)(?P<at>\s?@\s?| ?[\[(]at[\])] ?| at )(?P<domain>.+)")
_DOT = re.compile(r"\.| ?[\[(]dot[\])] ?| dot ")


def _format(kind: str, value: str) -> list[tuple[int, int]] | None:
    """Places of the words of the format in an address or a mail address; None if it is none."""
    if kind == "address":
        m = ADDRESS.fullmatch(value)
        return m and [x for x in m.regs[1:] if x[0] >= 0]
    if kind == "email":
        m = _MAIL.fullmatch(value)
        if not m:
            return None
        out, at = [m.span("at")], m.start("domain")
        for d in [*(x.span() for x in _DOT.finditer(value, at)), (len(value), len(value))]:
            if value[at : d[0]].lower() in _LABELS:
                out.append((at, d[0]))
            out.append(d)
            at = d[1]
        return out
    return []


def surrogate(kind: str, value: str, key: bytes) -> str:
    """Another value of the same format: each word and each number goes its own keyed way, whatever its case.

    Where an image has words of the format at other places than the value, it is sent on the same way again. So the
    images of values with different format words stay apart, and the way stays a permutation.
    """
    if kind in ("phone", "id_number"):
        digits = "".join(re.findall(r"[A-Za-z0-9]", value))
        new = iter(_surrogate_token(digits, key + kind.encode()))
        return "".join(next(new) if re.match(r"[A-Za-z0-9]", ch) else ch for ch in value)
    kept = _format(kind, value)
    while True:
        out, at = [], 0
        for s, e in [*(kept or []), (len(value), len(value))]:
            out += [re.sub(r"[^\W_]+", lambda m: _surrogate_token(m[0], key, kind == "name"), value[at:s]), value[s:e]]
            at = e
        value = "".join(out)
        if kept is None or _format(kind, value) == kept:
            return value


def replaced(text: str, lexicon: Lexicon, how: Callable[[str, str], str]) -> str:
    """The text with how(type, value) in place of each entity and all else unchanged."""
    out, at = [], 0
    for kind, s, e in entities(text, lexicon):
        out += [text[at:s], how(kind, text[s:e])]
        at = e
    return "".join([*out, text[at:]])


class _Sieve:
    """Picks the texts that can hold anything."""

    def __init__(self, lexicon: Lexicon) -> None:
        parts = {x for x in (lexicon.given | lexicon.family) - PLAIN if len(x) > 2}
        self.parts = None
        if parts:
            import ahocorasick

            self.parts = ahocorasick.Automaton()
            for x in parts:
                self.parts.add_word(x, True)
            self.parts.make_automaton()

    def may_hold(self, texts: pa.Array) -> pa.Array:
        """For each text whether it can hold an entity; null can't."""
        by_form = pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)
        if self.parts is None:
            return by_form
        return pa.array([f or (t is not None and next(self.parts.iter(t), None) is not None) for f, t in zip(by_form.to_pylist(), texts.to_pylist())], pa.bool_())


def find(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """keys, pii_type, start_char, end_char, value of every entity in every text.

    A null or empty text holds none. Repeated rows give repeated entities. Other columns are left out; keys may not
    bear the names of the result's columns. An empty table gives an empty result.
    """
    own = ["pii_type", "start_char", "end_char", "value"]
    if {*keys} & {*own}:
        raise ValueError("keys bear names of the result's columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = _Sieve(lexicon)
        for whole in batches:
            for b in text_batches(iter([whole]), "__text", 8_000_000):
                b = b.filter(sieve.may_hold(b.column("__text")))
                at, kinds, starts, ends, values = [], [], [], [], []
                for i, t in enumerate(b.column("__text").to_pylist()):
                    for kind, s, e in entities(t, lexicon):
                        at.append(i)
                        kinds.append(kind)
                        starts.append(s)
                        ends.append(e)
                        values.append(t[s:e])
                columns = [b.column(k).take(pa.array(at, pa.int32())) for k in keys]
                columns += [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *own])

    types = dict(df.dtypes)
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "pii_type string, start_char int, end_char int, value string"])
    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, ddl)


def redact(df: DataFrame, text: str, lexicon: Lexicon, key: str, style: str = "placeholder") -> DataFrame:
    """df with the text column redacted; all other columns and all rows stay. Null stays null.

    style: placeholder ([TYPE:tag]) or surrogate (another value of the same format). Texts that can hold no entity
    don't leave the batch they came in.
    """
    if style not in ("placeholder", "surrogate"):
        raise ValueError(style)
    make = placeholder if style == "placeholder" else surrogate
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], str] = {}
        sieve = _Sieve(lexicon)

        def how(kind: str, value: str) -> str:
            if len(memo) > 50_000:
                memo.clear()
            if (kind, value) not in memo:
                memo[kind, value] = make(kind, value, secret)
            return memo[kind, value]

        for whole in batches:
            for b in text_batches(iter([whole]), text, 8_000_000):
                may = sieve.may_hold(b.column(text))
                new = pa.array([replaced(t, lexicon, how) for t in b.column(text).filter(may).to_pylist()], b.column(text).type)
                yield b.set_column(b.schema.get_field_index(text), text, pc.replace_with_mask(b.column(text), may, new))

    return df.mapInArrow(run, df.schema)


def collisions(found: DataFrame, key: str) -> DataFrame:
    """pii_type, tag, n: tags, and normal forms of surrogates, that n distinct entities share, and with n = 0 those of
    entities that their surrogate doesn't hide; empty if replacement keeps entities apart and hides them."""
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column("pii_type").to_pylist(), b.column("value").to_pylist()))
            entity = pa.array([normal_form(k, v) for k, v in pairs], pa.string())
            for tags in ([placeholder(k, v, secret) for k, v in pairs], [normal_form(k, surrogate(k, v, secret)) for k, v in pairs]):
                yield pa.record_batch({"pii_type": b.column("pii_type"), "tag": pa.array(tags, pa.string()), "entity": entity})

    tagged = found.select("pii_type", "value").distinct().mapInArrow(run, "pii_type string, tag string, entity string")
    n = tagged.distinct().groupBy("pii_type", "tag").agg(F.count("*").alias("n"), F.max(F.col("tag") == F.col("entity")).alias("same"))
    return n.filter("n > 1 OR same").select("pii_type", "tag", F.when(F.col("same"), F.lit(0).cast("long")).otherwise(F.col("n")).alias("n"))
