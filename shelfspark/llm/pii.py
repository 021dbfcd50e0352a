"""Personal information in free text: found, and replaced.

Detection works on whole texts in Arrow-batched passes: patterns with checks of the context for e-mail addresses, telephone
and identity numbers and postal addresses. Names are found in two ways: after words that announce or address a person, by
shape alone, and around given names, patronymics and initials. Given names are common ones and those that the corpus itself
teaches: a first pass counts the first words of announced names, and one that stands before several surnames is a given name.
There may be any number of them, so they are joined to the texts that hold them and not sent to the driver.

Every entity gets a *placeholder* such as ``[NAME_5d2c01]`` and a *surrogate* of the same kind: keyed digests of its canonical form
choose digits for digits and letters for letters, and for names another given name of the same gender and script. The
same entity gets the same replacement everywhere (coreference); within a text, different entities never share one and no
surrogate equals an entity that stands there (collision check, settled by re-keying in text order).
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ident", "phone", "address", "name")

# Common given names by script and gender.
GIVEN = {
    ("ru", "m"): "Александр Алексей Анатолий Андрей Антон Аркадий Артём Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир "
    "Владислав Вячеслав Геннадий Георгий Герман Глеб Григорий Даниил Денис Дмитрий Евгений Егор Захар Иван Игорь Илья Кирилл "
    "Константин Лев Леонид Максим Матвей Михаил Никита Николай Олег Павел Пётр Роман Руслан Семён Сергей Станислав Степан Тарас "
    "Тимофей Фёдор Эдуард Юрий Яков Ярослав",
    ("ru", "f"): "Алла Александра Анастасия Анна Антонина Валентина Валерия Варвара Вера Вероника Виктория Галина Дарья Диана Евгения "
    "Екатерина Елена Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кира Клавдия Ксения Лариса Лидия Любовь Людмила Маргарита "
    "Марина Мария Надежда Наталья Нина Оксана Ольга Полина Раиса Светлана София Тамара Татьяна Ульяна Элеонора Юлия Яна",
    ("en", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew "
    "Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jeffrey Nicholas Eric Jonathan Stephen Benjamin Samuel Frank Gregory Patrick Alexander Jack "
    "Dennis Peter Henry Simon Martin Albert Arthur Harold Philip Adam Alan Hugh Oliver Roger Victor Walter",
    ("en", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Dorothy Kimberly Emily Donna Michelle "
    "Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Ruth Pamela Nicole Katherine Catherine Christine Rachel "
    "Julia Alice Emma Grace Victoria Hannah Charlotte Caroline Jane Lucy Martha Florence Harriet",
}
# More scripts and languages; they replace none of the above.
MORE_GIVEN = {
    ("de", "m"): "Jürgen Günter Hans Heinz Klaus Karl Wolfgang Uwe Rüdiger Jörg Bernd Helmut Friedrich Gerhard Stefan Andreas Christian Sebastian Johannes Lukas",
    ("de", "f"): "Ursula Ingrid Gisela Renate Monika Petra Sabine Susanne Claudia Birgit Heike Anja Katrin Brigitte Käthe Ulrike Katharina Elisabeth Johanna Lena",
    ("latin", "m"): "José Juan Carlos Luis Miguel Jean Pierre François Giovanni Marco Łukasz Piotr Jiří István Søren João Mehmet Mohammed Muhammad Ahmed Ali Omar Wei Ming Hiroshi Rahul Anil",
    ("latin", "f"): "Maria María Carmen Lucía Marie Hélène Chloé Giulia Małgorzata Zuzana Ayşe Åsa Zoë Fatima Priya Mei Yuki Aigul",
    ("ru+", "m"): "Тимур Рустам Марат Азамат Нурлан Ринат Ильдар Арсен Ашот Гурген",
    ("ru+", "f"): "Айгуль Гульнара Алия Динара Лейла Наира Земфира",
}
GENDER = {n: k for known in (MORE_GIVEN, GIVEN) for k, names in known.items() for n in names.split()}
GIVEN |= MORE_GIVEN
GENDER |= {n.replace("ё", "е").replace("Ё", "Е"): k for n, k in list(GENDER.items())}
# Words before a name that are no part of it.
ROLES = set(
    "Читатель Читательница Автор Подпись Спасибо Ответственное Бригадир Мастер Доцент Профессор Инженер Директор Редактор Заведующая "
    "Заведующий Господин Госпожа Reader Signed Thanks Posted Gezeichnet Leser Leserin Dank Herr Frau Professor Doctor Editor Author Mr Mrs Ms Dr "
    "From The Contact Contacts Dear Mit Und Von Der Die Das".split()
)
RU_SURNAME = re.compile(
    r"(?:[оеё]в|[иы]н)(?:а|ой|у|ым)?$|[сц]к(?:ий|ая|ой|ого|ому)$|(?:ич|енко|ко|[ую]к|ян|дзе|швили|[иы]х|ец|як|ай|ой|ук|ев|ун|аш|ар|ан|ам|ль|ий|ёв)$", re.I)
PATRONYMIC = re.compile(r"^[А-ЯЁ][а-яё]+(?:ович|евич|ьич|ич|овна|евна|ична|инична)$")
def _class(test, *ranges: tuple[int, int]) -> str:
    """The characters of the ranges that pass the test, as the inside of a character class."""
    out, codes = "", [c for a, b in ranges for c in range(a, b) if test(chr(c))]
    for i, c in enumerate(codes):
        if i == 0 or codes[i - 1] != c - 1:
            out += chr(c)
        elif i + 1 == len(codes) or codes[i + 1] != c + 1:
            out += "-" + chr(c)
    return out


_MARKS = "\u0300-\u036f"  # accents as characters of their own
_LATIN, _CYRILLIC = [(0x41, 0x250), (0x1E00, 0x1F00)], [(0x400, 0x530)]
_OTHER = [(0x370, 0x400), (0x530, 0x1E00), (0x1F00, 0x2000)]
_CAPITALS, _LETTERS = [_class(str.isupper, *r) for r in (_LATIN, _CYRILLIC, _OTHER)], [_class(str.isalpha, *r) + _MARKS for r in (_LATIN, _CYRILLIC, _OTHER)]
_UP, _WORD = "".join(_CAPITALS), rf"\w{_MARKS}’'-"
# Words that announce or address a person; after them two capitalised words are a name even if neither is known.
_CUES = (
    r"[Чч]итатель(?:ница)?|Автор(?: отзыва|:)|(?:Ответственное|Контактное) лицо:|Подпись:|Спасибо,|Благодарим|[Бб]ригадир|[Гг]-н|[Гг]-жа|[Гг]осподину?|[Гг]оспож[аеу]|"
    r"[Гг]ражданину?|[Гг]ражданк[аеи]|Уважаем(?:ый|ая)|ФИО:|Ф\. ?И\. ?О\.:|Reader|Signed by|Thanks (?:go )?to|our colleague|Posted by|Written by|Author:|Contact person:|Full name:|"
    r"Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.|Prof\.|Dank an|Gezeichnet:|Leser(?:in)?|Herr|Frau|Verfasser(?:in)?:|Ansprechpartner(?:in)?:|Monsieur|Madame|Mme|Señora?|Sra?\.|Signora?")
ANNOUNCED = re.compile(
    r"(?<![\w-])(?:" + _CUES + ") (?P<name>(?P<s>[" + _UP + "][" + _WORD + r"]+)(?:,? [" + _UP + r"]\.)?,? (?P<t>[" + _UP + "][" + _WORD + r"]+)(?: [А-ЯЁ][а-яё]+(?:ович|евич|ич|овна|евна|ична)\b)?)")
CAP = re.compile(r"\b(?:" + "|".join(rf"[{up}](?:\.|[{any_}’'-]*[{any_}])" for up, any_ in zip(_CAPITALS, _LETTERS)) + ")")

_TLD = r"(?!png|svg|jpe?g|gif|webp|css|js\b)[a-zA-Z]{2,12}"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?"
_AT = r"(?:\s?[\[(](?:at|собака|ät)[\])]\s?|\s(?:собака|at)\s)"
_DOT = r"(?:\.|\s?[\[(](?:dot|точка|punkt)[\])]\s?|\s(?:dot|точка|punkt)\s)"
EMAIL = re.compile(rf"(?<![\w.+-]){_LOCAL}@(?:[A-Za-z0-9-]+\.)+{_TLD}(?![\w])")
HIDDEN_EMAIL = re.compile(rf"(?<![\w.+-]){_LOCAL}(?P<at>{_AT})[A-Za-z0-9-]+(?P<dots>(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}{_TLD})(?![\w])", re.I)
_HIDDEN = (" at ", "(at)", "[at]", "собака", "(ät)")

_IDENT_LABEL = re.compile(
    r"(?:(?i:паспорт\w*|загранпаспорт\w*|снилс|инн|огрнип|полис(?:\sомс)?|passport|social\ssecurity|national\s(?:insurance|id)|(?:personal)?ausweis(?:nummer|-nr\.?)?|"
    r"reisepass(?:nummer)?|steuer-?id(?:nr\.?)?|steuernummer|sozialversicherungsnummer|tax\sid|id\scard|identity\scard)|\bSSN|\bNINO?|\bЕГН|РНОКПП|ІПН)"
    r"(?:\s?(?i:no\.?|number|№|nr\.?|серии|серия|номер))?\s?[:—-]?\s{0,2}$")
IDENT = re.compile(
    r"(?<![\w№-])(?:\d{4}\s?№\s?\d{6}|\d{2}\s\d{2}\s(?:№\s?)?\d{6}|\d{4}\s\d{6}|\d{3}-\d{3}-\d{3}[\s-]\d{2}|\d{3}-\d{2}-\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b|"
    r"\d{2}\s\d{3}\s\d{3}\s\d{3}|[A-Z]\d{3}-\d{3}-\d{3}|[A-Z]{1,3}\d[A-Z0-9]{5,9}|[A-Z]{2}\s?\d{6,9}|\d{9,14})(?![\w-]*\d)")
BARE_IDENT = re.compile(r"(?<![\w-])(?:\d{3}-\d{3}-\d{3}\s\d{2}|\d{3}-\d{2}-\d{4}|[A-CEGHJ-PQR-TW-Z][A-Z]\s\d{2}\s\d{2}\s\d{2}\s[A-D])(?![\w-]|\.\d)")
_NOT_PERSONAL = re.compile(
    r"(?:№|\bNo\.?|\bno\.?|\bNr\.?|Order|Invoice|Auftrag|Rechnung|ISBN|ISSN|Build|Part|Room|Price|Preis|ТУ|ГОСТ|УДК|Инв\.?|Счёт|счёт|Заказ|Артикул|Накладная|Обновлено|Updated|Stand|"
    r"Координаты|Lat|lon|Raum|Konto)\s?[:№]?\s?$")
PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d )(?:"
    r"(?:\+7|\b8)[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}"
    r"|\(\d{3}\)\s?\d{3}[ .-]\d{2}[ .-]\d{2}"
    r"|\+[1-689]\d{1,2}[ .-]\d{1,2}(?:[ .-]\d{2}){4}"
    r"|\+(?:[1-689]\d{0,2})[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,5}[ .-]?\d{3,4}"
    r"|00(?:49|44|7|1)[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,5}[ .-]?\d{3,4}"
    r"|\(0\d{2,4}\)\s?\d{4,5}[ -]?\d{3,4}"
    r"|0\d{2,4}[ /-]\d{4,5}[ -]?\d{3,4}"
    r"|(?:1[ .-])?\(\d{3}\)\s?\d{3}[ .-]\d{4}"
    r"|(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}"
    r")(?!\d|[./-]\d| \d{3}\b)")

_RU_STREET = r"(?:(?i:ул|пер|просп|наб|бул|пл|ш|туп|мкр)\.|(?i:пр-т|пр-кт|пр-д|б-р|ул-ца)\b|(?i:улица|переулок|проспект|набережная|бульвар|площадь|шоссе|проезд|тупик)\b)"
_RU_WORD = r"[А-ЯЁ0-9][А-Яа-яЁё0-9-]*"
_RU_NAME = rf"{_RU_WORD}(?:\s{_RU_WORD}){{0,2}}"
_RU_HOUSE = (
    r"(?:(?:,\s?|\s)(?:(?i:д|дом)(?:\.\s?|\s))?\d+(?:[а-яёА-ЯЁ](?![а-яё]))?(?:[/-]\d+[а-я]?)?"
    r"(?:,?\s?(?i:корп|к|стр|корпус|строение)(?:\.\s?|\s)\d+[а-я]?)?(?:,?\s?(?i:кв|квартира|оф|офис)(?:\.\s?|\s)\d+)?)")
RU_ADDRESS = re.compile(
    rf"(?<![\w-])(?:\d{{6}},\s?)?(?:(?:(?i:г|пос|с|дер|п)\.\s?)?{_RU_NAME}(?:-\d)?,\s)?"
    rf"(?:{_RU_STREET}\s?{_RU_NAME}|{_RU_NAME}\s(?:улица|переулок|проспект|набережная|бульвар|площадь|шоссе|проезд))(?P<house>{_RU_HOUSE})(?![\w])")
_RU_STREETS = ("ул.", "пер.", "просп.", "наб.", "бул.", "пл.", "ш.", "туп.", "мкр.", "пр-т", "пр-кт", "пр-д", "б-р", "ул-ца", "улица", "переулок",
               "проспект", "набережная", "бульвар", "площадь", "шоссе", "проезд", "тупик")
_EN_TYPE = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?|Terrace|Place|Way|Crescent|Boulevard|Blvd\.?)"
_EN_CITY = r"[A-Z][a-z]+(?:[- ][A-Z][a-z]+)?"
EN_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:Flat|Apt\.?|Unit|Suite)\s\d+[A-Za-z]?,\s)?\d+(?:-?[A-Z])?\s(?:[A-Z][a-z'’]+\s){{1,3}}{_EN_TYPE}(?![a-z])"
    rf"(?:,\s(?:Apt\.?|Flat|Unit|Suite)\s\d+[A-Za-z]?)?(?:,\s{_EN_CITY}(?:,?\s(?:[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}}|[A-Z]{{2}}\s\d{{5}}(?:-\d{{4}})?|\d{{5}}))?)?")
_EN_GATE = re.compile(rf"\d(?:-?[A-Z])?\s(?:[A-Z][a-z'’]+\s){{1,3}}{_EN_TYPE}")
DE_ADDRESS = re.compile(
    r"(?<![\w-])(?:[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm|steig)|(?:Am|An der|Auf dem|Im|Zum|Zur)\s[A-ZÄÖÜ][a-zäöüß]+|"
    r"[A-ZÄÖÜ][a-zäöüß-]+\s(?:Straße|Str\.|Weg|Allee|Platz|Gasse|Ring))\s\d+(?:\s?[a-z](?![a-z]))?(?:,\s\d{5}\s[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?)?(?![\w])")
FR_ADDRESS = re.compile(
    r"(?<![\w-])\d{1,4}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|quai|chemin|impasse|allée)\s(?:de la |de l['’]|de |du |des |d['’])?[A-ZÀ-Þ][\w’'-]+(?:[ -][A-ZÀ-Þ][\w’'-]+){0,3}"
    r"(?:,\s\d{5}\s[A-ZÀ-Þ][\w’'-]+(?:[ -][A-ZÀ-Þ][\w’'-]+)?)?")
_FR_STREETS = (" rue ", " avenue ", " boulevard ", " place ", " quai ", " chemin ", " impasse ", " allée ")
_DE_STREETS = ("straße", "strasse", "str.", "gasse", "weg ", "allee", "platz", "ufer ", "ring ", "damm ", "steig ", "am ", "an der ", "auf dem ", "im ", "zum ", "zur ")


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return all(b <= x or a >= y for x, y in taken)


def find_entities(text: str, learned: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each entity, in text order, without overlaps; ``learned`` are given names beside the common ones."""
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str):
        if _free(taken, a, b):
            found.append((a, b, kind))
            taken.append((a, b))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    low = text.lower()
    if any(x in low for x in _HIDDEN):
        for m in HIDDEN_EMAIL.finditer(text):
            bare = m["at"].strip().lower() == "at"
            if not bare or re.search(r"\sdot\s", m["dots"], re.I):  # "at" alone is a common word
                add(*m.span(), "email")
    for m in IDENT.finditer(text):
        if _IDENT_LABEL.search(text[max(0, m.start() - 40):m.start()]):
            add(*m.span(), "ident")
    for m in BARE_IDENT.finditer(text):
        if not _NOT_PERSONAL.search(text[max(0, m.start() - 14):m.start()]):
            add(*m.span(), "ident")
    if any(x in low for x in _RU_STREETS):
        for m in RU_ADDRESS.finditer(text):
            add(*m.span(), "address")
    if _EN_GATE.search(text):
        for m in EN_ADDRESS.finditer(text):
            add(*m.span(), "address")
    if any(x in low for x in _DE_STREETS):
        for m in DE_ADDRESS.finditer(text):
            add(*m.span(), "address")
    if any(x in text for x in _FR_STREETS):
        for m in FR_ADDRESS.finditer(text):
            add(*m.span(), "address")
    for m in PHONE.finditer(text):
        if not _NOT_PERSONAL.search(text[max(0, m.start() - 14):m.start()]):
            add(*m.span(), "phone")
    for a, b in find_names(text, learned):
        add(a, b, "name")
    return sorted(found)


def _script(word: str) -> str:
    return "ru" if "Ѐ" <= word[0] <= "ӿ" else "en"


def _capitalised(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), unicodedata.normalize("NFC", m[0])) for m in CAP.finditer(text)]


# All that ``_assemble`` accepts between two parts of a name.
_GAPS = ("", " ", "\u00a0", ", ")


def teachable(text: str) -> set[str]:
    """The words for which it matters to ``find_names`` whether they are learned: not known anyway, and with another capitalised word beside them."""
    caps, words = _capitalised(text), set()
    near = [text[x[1]:y[0]] in _GAPS for x, y in zip(caps, caps[1:])]
    for before, after, (_, _, w) in zip([False, *near], [*near, False], caps):
        if before or after:
            w = w.title() if w.isupper() else w
            if w not in GENDER:
                words.add(w)
    return words


def find_names(text: str, learned: frozenset[str] = frozenset()):
    """Names as written, without title or role."""
    caps = _capitalised(text)
    last, spans = -1, []
    for i, (a, b, w) in enumerate(caps):
        if a < last:
            continue
        initial = len(w) == 2 and w[1] == "."
        if not initial and w not in GENDER and w not in learned and not (PATRONYMIC.match(w)):
            if len(w) < 3 or not (w.isupper() and (w.title() in GENDER or w.title() in learned)):
                continue
        span = _assemble(text, caps, i, learned)
        if span:
            spans.append(span)
            last = span[1]
    for m in ANNOUNCED.finditer(text):
        a, b = m.span("name")
        if _script(m["s"]) == _script(m["t"]) and _free(spans, a, b):
            spans.append((a, b))
    return sorted(spans)


def _assemble(text: str, caps: list, i: int, learned: frozenset[str]):
    script = _script(caps[i][2])

    def gap(j):  # between caps[j] and caps[j + 1]
        return text[caps[j][1]:caps[j + 1][0]] if 0 <= j < len(caps) - 1 else None

    def kind(j):
        if not 0 <= j < len(caps):
            return ""
        w = caps[j][2]
        if _script(w) != script:
            return ""
        if len(w) == 2 and w[1] == ".":
            return "I"
        if len(w) < 2:
            return ""
        t = w.title() if w.isupper() else w
        if t in learned or t in GENDER and GENDER[t][0].startswith("ru") == (script == "ru"):
            return "G"
        if script == "ru" and PATRONYMIC.match(t) and not _only_like_patronymic(t):
            return "P"
        return "" if w in ROLES else "S"

    def surname(j):
        k = kind(j)
        if k not in ("S", "P"):
            return False
        w = caps[j][2]
        return script == "en" or bool(RU_SURNAME.search(w)) or w.isupper()

    k = kind(i)
    a, b = caps[i][0], caps[i][1]
    if k == "I":
        j = i
        if text[max(0, a - 2):a].strip()[-1:].isdigit():  # the letter that ends a number
            return None
        if kind(j + 1) == "I" and gap(j) in ("", " ", " "):
            j += 1
        if gap(j) in ("", " ", "\u00a0") and kind(j + 1) in ("S", "P") and (
                script == "en" or surname(j + 1)) and (j > i or script == "en" or not caps[j + 1][2].isupper()):
            return a, caps[j + 1][1]
        # surname before the initials
        if surname(i - 1) and gap(i - 1) in (" ", ", ", " ") and j > i:
            return caps[i - 1][0], caps[j][1]
        return None
    if k == "G":
        j = i
        # given [patronymic | initial] surname
        if gap(j) in (" ", " ") and kind(j + 1) == "P":
            end = j + 1
            if gap(end) in (" ", " ") and kind(end + 1) == "S" and surname(end + 1):
                if not _surname_before(text, caps, i, surname, gap):
                    return a, caps[end + 1][1]
            if _surname_before(text, caps, i, surname, gap):
                return caps[i - 1][0], caps[end][1]
            return a, caps[end][1]
        if gap(j) in (" ", " ") and kind(j + 1) == "I":
            end = j + 1
            if gap(end) in (" ", " ") and kind(end + 1) == "S" and surname(end + 1) and not _surname_before(text, caps, i, surname, gap):
                return a, caps[end + 1][1]
            if _surname_before(text, caps, i, surname, gap):
                return caps[i - 1][0], caps[end][1]
        if _surname_before(text, caps, i, surname, gap):
            return caps[i - 1][0], b
        if gap(j) in (" ", " ") and kind(j + 1) == "S" and surname(j + 1):
            return a, caps[j + 1][1]
        return None
    return None


def _only_like_patronymic(word: str) -> bool:
    """Ends like a patronymic but is none: no vowel-v-ich, -vna or -ichna."""
    return not re.search(r"(?:[ое]вич|[ое]вна|ьич|ична|инична|(?:Ильич|Лукич|Кузьмич|Фомич))$", word)


def _surname_before(text, caps, i, surname, gap) -> bool:
    """Does a surname stand before the given name, as in "Surname Given" (Russian) or "Surname, Given"?"""
    if i == 0:
        return False
    g = gap(i - 1)
    if g == ", ":
        return surname(i - 1) and (_script(caps[i - 1][2]) == "ru" or caps[i - 1][2] not in ROLES)
    return g in (" ", " ") and _script(caps[i - 1][2]) == "ru" and surname(i - 1)


# ------------------------------------------------------------------------------------------------ replacement


def _digest(key: str, kind: str, canonical: str, turn: int) -> bytes:
    out, block = b"", 0
    while len(out) < max(32, len(canonical) * 2):
        out += hmac.new(key.encode(), f"{kind}\x00{turn}\x00{block}\x00{canonical}".encode(), hashlib.sha256).digest()
        block += 1
    return out


def canonical(kind: str, value: str) -> str:
    """Spellings of one entity agree: case, spacing and punctuation do not count; hidden e-mail addresses are spelled out,
    telephone numbers lose the country code or trunk prefix of Russia, the parts of a name have no order."""
    v = unicodedata.normalize("NFC", value).lower().replace("ё", "е")
    if kind == "email":
        v = re.sub(r"\s?[\[(]?\b(?:at|собака|ät)\b[\])]?\s?", "@", v) if "@" not in v else v
        return re.sub(r"\s?[\[(]?\b(?:dot|точка|punkt)\b[\])]?\s?", ".", v)
    if kind == "phone":
        return _national(v)
    if kind == "name":
        return " ".join(sorted(re.findall(r"[^\W_]+", v)))
    return re.sub(r"[\W_]+", " ", v).strip()


def _national(phone: str) -> str:
    d = re.sub(r"\D", "", phone)
    return d[1:] if len(d) == 11 and d[0] in "78" else d


def surrogate(kind: str, value: str, key: str, turn: int = 0) -> str:
    """A value of the same format: digits for digits, letters of the same script and case for letters, names for names.

    It depends on the entity, not on how it is written: digits of a telephone number are chosen from the right, parts of a name
    one by one.
    """
    who = canonical(kind, value)
    d = _digest(key, kind, who, turn)
    if kind == "name":
        return _other_name(value, lambda part: _digest(key, f"name\x01{part}", who, turn))
    if kind == "phone":
        left, out = len(re.sub(r"\D", "", value)), []
        for c in value:
            if c.isdigit():
                left -= 1
                c = str(d[left % len(d)] % 10) if left < len(who) else c
            out.append(c)
        return "".join(out)
    fixed = set()
    if kind == "email":  # the shape of hiding stays
        for m in re.finditer(r"\b(?:at|собака|dot|точка)\b", value, re.I):
            fixed.update(range(*m.span()))
    if kind == "address":
        for m in re.finditer(rf"{_RU_STREET}|\b(?:г|д|дом|кв|корп|Apt|Flat|rue)\b\.?|{_EN_TYPE}|straße|gasse|allee|weg\b", value):
            fixed.update(range(*m.span()))
    return "".join(c if i in fixed else _other_char(c, d[i % len(d)]) for i, c in enumerate(value))


def _other_char(c: str, r: int) -> str:
    if c.isdigit():
        return str(r % 10)
    for alphabet in ("aeiou", "bcdfghklmnprstvz", "аеиоу", "бвгдзклмнпрст"):
        low = c.lower()
        if low in alphabet or (alphabet == "bcdfghklmnprstvz" and "a" <= low <= "z" and low not in "aeiou") or (
                alphabet == "аеиоу" and low in "ёыэюя") or (alphabet == "бвгдзклмнпрст" and "а" <= low <= "я" and low not in "аеиоуыэюя"):
            x = alphabet[r % len(alphabet)]
            return x.upper() if c != low else x
    base = unicodedata.normalize("NFD", c)[0]
    if base != c:  # without its accent
        return _other_char(base, r)
    if c.isalpha():
        x = "abdefgiklmnoprstuvz"[r % 19]
        return x.upper() if c.isupper() else x
    return c


_TAIL = re.compile(r"(?:[оеё]в[а]?|[иы]н[а]?|[сц]к(?:ий|ая)|[ое]вич|[ое]вна|ич|енко|[ую]к|ян|mann|son|ski|er|ow|ley|wick)$", re.I)


def _other_name(value: str, digest) -> str:
    """Each part replaced by what its digest, and so the whole name, chooses."""
    out = []
    for part in re.split(r"([^\w’'" + _MARKS + "])", value):
        t = unicodedata.normalize("NFC", part.title() if part.isupper() else part)
        if not part or not part[0].isalpha():
            out.append(part)
            continue
        d = digest(t.lower().replace("ё", "е"))
        if t in GENDER:
            names = GIVEN[GENDER[t]].split()
            new = names[int.from_bytes(d[:2], "big") % len(names)]
            part = new.upper() if part.isupper() and len(part) > 1 else new
        elif len(part) > 1:
            tail = _TAIL.search(part)
            stem = part[:tail.start()] if tail and tail.start() > 1 else part
            part = "".join(_other_char(c, d[i % len(d)]) for i, c in enumerate(stem)) + part[len(stem):]
        else:
            part = _other_char(part, d[0])
        out.append(part)
    return "".join(out)


MOST_TURNS = 10_000


def replace(text: str, entities: list[tuple[int, int, str]], key: str) -> tuple[str, str]:
    """The text with placeholders, and with surrogates."""
    tags: dict[tuple[str, str], str] = {}
    alike: dict[tuple[str, str], str] = {}
    used_tags, here = set(), {text[a:b].lower() for a, b, _ in entities}
    turns: dict[tuple[str, str], int] = {}
    taken: dict[str, tuple[str, str]] = {}
    with_tags, with_names, at = [], [], 0
    for a, b, kind in entities:
        value = text[a:b]
        who = (kind, canonical(kind, value))
        if who not in tags:
            turn = 0
            while (tag := f"[{kind.upper()}_{_digest(key, 'tag' + kind, who[1], turn)[:8].hex()}]") in used_tags:
                turn += 1
            used_tags.add(tag)
            tags[who] = tag
        if (kind, value) not in alike:
            # One turn for all spellings of an entity; another only if what comes out stands for another entity here.
            turn = turns.get(who, 0)
            while taken.get((other := surrogate(kind, value, key, turn)).lower(), who) != who or other.lower() in here:
                turn += 1
                if turn > MOST_TURNS:
                    raise RuntimeError(f"no free surrogate for an entity of kind {kind}")
            turns[who] = turn
            taken[other.lower()] = who
            alike[kind, value] = other
        with_tags += [text[at:a], tags[who]]
        with_names += [text[at:a], alike[kind, value]]
        at = b
    return "".join([*with_tags, text[at:]]), "".join([*with_names, text[at:]])


LEAST_SURNAMES = 3


def given_name_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word)``: the given names that the corpus teaches, words that stand first in announced names, before ``LEAST_SURNAMES``
    different surnames at least and more often than last. All texts are read and all such words kept; how many other names are
    announced does not count."""

    def run(batches):
        for batch in batches:
            pairs = set()
            for t in batch.column(0).to_pylist():
                for m in ANNOUNCED.finditer(t):
                    x, y = m["s"], m["t"]
                    comma = "," in m["name"]
                    given, surname = (y, x) if comma else (x, y)
                    pairs.add((given, surname))
            cols = list(zip(*sorted(pairs))) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["given", "surname"])

    pairs = docs.where(F.length(text) > 0).select(text).mapInArrow(run, "given string, surname string").distinct()
    sides = pairs.select(F.inline(F.array(*(  # both from one scan
        F.struct(F.col(c).alias("word"), F.lit(int(c == "given")).alias("g"), F.lit(int(c == "surname")).alias("s")) for c in ("given", "surname")))))
    words = sides.groupBy("word").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    return words.where(
        (F.col("g") >= LEAST_SURNAMES) & (F.col("g") > 2 * F.col("s")) & (F.length("word") > 2) & ~F.col("word").isin(sorted(ROLES))).select("word")


def given_names(docs: DataFrame, text: str = "text") -> frozenset[str]:
    """``given_name_table`` as a set, for callers who want to keep it for other texts (``learned``). It comes to the driver whole;
    the operators below do not use it."""
    return frozenset(r["word"] for r in given_name_table(docs, text).collect())


def _with_given_names(docs: DataFrame, id_column: str, text: str, learned: frozenset[str] | None) -> DataFrame:
    """``(id, text, given)``, one row for each of ``docs``; ``given`` are the words of the text that the corpus teaches, null for none.

    What is learned is joined by word, then by a hash of the row, so no machine has to hold all of it. Rows of one hash get the words
    of each other, which changes nothing, as only words that stand in a text are looked up.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    if learned is not None:
        return rows.withColumn("given", F.lit(None).cast("array<string>"))

    def run(batches):
        for batch in batches:
            keys, take, words = batch.column(0), [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for w in teachable(t):
                    take.append(i)
                    words.append(w)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int64())), pa.array(words, pa.string())], ["key", "word"])

    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    words = rows.where(F.length("text") > 0).select("key", "text").mapInArrow(run, "key long, word string")
    given = words.join(given_name_table(docs, text), "word").groupBy("key").agg(F.collect_set("word").alias("given"))
    return rows.join(given, "key", "left").select("id", "text", "given")


def found_entities(docs: DataFrame, id_column: str = "doc_id", text: str = "text", learned: frozenset[str] | None = None) -> DataFrame:
    """``(doc_id, pii_type, start, pii_text)``, one row for each place. Null and empty texts have none.

    ``learned`` are given names beside the common ones; by default the texts teach them.
    """
    known = docs.sparkSession.sparkContext.broadcast(frozenset(learned or ()))  # the caller's own
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, take, rows = batch.column(0), [], []
            for i, (t, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for a, b, kind in find_entities(t, frozenset(given) if given else known.value):
                    take.append(i)
                    rows.append((kind, a, t[a:b]))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(take, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())],
                [id_column, "pii_type", "start", "pii_text"])

    return _with_given_names(docs.where(F.length(text) > 0), id_column, text, learned).mapInArrow(
        run, f"`{id_column}` {id_type}, pii_type string, start int, pii_text string")


def redacted(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text", learned: frozenset[str] | None = None) -> DataFrame:
    """``(doc_id, n_entities, text_placeholders, text_surrogates)``, one row for each document; a null text stays null.

    ``key`` is a secret of the caller: with it the same entity gets the same replacements in every run, without it nobody can
    look them up.
    """
    if not key:
        raise ValueError("a secret key is needed")
    known = docs.sparkSession.sparkContext.broadcast(frozenset(learned or ()))  # the caller's own
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, tagged, named = [], [], []
            for t, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                entities = find_entities(t, frozenset(given) if given else known.value) if t else []
                x, y = replace(t, entities, key) if entities else (t, t)
                counts.append(len(entities))
                tagged.append(x)
                named.append(y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(tagged, pa.string()), pa.array(named, pa.string())],
                [id_column, "n_entities", "text_placeholders", "text_surrogates"])

    return _with_given_names(docs, id_column, text, learned).mapInArrow(
        run, f"`{id_column}` {id_type}, n_entities int, text_placeholders string, text_surrogates string")
