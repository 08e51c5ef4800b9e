"""Personal information in free text: bootstrapped contextual extraction.

Tasks scan texts for candidates. A few shapes are seeds by themselves (``+7 (946) 689-62-15``, a
number right behind ``СНИЛС``, a patronymic between two names, a given name of a short list); all
others are only possible items: local numbers, digits of any grouping, e-mail addresses written
so that programs miss them, streets without ``дом``, capitalised words of unknown given names. Spark
scores the graph of patterns (the words before and after) and instances (a number's form, the stem of
a given name): a pattern most of whose candidates are accepted is trusted and accepts its other
candidates, whose instances and other patterns are trusted in the next round, until a round adds
nothing. What no trusted pattern or instance supports is left out.

Defined results: null, empty and blank texts have no items; positions are code points from 0;
each occurrence is a row; items of one text don't overlap (the more specific kind wins); a repeated
row has its items again; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.session import materialise, spread

#: Rounds at most; the scores settle after three or four.
ROUNDS = 8
#: Share of accepted candidates from which a pattern is trusted, and the candidates it must have. Shapes of
#: numbers and streets tell more than two capitalised words do.
TRUST, TRUST_NAME, SUPPORT = 0.4, 0.6, 3
#: Share and support a pattern must have to take in what has no shape of the kind at all.
TRUST_ANY, SUPPORT_ANY = 0.9, 10
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Seed given names.
GIVEN_RU = """александр анатолий антон артём вадим валерий виктор владимир вячеслав георгий григорий денис евгений иван илья константин леонид марат михаил николай павел роман семён станислав тимур юрий ярослав
александра алина анастасия валентина вера виктория дарья евгения елена жанна зоя ирина кира ксения лидия людмила марина надежда наталия оксана ольга раиса софия тамара ульяна яна"""
GIVEN_EN = """alexander andrey boris dmitry evgeny gleb igor ivan konstantin maxim mikhail nikolay pavel roman stepan vladimir alena anastasia daria ekaterina irina yulia marina nina polina tamara vera
james robert william richard charles patricia linda susan karen emma peter jack alice"""

_W = r"[^\W\d_]"
_WORD = re.compile(rf"{_W}+(?:-{_W}+)*")
_AT = r"(?:\s?[@＠]\s?|\s?[(\[{<]\s?(?:at|а|собака|собачка|dog)\s?[)\]}>]\s?|\s(?:собака|at)\s)"
_DOT = r"(?:\s?\.\s?|\s?[(\[{<]\s?(?:dot|точка|тчк)\s?[)\]}>]\s?|\s(?:dot|точка)\s)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)({_AT})([A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*(?:\.|{_DOT})[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
_EMAIL_HINT = re.compile(r"[@＠]|собак|собач|[(\[{<]\s?(?:at|а|dog)\s?[)\]}>]|\bat\b.{1,40}(?:\bdot\b|\.\w\w)", re.I)

#: Stays on its line.
_NUMBER = re.compile(r"(?<![\w.,:/№-])(?:\+[^\S\n]?|\()?\d(?:[\d().–—‑-]|[^\S\n])*(?:(?:[^\S\n]?№[^\S\n]?|,[^\S\n]?номер[^\S\n]|[^\S\n]номер[^\S\n])\d{6}|\d)(?![\w/]|[:,.]\d|-\w)")
_GROUP = re.compile(r"\S+")
_DECIMAL = re.compile(r"\d+\.\d+")
_DATE = re.compile(r"\d{1,2}[.-]\d{1,2}[.-]\d{2,4}|\d{4}[.-]\d{1,2}[.-]\d{1,2}")
_SEP = r"[\s.–—‑-]*"
_PHONE_FULL = re.compile(rf"(?:\+\s?7|[78])(?:{_SEP}\(?\d{{3,5}}\)?{_SEP}\d{{1,3}}{_SEP}\d{{2}}{_SEP}\d{{2}})")
_PHONE_CODE = re.compile(rf"\(\d{{3,5}}\){_SEP}\d{{1,3}}{_SEP}\d{{2}}{_SEP}\d{{2}}")
_PHONE_WORLD = re.compile(r"\+\s?\d{1,3}[\s().–—‑-]*(?:\d[\s().–—‑-]*){7,11}")
_PHONE_LOCAL = re.compile(r"\d{1,3}[-–—‑ ]\d{2}[-–—‑ ]\d{2}|\d{3}[-–—‑ ]\d{4}")
_PHONE_TEN = re.compile(rf"\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}")
_PASSPORT = re.compile(r"(\d{2}\s?\d{2})(\s?№\s?|,\s?номер\s|\sномер\s|\s)(\d{6}|\d{3}\s\d{3})")
_SNILS = re.compile(r"\d{3}[-–\s]\d{3}[-–\s]\d{3}[-–\s]\d{2}")
_TAX = re.compile(r"\d{4}[\s-]?\d{4}[\s-]?\d{4}|\d{2}[\s-]\d{2}[\s-]\d{6}[\s-]\d{2}")
#: Words that name a personal document right before its number.
_DOCUMENT = re.compile(r"(?:паспорт\w*|удостоверяющ\w+ личность|личность|снилс|страхов\w+ (?:свидетельств\w+|номер\w*)|личн\w+ инн|инн|налогов\w+ номер\w*|passport|social security|snils|insurance number|tax id)(?:\s+(?:серии|серия|граждан\w+|номер|no\.?|number))?\s*[:№—–-]?\s*$", re.I)

_STREET = r"(?:улиц[аеуыи]|улицей|ул\.?|проспект[аеу]?|просп\.?|пр-т[аеу]?\.?|пр-кт\.?|переул(?:ок|к[аеу])|пер\.?|проезд[аеу]?|пр-д\.?|шоссе|ш\.|бульвар[аеу]?|бул\.?|б-р\.?|набережн(?:ая|ой|ую)|наб\.?|площад[ьи]|пл\.?|аллея|аллеи|аллее|тупик[аеу]?|тракт[аеу]?|линия|линии|микрорайон[аеу]?|мкр\.?)"
_NAMED = r"(?:\d{1,2}-[а-я]{1,2}\s)?[А-ЯЁ][А-Яа-яЁё-]+(?:\s[А-ЯЁ][А-Яа-яЁё-]+){0,2}"
_HOUSE = r"\d{1,4}\s?[а-яА-Я]?(?![А-Яа-яЁё\d])(?:\s?/\s?\d+\s?[а-яА-Я]?(?![А-Яа-яЁё\d]))?"
_HOUSE_WORD = r"(?:дом[аеу]?|д\.?)\s?(?:№\s?|N\s?)?"
_REST = r"(?:,?\s?(?:корп(?:\.|ус)?|к\.|стр(?:\.|оение)?|кв(?:\.|артира)?|оф(?:\.|ис)?|помещ\.?)\s?(?:№\s?)?\d+[а-яА-Я]?)*"
_ADDRESS = re.compile(
    rf"(?<!\w)(?:(?i:{_STREET})\s?{_NAMED}|{_NAMED}\s(?i:{_STREET}))(?:\s?,\s?|\s)(?i:{_HOUSE_WORD})?{_HOUSE}(?!:)(?i:{_REST})"
    rf"|(?<!\w)(?i:{_HOUSE_WORD}){_HOUSE}(?i:{_REST}),?\s(?:по|на|ПО|НА)\s(?i:{_STREET})\s?{_NAMED}"
)
_ADDRESS_HINT = re.compile(rf"(?<!\w){_STREET}(?!\w)", re.I)
_STREET_EN = re.compile(r"(?<![\w.,:-])\d{1,4}[A-Za-z]?\s(?:[A-Z][\w'-]+\s){1,3}(?:Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Drive|Dr|Boulevard|Blvd|Square|Sq|Court|Ct|Place|Pl|Way|Terrace|Crescent|Quay|Embankment|Alley)\b\.?(?:,?\s(?:apt|apartment|flat|unit|suite)\.?\s?#?\d+\w?)?")
_CAPITAL = re.compile(r"[А-ЯЁA-Z]")
#: A house by its word.
_FULL_ADDRESS = re.compile(r"\b(?:дом[аеу]?\b|д\.)", re.I)
#: The form of a candidate without a shape of its kind.
ANY = "?"

_PATRONYMIC = re.compile(r"\w{2,}(?:ович|евич|ьич|ич)(?:а|у|ем|ом|е)?|\w{2,}(?:овн|евн|ичн|иничн)(?:а|ы|е|у|ой|ою)", re.I)
_SURNAME = re.compile(
    r"\w{2,}(?:ов|ев|ёв|ин|ын)(?:а|у|ым|е|ой|ою|ы)?|\w{2,}(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую|ою)|\w{3,}(?:енко|енок|ко|ук|юк|чук|ян|янц|дзе|швили|их|ых)"
    r"|\w{2,}(?:ov|ev|in|yn)a?|\w{3,}(?:sk|sky|skiy|skaya|ska|tsky|enko|uk|yan|vich)",
    re.I,
)


def given_forms(name: str) -> list[str]:
    """The cases of a Russian given name."""
    name = name.replace("ё", "е")
    if name in ("петр", "павел", "лев"):
        stem = {"петр": "петр", "павел": "павл", "лев": "льв"}[name]
        return [name, *(stem + e for e in ("а", "у", "ом", "е"))]
    if name.endswith("ия"):
        return [name[:-1] + e for e in ("я", "и", "ю", "ей")]
    if name.endswith("я"):
        return [name[:-1] + e for e in ("я", "и", "е", "ю", "ей")]
    if name.endswith("а"):
        return [name[:-1] + e for e in ("а", "ы", "и", "е", "у", "ой", "ою")]
    if name.endswith("й"):
        return [name[:-1] + e for e in ("й", "я", "ю", "ем", "е", "и")]
    if name.endswith("ь"):
        return [name[:-1] + e for e in ("ь", "я", "ю", "ем", "е", "и", "ью")]
    return [name + e for e in ("", "а", "у", "ом", "ем", "е")]


def seed_forms(names: list[str]) -> frozenset[str]:
    """All forms of given names in either alphabet."""
    return frozenset(f for n in names for f in ([n] if n.isascii() else given_forms(n)))


#: Given names that the rounds start from.
SEED_NAMES = tuple((GIVEN_RU + " " + GIVEN_EN).split())
_CASE = re.compile(r"(?:ою|ей|ой|ом|ем|ью|[аеиоуыюяьй])$")


def _given_stem(word: str) -> str:
    """What the cases of a given name have in common."""
    low = word.lower().replace("ё", "е")
    return _CASE.sub("", low) or low


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words and the word before, and the word after; digits to 0."""
    left = re.sub(r"\d+", "0", text[max(0, start - 60) : start].lower()).split()
    left = [w.strip("(«\"[") or w for w in left]
    right = [x.rstrip(".,;:!?…»”\")]") for x in re.sub(r"\d+", "0", text[end : end + 40].lower()).split()[:1]]
    one = left[-1] if left else "^"
    return " ".join(left[-2:]) or "^", one, (right[0] if right else "") or "$"


def _trim_number(s: str) -> str:
    s = s.rstrip(" \t\r\n.–—‑-")
    while s.endswith("(") or s.count("(") > s.count(")") and s.rstrip().endswith("("):
        s = s[:-1].rstrip()
    if s.endswith(")") and s.count(")") > s.count("("):
        s = s[:-1].rstrip()
    return s


def _number_kind(raw: str, before: str) -> tuple[str, bool] | None:
    """(kind, seed) of a number by its shape and a label before it."""
    digits = re.sub(r"\D", "", raw)
    n = len(digits)
    if n < 5 or n > 15:
        return None
    labelled = bool(_DOCUMENT.search(before))
    if _SNILS.fullmatch(raw):
        return "id_number", labelled
    if _PASSPORT.fullmatch(raw):
        return "id_number", labelled
    if n == 12 and _TAX.fullmatch(raw):
        return "id_number", labelled
    if _PHONE_FULL.fullmatch(raw) and n == 11:
        return "phone", raw.startswith("+") or "(" in raw
    if (_PHONE_CODE.fullmatch(raw) and 8 <= n <= 10) or (raw.startswith("+") and _PHONE_WORLD.fullmatch(raw)):
        return "phone", raw.startswith("+")
    if n == 11 and raw.isdigit():
        return "id_number", labelled
    if _PHONE_LOCAL.fullmatch(raw) or (n == 10 and not raw.isdigit() and _PHONE_TEN.fullmatch(raw)):
        return "phone", False
    return None


def _number_at(text: str, start: int, raw: str):
    """(kind, start, end, form, seed) of one number, None without a kind."""
    found = _number_kind(raw, text[max(0, start - 50) : start])
    if not found and raw.startswith("("):
        # The bracket belongs to the sentence, not to the number.
        inner = raw[1:].lstrip()
        start += len(raw) - len(inner)
        raw = _trim_number(inner)
        found = _number_kind(raw, text[max(0, start - 50) : start - 1].rstrip("( "))
    return (found[0], start, start + len(raw), re.sub(r"\d", "0", raw), found[1]) if found else None


def _numbers(text: str):
    """(kind, start, end, form, seed)"""
    for m in _NUMBER.finditer(text):
        whole = _number_at(text, m.start(), _trim_number(m.group()))
        if whole:
            yield whole
            continue
        # Several numbers parted by blanks: from each group on, the longest run that has a kind.
        groups = [(g.start(), g.end(), sum(ch.isdigit() for ch in g.group())) for g in _GROUP.finditer(text, m.start(), m.end())]
        i, any_kind = 0, False
        while i < len(groups) and len(groups) > 1:
            n, j = 0, i
            while j < len(groups) and n + groups[j][2] <= 15:
                n += groups[j][2]
                j += 1
            found = None
            while groups[i][2] and j > i and not found:
                j -= 1
                parts = text[groups[i][0] : groups[j][1]].split()
                if len(parts) > 1 and any(_DECIMAL.fullmatch(x) for x in parts):  # a row of figures
                    continue
                found = _number_at(text, groups[i][0], _trim_number(text[groups[i][0] : groups[j][1]]))
            if found:
                yield found
                any_kind = True
            i = j + 1 if found else i + 1
        if not any_kind:
            yield from _any_number(text, m.start(), m.end())


def _any_number(text: str, start: int, end: int):
    raw = _trim_number(text[start:end])
    if 5 <= sum(ch.isdigit() for ch in raw) <= 15 and not _DECIMAL.fullmatch(raw) and not _DATE.fullmatch(raw):
        for kind in ("phone", "id_number"):
            yield kind, start, start + len(raw), ANY, False


_kinds: dict[str, int] = {}
_given: frozenset[str] = frozenset()


def use_names(given: frozenset[str]) -> None:
    """Sets the seed given names of this process."""
    global _given
    if given != _given:
        _given = given
        _kinds.clear()


use_names(seed_forms(list(SEED_NAMES)))


def _word_kind(w: str) -> int:
    """1 a given name, 2 a patronymic, 4 shaped like a surname, 8 capitalised."""
    k = _kinds.get(w)
    if k is None:
        low = w.lower().replace("ё", "е")
        k = (low in _given) | (2 if len(w) > 5 and _PATRONYMIC.fullmatch(w) else 0) | (4 if _SURNAME.fullmatch(w) and len(w) > 3 else 0) | (8 if w[0].isupper() else 0)
        if len(_kinds) > 300_000:
            _kinds.clear()
        _kinds[w] = k
    return k


#: Words that begin sentences and are no names.
_NO_NAME = frozenset("для при под над про без как так там тут это эти этот эта уже ещё или его она они оно вот все всё где когда если после перед между через также при вместе около вокруг против среди ради кроме the and for with from that this there what when after before".split())
_INITIAL = re.compile(r"[А-ЯЁA-Z]")


def _names(text: str):
    """(start, end, given word or initials, seed). Patterns: given [patronymic|initial] surname, surname
    given [patronymic], surname initials, initials surname."""
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    n = len(words)
    kinds = [_word_kind(w) if w[0].isupper() else 0 for _, _, w in words]

    def near(a: int, b: int, dot: bool = False) -> bool:
        """Words a and b stand next to each other (after an initial: a dot and an optional blank)."""
        g = text[words[a][1] : words[b][0]]
        if dot:
            return g in (".", ". ", ". ") or g.strip("  \n\r\t") == "." and len(g) < 5
        return 0 < len(g) < 5 and g.isspace()

    def initial(k: int) -> bool:
        return 0 <= k < n and words[k][1] - words[k][0] == 1 and bool(_INITIAL.match(words[k][2])) and text[words[k][1] : words[k][1] + 1] == "."

    def inside(k: int) -> bool:
        """Not at the beginning of a line or sentence."""
        left = text[max(0, words[k][0] - 4) : words[k][0]].rstrip(" \u00a0«„(\"")
        return bool(left) and left[-1] not in ".!?…\n:"

    i = 0
    while i < n:
        k = kinds[i]
        if not k:
            i += 1
            continue
        if initial(i):
            # X. [Y.] Surname
            j = i + 1
            if initial(j) and near(i, j, True):
                j += 1
            if j < n and kinds[j] & 8 and near(j - 1, j, True) and len(words[j][2]) > 2 and not initial(j):
                yield words[i][0], words[j][1], "initials", bool(kinds[j] & 4)
                i = j + 1
                continue
            i += 1
            continue
        if k & 1:
            # Given [Patronymic | X.] Surname
            j = i + 1
            if j < n and kinds[j] & 2 and near(i, j):
                if j + 1 < n and kinds[j + 1] & 8 and near(j, j + 1) and kinds[j + 1] & 4:
                    yield words[i][0], words[j + 1][1], words[i][2].lower(), True
                    i = j + 2
                    continue
            elif initial(j) and near(i, j):
                if j + 1 < n and kinds[j + 1] & 8 and near(j, j + 1, True) and len(words[j + 1][2]) > 2:
                    yield words[i][0], words[j + 1][1], words[i][2].lower(), True
                    i = j + 2
                    continue
            elif j < n and kinds[j] & 4 and kinds[j] & 8 and not kinds[j] & 1 and near(i, j):
                yield words[i][0], words[j][1], words[i][2].lower(), True
                i = j + 1
                continue
        j = i + 1
        if not k & 1 and j + 1 < n and len(words[i][2]) > 2 and kinds[j + 1] & 12 == 12 and words[i][2].lower() not in _NO_NAME:
            # The same around a given name that isn't known: the patronymic or initial tells.
            if "\n" not in text[words[i][1] : words[j][0]] and ((kinds[j] & 2 and not k & 2 and near(i, j) and near(j, j + 1)) or (initial(j) and not k & 4 and near(i, j) and near(j, j + 1, True))):
                # At the beginning of a sentence any word is capitalised: there the initial alone is sure.
                sure = bool(kinds[j] & 2) or inside(i)
                yield words[i][0], words[j + 1][1], words[i][2], sure
                if not sure:
                    yield words[j][0], words[j + 1][1], "initials", True
                i = j + 2
                continue
        if k & 4 or (k & 8 and i + 1 < n and (kinds[i + 1] & 1 or kinds[i + 1] & 2)):
            if j < n and kinds[j] & 1 and near(i, j) and k & 4:
                # Surname Given [Patronymic]
                end = j
                if j + 1 < n and kinds[j + 1] & 2 and near(j, j + 1):
                    end = j + 1
                yield words[i][0], words[end][1], words[j][2].lower(), True
                i = end + 1
                continue
            if initial(j) and (near(i, j) or text[words[i][1] : words[j][0]].strip() in ("", ",")) and words[j][0] - words[i][1] < 4 and k & 4:
                # Surname X. [Y.]
                end = j
                if initial(j + 1) and near(j, j + 1, True):
                    end = j + 1
                # Behind a comma the initials may be those of the next name: a surname follows them then.
                if "," in text[words[i][1] : words[j][0]] and end + 1 < n and kinds[end + 1] & 12 == 12 and near(end, end + 1, True):
                    yield words[j][0], words[end + 1][1], "initials", True
                    i = end + 2
                    continue
                # With one initial a surname of the next name may follow: its own initial then.
                if end == j and j + 1 < n and kinds[j + 1] & 8 and near(j, j + 1, True) and kinds[j + 1] & 4:
                    yield words[j][0], words[j + 1][1], "initials", True
                    i = j + 2
                    continue
                yield words[i][0], words[end][1] + 1, "initials", True
                i = end + 1
                continue
        # Unknown given names: two or three capitalised words, one of them shaped like a surname.
        j = i + 1
        first = words[i][2].lower()
        if len(first) > 2 and first not in _NO_NAME and j < n and kinds[j] & 8 and near(i, j) and not initial(j) and (k | kinds[j]) & 4:
            if kinds[j] & 2 and j + 1 < n and kinds[j + 1] & 12 == 12 and near(j, j + 1):
                yield words[i][0], words[j + 1][1], words[i][2].lower(), True
                i = j + 2
                continue
            if k & 4 and j + 1 < n and kinds[j + 1] & 2 and near(j, j + 1):
                yield words[i][0], words[j + 1][1], words[j][2].lower(), True
                i = j + 2
                continue
            if words[i][2].isupper() and words[j][2].isupper():  # a heading, not two names
                i += 1
                continue
            given = words[i][2] if kinds[j] & 4 and not k & 4 else words[j][2]
            yield words[i][0], words[j][1], given, False
        elif len(first) > 2 and first not in _NO_NAME and j < n and kinds[j] & 8 and near(i, j) and not initial(j) and not (k | kinds[j]) & 1 and len(words[j][2]) > 2 and words[i][2][1:].islower() and words[j][2][1:].islower():
            yield words[i][0], words[j][1], ANY, False
        i += 1


def scan(text: str) -> list[tuple]:
    """Candidates of a text: (kind, start, end, form, seed); the form is ``ANY`` where nothing but the
    context can tell."""
    out = []
    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            sign = m.group(2).strip()
            plain = (sign == "@" or sign[0] in "([{<") and " " not in m.group(3)
            out.append(("email", m.start(), m.end(), "@" if sign == "@" else sign.lower(), plain))
    if _ADDRESS_HINT.search(text):
        for m in _ADDRESS.finditer(text):
            if _CAPITAL.search(m.group()):
                word = _ADDRESS_HINT.search(m.group())
                out.append(("address", m.start(), m.end(), word.group().lower().rstrip(".") if word else "", bool(_FULL_ADDRESS.search(m.group()))))
    for m in _STREET_EN.finditer(text):
        last = m.group().split(",")[0].split()[-1].rstrip(".").lower()
        out.append(("address", m.start(), m.end(), last, last in ("street", "avenue", "road", "lane")))
    taken = [(s, e) for _, s, e, _, _ in out]
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    numbers = [x for x in _numbers(text) if free(x[1], x[2])]
    names = []
    for s, e, form, seed in _names(text):
        form = form if form in (ANY, "initials") else _given_stem(form)
        if free(s, e) and not _ADDRESS_HINT.search(text[max(0, s - 14) : s].rsplit("\n", 1)[-1]):
            names.append(("name", s, e, form, seed))
    return out + numbers + names


_CANDIDATE = "doc_id long, kind string, start_pos long, end_pos long, form string, seed boolean, two string, one string, after string"


def _scan_task(given: frozenset[str]):
    return lambda batches: _scanned(batches, given)


def _scanned(batches, given: frozenset[str]):
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    use_names(given)
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            rows = []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if t:
                    for kind, s, e, form, seed in scan(t):
                        rows.append((i, kind, s, e, form, seed, *_context(t, s, e)))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def personal_items(documents: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT, names: tuple[str, ...] = SEED_NAMES) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of each item, end exclusive. ``names`` are the given names to start from.

    The rounds work on the table of patterns, instances and counts, which pre-aggregation keeps
    small; only the last step goes back to the candidates."""
    found = spread(documents.select("doc_id", "text").where("text is not null")).mapInArrow(_scan_task(seed_forms(list(names))), _CANDIDATE)
    found = materialise(found, "candidates")
    return _accepted(found, rounds, trust, support).select("doc_id", "kind", "start_pos", "end_pos")


def _accepted(found: DataFrame, rounds: int, trust: float, support: int) -> DataFrame:
    """The candidates that are seeds or that a trusted pattern or instance accepts."""
    # Nodes: contexts on either side, and instances. An edge is a group of candidates alike in all.
    nodes = ("two", "one", "after", "form")
    edges = materialise(found.groupBy("kind", *nodes).agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds")), "edges")
    state = edges.withColumn("yes", F.col("seeds").cast("double"))
    before = -1.0
    for _ in range(rounds):
        total = state.agg(F.coalesce(F.sum("yes"), F.lit(0.0))).first()[0]
        if total == before:  # the last round accepted nothing new
            break
        before = total
        scored = state
        for node in nodes:
            # A pattern that stands with everything proves nothing: trust needs support and a high share.
            score = state.groupBy("kind", node).agg(F.sum("yes").alias("y"), F.sum("n").alias("t")).select("kind", node, (F.col("y") / (F.col("t") + 1)).alias(f"s_{node}"), F.col("t").alias(f"t_{node}")).where(F.col(f"t_{node}") >= support)
            scored = scored.join(score, ["kind", node], "left")
        own = F.when(F.col("kind") == "name", TRUST_NAME).otherwise(trust)
        ok = lambda node, share=own, least=support: (F.col(f"t_{node}") >= least) & (F.col(f"s_{node}") >= share)
        shaped, right = F.col("form") != ANY, F.col("after") != "$"
        by_form = shaped & ok("form") & (F.col("form") != "initials")
        vouched = (shaped & (ok("two") | ok("one") | (right & ok("after", own, SUPPORT_ANY)))) | by_form | ok("two", TRUST_ANY, SUPPORT_ANY) | ok("one", TRUST_ANY, SUPPORT_ANY)
        state = materialise(
            scored.select("kind", *nodes, "n", "seeds", F.when(vouched | (F.col("yes") > F.col("seeds")), F.col("n").cast("double")).otherwise(F.col("seeds").cast("double")).alias("yes")), "graph"
        )
    good = state.where("yes > seeds").select("kind", *nodes)
    more = found.where("not seed").join(good, ["kind", *nodes], "left_semi")
    # Digits without a shape are candidates of two kinds; of both accepted one stays.
    either = more.where((F.col("form") == ANY) & F.col("kind").isin("phone", "id_number")).groupBy("doc_id", "start_pos", "end_pos").agg(F.max("kind").alias("kind"))
    columns = ["doc_id", "kind", "start_pos", "end_pos"]
    more = more.where(~((F.col("form") == ANY) & F.col("kind").isin("phone", "id_number"))).select(*columns).unionByName(either.select(*columns))
    every = found.where("seed").select(*columns).unionByName(more)
    # Of accepted items that end together the longest stays: with the given name before the initial.
    return every.groupBy("doc_id", "kind", "end_pos").agg(F.min("start_pos").alias("start_pos")).select(*columns)


def _mask_task(batches):
    for b in batches:
        ids, texts, items = (b.column(k).to_pylist() for k in range(3))
        out = []
        for t, found in zip(texts, items):
            if t and found:
                parts, at = [], 0
                for x in sorted(found, key=lambda x: (x["start_pos"], -x["end_pos"])):
                    if x["start_pos"] >= at:
                        parts += [t[at : x["start_pos"]], PLACEHOLDER[x["kind"]]]
                        at = x["end_pos"]
                t = "".join(parts) + t[at:]
            out.append(t)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def masked_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every document, items replaced by typed placeholders. Null stays null."""
    items = personal_items(documents).groupBy("doc_id").agg(F.collect_set(F.struct("start_pos", "end_pos", "kind")).alias("items"))
    return documents.select("doc_id", "text").join(items, "doc_id", "left").select("doc_id", "text", "items").mapInArrow(_mask_task, "doc_id long, text string")
