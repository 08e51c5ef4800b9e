"""Template residue, filler and message pages.

A multi-pattern automaton finds phrases of errors, blocks, notices and filler in the text of a
page's article. A sentence of any length counts as message or filler when the matched parts cover most
of it; a page is a case when such sentences are most of its article, when a filler sentence is left in
it, or when a field of a template is left unfilled or shows what scripts print for unset values. Sentences that only speak of such things are covered
for a small part, and fields in quotation marks or named as notation are quoted, not left.

Defined results: null, empty and blank pages are no cases; ``status`` isn't looked at; a repeated row
is judged by itself; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from wordmill.llm.article import article_blocks, aside, container_of, headline, is_meta, is_prompt, owner
from wordmill.llm.html import Block, blocks_of, title_of
from wordmill.session import spread

MESSAGE_SHARE, SENTENCE_SHARE = 0.5, 0.7

#: Parts of messages, in lower case with ``е`` for ``ё``.
MESSAGES = """
доступ запрещен|доступ ограничен|доступ закрыт|доступ заблокирован|вход запрещен|вход ограничен|вход закрыт|для вашего адреса|с вашего адреса|вашего региона|из вашей страны
слишком много запросов|превышено число запросов|превышен лимит|число запросов|повторите|попробуйте|повторите позже|попробуйте позже|повторите попытку|попробуйте снова|через минуту|через несколько минут|через несколько секунд|позже|немного
страница не найдена|страница не существует|страница удалена|материал не найден|материал не найдена|материал не существует|публикация не найдена|публикация не существует|запись не найдена|запись не существует|документ не найден|документ отсутствует|документ не существует|запрошенный адрес|указанный адрес|запрошенная страница|такой страницы нет|не найден|не найдена|не найдено|не существует|отсутствует|на сервере|на этом сайте|на нашем сайте|на сайте
ошибка|код ошибки|ошибка сервера|внутренняя ошибка|400|401|403|404|405|410|429|500|502|503|504
сервис перегружен|сервер перегружен|сервис недоступен|сервер недоступен|сайт недоступен|перемещен|перемещена|перемещено|удален|удалено|публикация|запись|материал|документ|в стадии наполнения|наполняется|это займет|займет|минуту|несколько минут|временно недоступен|временно недоступна|не удалось|невозможно|подключиться|соединиться|открыть соединение|установить соединение|с базой данных|к базе данных|к базой данных
ведутся технические работы|проводятся технические работы|технические работы|сайт|страница|раздел|портал|вскоре заработает|вскоре откроется|скоро заработает|скоро откроется|скоро вернемся|находится в разработке|в разработке|на реконструкции|извините за неудобства|приносим извинения
идет проверка|проверяем|что вы не робот|я не робот|подтвердите|подождите|несколько секунд|проверка браузера
для просмотра|для работы|для продолжения|для отображения|этой страницы|сайта|страницы|необходим|необходимо|требуется|нужен|нужны|включить|включите|включите их|javascript|яваскрипт|скрипты|скриптов|сценарии|сценариев|cookie|cookies|куки|файлы cookie|ваш браузер|этот браузер|в браузере|браузер|не поддерживает|не поддерживается|заблокировал|устарел|отключены|обновите|обновите браузер|обновите страницу|обновите его|и повторите попытку|и обновите страницу|пожалуйста|другой браузер|используйте
домен|адрес|домен припаркован|адрес припаркован|домен продается|адрес продается|припаркован|продается|хостинг|новая запись|это ваша первая запись|первая запись|отредактируйте|удалите|отредактируйте или удалите|ее|и начинайте писать
please|enable|please enable|javascript|scripts|script|cookies|to view this page|to view the page|to view this site|to continue|to run this app|you need to enable javascript to run this app|you need to|your browser|does not support|is not supported|requires javascript|turn on
not found|page not found|the page|page|document|does not exist|the requested url|was not found on this server|forbidden|access denied|access to this resource is restricted|access|denied|restricted|unauthorized|permission|you don't have permission|internal server error|bad gateway|service unavailable|service temporarily unavailable|temporarily unavailable|gateway timeout|gateway time-out|error|server error|fatal error|uncaught exception in|exception|on line|stack trace|warning|too many requests|try again later|try again
увы|к сожалению|извините|что-то пошло не так|по этой ссылке|ничего нет|ничего не найдено|нет такой страницы|нет на сервере|вернитесь|вернуться|перейдите|на главную|на главную страницу|воспользуйтесь|воспользуйтесь поиском|поиском по сайту|ссылка устарела|устарела|была удалена|удалена|перемещена|произошла ошибка|сбой|неполадки|обратитесь к администратору|время ожидания|что вы человек|введите код|с картинки|капча|подозрительная активность|необычный трафик|отключите|блокировщик рекламы|авторизуйтесь|только для зарегистрированных|только для подписчиков
document not found|something went wrong|oops|sorry|we can't find|we couldn't find|the link|is broken|has been removed|has been moved|no longer available|gone|home page|homepage|go back|go to|use the search|an error occurred|contact the administrator|captcha|unusual traffic|suspicious activity|connection|timed out|database|unable to connect|could not connect|to the database|cannot connect|sign in to continue|log in to continue|you are human|wait a few seconds|please wait|blocked|your ip|your address
default web page|it works|welcome to your new site|welcome to nginx|hello world|this is your first post|edit or delete it|just a moment|checking your browser|verify you are human|are you a robot|under construction|under maintenance|coming soon|domain is parked|domain for sale|this domain
"""
#: Parts of filler.
FILLER = """
рыба-текст|текст-рыба|рыбный текст|образец текста|пример текста|для проверки|для показа|для примера|верстки|шаблона|макета|смысла|содержания|в нем нет|здесь нет|не несет
здесь будет|здесь появится|тут будет|тут появится|место для|текст|текста|заголовок|статьи|новости|описания|заметки|заполните|замените|вставьте|удалите|его|этот|этот блок|блок|позже|потом|перед публикацией|перед выпуском
тест|тестовая|тестовый|тестовая запись|тестовая новость|test|test post|testing|проверка|проверка связи|один два|один два три|раз два три|1 2 3|123|1 2|12345|asdf|qwerty
lorem|ipsum|dolor|sit amet|consectetur|adipiscing|elit|your text here|text goes here|placeholder|sample text|insert|enter|here
"""
_PATH = re.compile(r"(?:/[\w.-]+){2,}")
_CYR = re.compile(r"[а-яё]", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: An unfilled field of the common template notations.
FIELD = re.compile(
    r"\{\{\s*[\w.$|\- ]+\s*\}\}|\$\{\s*[\w.]+\s*\}|\[\[\s*[\w.]+\s*\]\]|<%=?\s*[\w.$ ]+\s*%>|<\?(?:php|=)\s.*?\?>|\{%\s*[\w.$ ]+\s*%\}|\[%\s*[\w.$ ]+\s*%\]|@@\s*[\w.]+\s*@@"
    r"|(?<![\w%])%[A-Za-z_][A-Za-z_.]*%(?!\w)|(?<![\w#&])#[A-Za-z_][A-Za-z_.]*#(?!\w)|(?<!\w)__[A-Za-z][\w.]*?__(?!\w)|\{[A-Za-z_][\w.]*\}"
)
#: Values that scripts print for what was never set.
UNSET = re.compile(r"\[object \w+\]|(?<![\w-])(?:NaN|undefined|null(?:\s+null)*|Infinity|Invalid [Dd]ate|#N/A|NULL|None)(?![\w-])")
#: Those of them that are no words of a language.
_UNSET_PLAIN = re.compile(r"\[object \w+\]|(?<![\w-])(?:NaN|undefined|null(?:\s+null)+|Invalid [Dd]ate|#N/A)(?![\w-])")
_OPEN, _CLOSE = "«“„\"'`‘", "»”“\"'`’"
#: Words that name a notation when they stand before it.
_NOTATION = re.compile(r"(?:запис[ьи]|строк[аиу]|метк[аиу]|пол[ея]|тег[аи]?|код[аом]?|переменн\w+|обозначени\w+|конструкци\w+|выражени\w+|символ\w*|знак\w*|последовательност\w+|надпис[ьи]|the (?:string|tag|notation|field|variable|expression|placeholder)|like|such as|вида|вроде|типа)\s*[:—–-]?\s*$", re.I)

#: Single words that tell a message or filler by themselves; other single words only add to coverage.
STRONG = frozenset("400 401 403 404 405 410 429 500 502 503 504 javascript яваскрипт forbidden unauthorized тест тестовая тестовый test testing рыба-текст текст-рыба lorem ipsum placeholder oops увы asdf qwerty капча captcha".split())

_automaton = None


def _patterns(table: str) -> list[str]:
    return [p for line in table.split("\n") for p in line.split("|") if p]


def automaton():
    """Both lists in one automaton; a pattern's value is (length, whether it tells by itself, is of messages, of filler)."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        messages, filler = set(_patterns(MESSAGES)), set(_patterns(FILLER))
        for p in messages | filler:
            a.add_word(p, (len(p), " " in p or p in STRONG, p in messages, p in filler))
        a.make_automaton()
        _automaton = a
    return _automaton


def coverage(sentence: str) -> tuple[float, float]:
    """Shares of the letters and digits of a sentence covered by parts of messages and of filler;
    0 without a part that tells by itself, unless two parts make up the whole."""
    s = _PATH.sub(lambda m: " " * len(m.group()), sentence.lower().replace("ё", "е"))
    marked = [bytearray(len(s)), bytearray(len(s))]
    strong, parts = [False, False], [set(), set()]
    for end, (n, tells, *which) in automaton().iter(s):
        start = end - n + 1
        if (start and s[start - 1].isalnum()) or (end + 1 < len(s) and s[end + 1].isalnum()):
            continue
        for k in (0, 1):
            if which[k]:
                strong[k] |= tells
                parts[k].add(s[start : end + 1])
                marked[k][start : end + 1] = b"\x01" * n
    if not parts[0] and not parts[1]:
        return 0.0, 0.0
    total, covered = 0, [0, 0]
    for ch, m0, m1 in zip(s, *marked):
        if ch.isalnum():
            total += 1
            covered[0] += m0
            covered[1] += m1
    shares = [c / total if total else 0.0 for c in covered]
    return tuple(x if strong[k] or (x > 0.95 and len(parts[k]) > 1) else 0.0 for k, x in enumerate(shares))


def sentence_kind(sentence: str) -> str:
    """``message``, ``filler``, ``field`` (nothing but unfilled fields) or empty."""
    left = FIELD.sub("", sentence)
    if left != sentence and not any(ch.isalnum() for ch in left):
        return "field"
    words = sentence.lower().split()
    if words and words[0].strip("«\"“") == "lorem" and not _CYR.search(sentence):
        return "filler"
    message, filler = coverage(sentence)
    if filler >= SENTENCE_SHARE and filler >= message:
        return "filler"
    return "message" if message >= SENTENCE_SHARE else ""


def left_fields(text: str, field: re.Pattern = FIELD) -> bool:
    """Whether a field was left unfilled, not quoted or spoken of."""
    for m in field.finditer(text):
        before, after = text[: m.start()].rstrip(), text[m.end() :].lstrip()
        quoted = before[-1:] in _OPEN and after[:1] in _CLOSE if before and after else False
        if not quoted and not _NOTATION.search(before):
            return True
    return False


def is_meta_line(text: str) -> bool:
    """A byline, date, views or section, with whatever was left unfilled in it."""
    return is_meta(text) or (len(text) < 160 and is_meta(UNSET.sub("", FIELD.sub("", text)).strip()))


def page_kind(blocks: list[Block], title: str) -> str:
    """``message`` for a page without an article, ``residue`` for an article with filler or a field
    left, empty for others."""
    if not blocks:
        return ""
    head = headline(blocks, title)
    container = container_of(blocks, head)
    kinds: dict[int, list[tuple[str, int]]] = {}

    def judged(k: int) -> list[tuple[str, int]]:
        if k not in kinds:
            text = blocks[k].text
            whole = sentence_kind(text)
            kinds[k] = [(whole, len(text))] if whole else [(sentence_kind(s), len(s)) for s in _SENTENCE.split(text)]
        return kinds[k]

    def share(rows: list[int]) -> float:
        all_ = [x for k in rows for x in judged(k)]
        return sum(n for kind, n in all_ if kind) / max(1, sum(n for _, n in all_))

    body = article_blocks(blocks, head, container)
    if body and share(body) >= MESSAGE_SHARE:
        return "message"
    if head is None or not body:
        # No headline tells where the article is: the first block that is all message or filler does.
        for k, b in enumerate(blocks):
            if b.link_share < 0.5 and not aside(b) and not is_meta(b.text) and any(kind for kind, _ in judged(k)) and share([k]) >= SENTENCE_SHARE:
                own = [k]
                for j in range(k + 1, len(blocks)):
                    if owner(blocks[j]) != owner(b) or is_prompt(blocks[j].text):
                        break
                    if not is_meta(blocks[j].text):
                        own.append(j)
                if share(own) >= MESSAGE_SHARE:
                    return "message"
    # The byline and other meta lines of the article belong to its visible text.
    meta = [k for k, b in enumerate(blocks) if b.ids and container and (b.ids[-1] == container or owner(b) == container) and is_meta_line(b.text)]
    for k in body + meta:
        if left_fields(blocks[k].text) or any(kind == "filler" for kind, _ in judged(k)):
            return "residue"
    # A value that was never set: any in a meta line, in Russian sentences those that are no words.
    if any(left_fields(blocks[k].text, UNSET) for k in meta) or any(_CYR.search(blocks[k].text) and left_fields(blocks[k].text, _UNSET_PLAIN) for k in body):
        return "residue"
    return ""


def _run(batches):
    for b in batches:
        ids, kinds = [], []
        for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kind = page_kind(blocks_of(html), title_of(html)) if html else ""
            if kind:
                ids.append(i)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["page_id", "kind"])


def residue_pages(pages: DataFrame) -> DataFrame:
    """(page_id, kind) of the pages that hold a message or filler in place of, or amid, an article."""
    return spread(pages.select("page_id", "raw_html").where("raw_html is not null")).mapInArrow(_run, "page_id long, kind string")


def _keep(batches, html: int):
    import pyarrow.compute as pc

    for b in batches:
        bad = [bool(h) and bool(page_kind(blocks_of(h), title_of(h))) for h in b.column(html).to_pylist()]
        yield b.filter(pc.invert(pa.array(bad, pa.bool_())))


def without_residue(pages: DataFrame) -> DataFrame:
    """The collection without them; all columns stay. A page is judged where it is read: no join."""
    html = pages.columns.index("raw_html")
    return spread(pages).mapInArrow(lambda batches: _keep(batches, html), pages.schema)
