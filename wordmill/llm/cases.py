"""Literal cases of problems whose definition SQL can't express: what goes in and what must come out.

They run through the operators with production parameters; the pN_found queries cover the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.session import ship

_SITE = [("Школа открыла парк", "школы"), ("Мост закрыт", "моста"), ("Театр ждёт гостей", "театра"), ("Рынок переехал", "рынка")]


def _page(k: int, body: str, title: str | None = None) -> str:
    """A page without telling names: what pages of the site share is the site's."""
    title = title or _SITE[k % 4][0]
    return (
        f"<title>{title}</title><body><div><div>Сайт города. Все права защищены.</div><div><div>{title}</div>{body}<div>Спасибо всем.</div></div>"
        f"<div><h3>Мнения</h3><div>Мнение читателя {k}.</div></div><div>Пишите нам по адресу редакции.</div></div></body>"
    )


def _body(k: int) -> list[str]:
    return [f"Это абзац {j} статьи {k} для {_SITE[k % 4][1]}." for j in range(3)]


PAGES = {k: _page(k, "".join(f"<div>{x}</div>" for x in _body(k))) for k in range(4)}
MAIN = {k: [_SITE[k][0], *_body(k), "Спасибо всем."] for k in range(4)}

_NEWS = "<p>Город получил новый парк у реки, и жители пришли на праздник.</p>"


def _plain(body: str, title: str = "Школа открыла парк") -> str:
    return f"<title>{title} — Вестник</title><body><nav><a href='/'>Главная</a></nav><div><h1>{title}</h1><div>Автор: редакция</div>{body}</div></body>"


#: (page, whether it is a case)
RESIDUE = [
    (_plain(_NEWS), False), (_plain("<p>Страница не найдена</p>", "404 Not Found"), True), ("<p>Please enable JavaScript to view this page</p>", True),
    (_plain(_NEWS + "<p>Город {region_name} рад.</p>"), True), (_plain("<div>Просмотров: 12 NaN</div>" + _NEWS), True), (_plain("<div>12.05.2023, 10:00 null null</div>" + _NEWS), True),
    (_plain(_NEWS + "<p>Здесь будет текст статьи. Замените его позже.</p>"), True), (_plain(_NEWS + "<p>В письме осталось «{{name}}», рассказали в школе.</p>"), False),
    (_plain(_NEWS + "<p>Посетителям показывали надпись «страница не найдена», и город починил сайт.</p>"), False), (None, False), ("", False),
]

_SUPPORT = [t.format(k) for k in range(10, 20) for t in ("Запись (+7 946 689-62-{}) открыта.", "Справки по телефону +7 946 689-62-{}.", "Приём по адресу: проезд Луговой, дом {}.", "В заявлении указан СНИЛС 231-027-112-{}, и архив.")]
#: (text, items as (kind, first character))
PERSONAL = [
    ("Пишите ivan@post.example сегодня", [("email", 7)]), ("Запись (8 948 307 53 91) открыта.", [("phone", 8)]), ("Справки по телефону 6-81-14.", [("phone", 20)]), ("Матч 6-81-14 окончен.", []),
    ("В заявлении указан СНИЛС 231-027-112-94, и архив.", [("id_number", 25)]), ("Расчётный счёт фонда 40732404154025672401.", []), ("Приём по адресу: проезд Луговой, 99/5, кв. 75.", [("address", 17)]),
    ("Как сообщает Сергей Фёдорович Дубочов, закон принят.", [("name", 13)]), ("К Светларину Л. К. обратились.", [("name", 2)]), ("Движение по улице Лесной перекроют до 18:58.", []), (None, []), ("", []),
    *((t, None) for t in _SUPPORT),
]


def main_body_cases(spark: SparkSession) -> DataFrame:
    from wordmill.llm.mainbody import main_blocks

    ship(spark)
    rows = [(k, f"https://a.example/n/{k:03}", h) for k, h in PAGES.items()]
    return main_blocks(spark.createDataFrame(rows, "page_id long, url_norm string, raw_html string").withColumn("url", F.col("url_norm"))).select("page_id", "block_md5")


def main_body_sql() -> str:
    rows = sorted({(k, hashlib.md5(t.encode()).hexdigest()) for k, texts in MAIN.items() for t in texts})
    return f"select * from (values {', '.join(f'''({k}::bigint, '{m}')''' for k, m in rows)}) t(page_id, block_md5)"


def residue_cases(spark: SparkSession) -> DataFrame:
    from wordmill.llm.residue import residue_pages

    ship(spark)
    return residue_pages(spark.createDataFrame([(k, h) for k, (h, _) in enumerate(RESIDUE)], "page_id long, raw_html string")).select("page_id")


def residue_sql() -> str:
    return f"select * from (values {', '.join(f'({k}::bigint)' for k, (_, case) in enumerate(RESIDUE) if case)}) t(page_id)"


def personal_cases(spark: SparkSession) -> DataFrame:
    from wordmill.llm.pii import personal_items

    ship(spark)
    told = sum(want is not None for _, want in PERSONAL)
    found = personal_items(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PERSONAL)], "doc_id long, text string"))
    return found.where(F.col("doc_id") < told).select("doc_id", "kind", "start_pos")


def personal_sql() -> str:
    rows = [(k, kind, at) for k, (_, want) in enumerate(PERSONAL) for kind, at in want or ()]
    return f"select * from (values {', '.join(f'''({k}::bigint, '{kind}', {at}::bigint)''' for k, kind, at in rows)}) t(doc_id, kind, start_pos)"
