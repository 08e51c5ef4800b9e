"""Problems 4 and 6 on small pages."""

import hashlib
import random

import pytest

from wordmill.llm import mainbody, residue
from wordmill.llm.html import blocks_of, title_of


def layout(title, body, menu=("Новости", "Спорт"), tail="", source="Вестник"):
    items = "".join(f"<li><a href='/{k}'>{m}</a></li>" for k, m in enumerate(menu))
    return f"<html><head><title>{title} — {source}</title></head><body><nav><ul>{items}</ul></nav><div><h1>{title}</h1><div>Автор: редакция</div>{body}<div>Поделиться</div></div>{tail}<footer><p>© {source}. Обратная связь</p></footer></body></html>"


PAGES = "page_id long, url_norm string, url string, raw_html string, host string"


def found(spark, pages):
    rows = [(i, u, u, h, "x") for i, u, h in pages]
    out = {}
    for r in mainbody.main_blocks(spark.createDataFrame(rows, PAGES)).collect():
        assert r.block_md5 == hashlib.md5(r.block.encode()).hexdigest()
        out.setdefault(r.page_id, set()).add(r.block)
    return out


def test_main_body(spark):
    one = layout("Школа открыла парк", "<p>Первый <b>абзац,</b> текста.</p><p>И это не всё.</p><div>Читайте также: <a href='/9'>Другая новость дня</a></div><ul><li>пункт один;</li></ul><figure><figcaption>Фото: архив</figcaption></figure>")
    two = layout("Мост закрыт", "<p>Дорогу &amp; мост&nbsp;закрыли.<p>И это не всё.", tail="<div><h3>Комментарии</h3><div>user1<p>Спасибо за новость!</p></div></div>")
    got = found(spark, [(1, "https://a.example/n/1", one), (2, "https://a.example/n/2", two), (3, "https://a.example/n/3", None), (4, "https://a.example/n/4", ""), (5, "https://b.example/x", layout("404 Not Found", "<p>Страница не найдена</p>"))])
    assert got[1] == {"Школа открыла парк", "Первый абзац, текста.", "И это не всё.", "пункт один;"}
    assert got[2] == {"Мост закрыт", "Дорогу & мост закрыли.", "И это не всё."}
    assert set(got) == {1, 2}
    assert found(spark, []) == {}


def test_copies_are_no_neighbours(spark):
    html = layout("Школа открыла парк", "<p>Первый абзац текста.</p>")
    got = found(spark, [(1, "https://a.example/n/1", html), (2, "https://a.example/n/1", html), (3, "https://a.example/n/2", layout("Мост закрыт", "<p>Дорогу закрыли.</p>"))])
    assert got[1] == got[2] == {"Школа открыла парк", "Первый абзац текста."}


def test_longest_common_subsequence():
    for seed in range(400):
        r = random.Random(seed)
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = mainbody.common_lines(a, b)
        assert len(got) == table[-1][-1] and got == sorted(set(got))


def test_blocks():
    html = "<title>t</title><p>a <b>b</b><br>c<script>x</script><!-- y --><noscript>z</noscript><td>d <a href=x>e</a>&lt;<p>f<p>g"
    assert [b.text for b in blocks_of(html)] == ["a b", "c", "d e<", "f", "g"] and title_of(html) == "t"
    assert blocks_of("") == [] and blocks_of("<p> &nbsp; </p>") == []
    assert len(blocks_of("<div>" * 3000 + "x" * 100_000)) == 1


@pytest.mark.parametrize(
    "html, kind",
    [
        (layout("Школа открыла парк", "<p>Обычный абзац текста о школе.</p>"), ""),
        (layout("404 Not Found", "<p>Страница не найдена</p>"), "message"),
        ("<p>Please enable JavaScript to view this page</p>", "message"),
        ("<h1>ДОСТУП ЗАПРЕЩЁН ДЛЯ ВАШЕГО АДРЕСА.</h1>", "message"),
        (layout("Lorem nullo dolen", "<p>Рыба-текст для показа шаблона, смысла здесь нет.</p><p>тест тест 123</p>"), "message"),
        (layout("{{title}}", "<p>${body}</p>"), "message"),
        (layout("Школа открыла парк", "<p>Город {region_name} получил новый парк у реки.</p>"), "residue"),
        (layout("Школа открыла парк", "<p>Город получил новый парк у реки.</p><p>Здесь будет текст статьи. Замените его позже.</p>"), "residue"),
        (layout("Школа открыла парк", "<p>В шаблоне письма осталось «{{name}}», рассказали в школе, и город смеялся.</p>"), ""),
        (layout("Школа открыла парк", "<p>На уроке объясняли, что запись {{ name }} заменяется значением.</p>"), ""),
        (layout("Школа открыла парк", "<p>Посетителям показывали надпись «страница не найдена», и город починил сайт школы.</p>"), ""),
        (layout("Школа открыла парк", "<p>Доступ запрещён — такую табличку повесили у входа в парк, и администрация осмотрела забор.</p>"), ""),
        (layout("Школа открыла парк", "<p>Обычный абзац.</p><script>var t='{{title}}'</script><noscript>Включите JavaScript</noscript><!-- {{cache}} -->"), ""),
        ("", ""),
        (layout("Школа открыла парк", "<div>Просмотров: 12 NaN</div><p>Обычный абзац текста о школе.</p>"), "residue"),
        (layout("Школа открыла парк", "<div>12.05.2023, 10:00 [object Object]</div><p>Обычный абзац текста о школе.</p>"), "residue"),
        (layout("Школа открыла парк", "<div>12.05.2023, 10:00 null null</div><p>Обычный абзац текста о школе.</p>"), "residue"),
        (layout("Школа открыла парк", "<div>Рубрика: Спорт undefined</div><p>Обычный абзац текста о школе.</p>"), "residue"),
        (layout("Школа открыла парк", "<p>На экране стояло «undefined», сказали в школе.</p>"), ""),
        ("<p>" + "Доступ запрещён для вашего адреса, повторите попытку позже, " * 6 + "ошибка 403.</p>", "message"),
        (layout("Школа открыла парк", "<p>" + "Город получил новый парк у реки, и ошибка 404 появлялась на сайте школы, " * 6 + "сказали там.</p>"), ""),
    ],
)
def test_residue(html, kind):
    assert residue.page_kind(blocks_of(html), title_of(html)) == kind


def test_residue_pages(spark):
    rows = [(1, "u", "u", layout("404 Not Found", "<p>Страница не найдена</p>"), "x"), (2, "u", "u", None, "x"), (3, "u", "u", layout("Парк", "<p>Обычный абзац текста.</p>"), "x"), (1, "u", "u", layout("404 Not Found", "<p>x</p><p>403 Forbidden</p>"), "x")]
    pages = spark.createDataFrame(rows, PAGES)
    assert {r.page_id for r in residue.residue_pages(pages).collect()} == {1}
    assert sorted(r.page_id for r in residue.without_residue(pages).collect()) == [2, 3]
    assert residue.residue_pages(pages.where("false")).count() == 0


def test_prompt_to_share_ends_nothing_that_goes_on(spark):
    html = layout("Школа открыла парк", "<div>Поделиться</div><p>Первый абзац текста.</p><ul><li>отправить копию паспорта</li><li>прийти в школу;</li></ul><p>Город {region_name} рад.</p>")
    other = layout("Мост закрыт", "<p>Дорогу закрыли.</p>")
    # The prompt is deleted because the site's pages share it; a list item that begins like one stays.
    assert found(spark, [(1, "https://a.example/n/1", html), (2, "https://a.example/n/2", other)])[1] == {"Школа открыла парк", "Первый абзац текста.", "отправить копию паспорта", "прийти в школу;", "Город {region_name} рад."}
    assert residue.page_kind(blocks_of(html), title_of(html)) == "residue"


SITE = [("Школа открыла парк", "школе"), ("Мост закрыт", "мосту"), ("Театр ждёт гостей", "театру"), ("Рынок переехал", "рынку")]


def site(k, n_paths=4, own="", host="a"):
    """Page k of a site without telling names: only what pages share tells the article."""
    title, word = SITE[k % 4]
    body = "".join(f"<div>Это абзац {j} статьи {k} по {word}.</div>" for j in range(4))
    html = f"<title>{title} {k}</title><div><div>Сайт города. Все права защищены.</div><div><div>{title} {k}</div>{body}{own}<div>Спасибо всем.</div></div><div><h3>Мнения</h3><div>Мнение читателя {k}.</div></div><div>Пишите нам по адресу редакции.</div></div>"
    return (k, f"https://{host}.example/n/{k % n_paths:03d}", html)


def article(k, own=()):
    title, word = SITE[k % 4]
    return {f"{title} {k}", *(f"Это абзац {j} статьи {k} по {word}." for j in range(4)), *own, "Спасибо всем."}


def test_differencing_decides(spark):
    got = found(spark, [site(k) for k in range(4)])
    # "Спасибо всем." is shared too, but stands between lines of the article.
    assert got == {k: article(k) for k in range(4)}
    alone = found(spark, [site(0)])[0]
    assert {"Мнение читателя 0.", "Пишите нам по адресу редакции.", "Сайт города. Все права защищены."} & alone == set() and article(0) <= alone
    pages = spark.createDataFrame([(i, u, u, h, "x") for i, u, h in (site(k) for k in range(4))], PAGES)
    assert mainbody.main_blocks(pages, neighbours=0).count() >= len(set().union(*got.values()))


@pytest.mark.parametrize("held", [200, 2])
def test_neighbours_across_ranges_and_behind_copies(spark, held, monkeypatch):
    """Many contents of one URL, ranges that hold nothing else, and copies: all have the blocks they have alone."""
    rows = [site(k, 1000) for k in range(4)] + [(100 + k, "https://a.example/n/001", site(1, 1000, f"<div>Номер {k} дня.</div>")[2]) for k in range(40)] + [(200, "https://a.example/n/001", site(1)[2])]
    pages = spark.createDataFrame([(i, u, u, h, "x") for i, u, h in rows], PAGES)
    monkeypatch.setattr(mainbody.DataFrame, "repartitionByRange", lambda self, *c, f=mainbody.DataFrame.repartitionByRange: f(self, 6, *c), raising=False)
    got = {}
    for r in mainbody.main_blocks(pages, held=held).collect():
        got.setdefault(r.page_id, set()).add(r.block)
    assert got.keys() == {i for i, *_ in rows}
    for k in range(40):
        assert got[100 + k] == article(1, (f"Номер {k} дня.",))
    assert got[200] == article(1) and all(got[k] == article(k) for k in range(4))


def test_copies_at_other_paths(spark):
    """An article stored under two paths isn't deleted by its copy."""
    rows = [site(k) for k in range(4)]
    rows.append((9, "https://a.example/n/001a", rows[1][2].replace("Пишите нам", "Звоните нам")))
    got = found(spark, rows)
    assert got[1] == got[9] == article(1)


def test_article_in_nested_elements(spark):
    split = "<title>Школа открыла парк</title><body><div><h1>Школа открыла парк</h1><div class=text><p>Первый абзац текста.</p><p>Город {region_name} рад.</p></div><div><p>Комментарии</p><p>Спасибо за новость!</p></div></div></body>"
    inside = layout("Мост закрыт", "<p>Дорогу закрыли.</p><section><p>Мост {bridge} закрыли.</p></section><p>И это всё.</p>")
    got = found(spark, [(1, "https://a.example/n/1", split), (2, "https://b.example/n/2", inside), (3, "https://b.example/n/3", layout("Театр ждёт", "<p>Гости пришли.</p>"))])
    assert got[1] == {"Школа открыла парк", "Первый абзац текста.", "Город {region_name} рад."}
    assert got[2] == {"Мост закрыт", "Дорогу закрыли.", "Мост {bridge} закрыли.", "И это всё."}
    assert [residue.page_kind(blocks_of(h), title_of(h)) for h in (split, inside)] == ["residue"] * 2
