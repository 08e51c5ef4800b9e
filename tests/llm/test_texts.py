"""Problems 7 and 10."""

import random

import numpy as np
import pytest

from wordmill.llm import pii, quality

PROSE = "В субботу город открыл новый парк у реки, и жители пришли на праздник. По словам мэра, работы шли всё лето. "
EXTRA = ["Школа получила новые книги, а библиотека обновила зал для детей.", "Дорогу у моста закрыли на ремонт до осени, сообщили в администрации.", "На концерте выступил хор, и зрители долго не отпускали артистов."]


def prose(seed):
    r = random.Random(seed)
    return " ".join(r.sample(EXTRA, 3)) + f" Всего пришли {r.randrange(90)} человек, из них {r.randrange(40)} — дети."


CASES = {
    "prose": PROSE + prose(1),
    "capitals": (PROSE + prose(2)).upper(),
    "wrapped": "В субботу город открыл новый парк\nу реки, и жители пришли на праздник. По словам\nмэра, работы шли всё лето\nи закончились в срок.",
    "dialogue": "— Когда откроют мост?\n— Осенью, сказали в мэрии.\n— А парк уже открыли.",
    "brief": "Парк открыли",
    "short list": PROSE + prose(3) + "\n" + "хлеб\nмолоко",
    "headlines": "\n".join(f"{a} {b}" for a in ("Школа", "Парк", "Мост", "Театр") for b in ("открыла зал", "ждёт гостей", "закрыли на ремонт")),
    "prices": "\n".join(f"{w} кг ... {k}45 р." for k, w in enumerate(("хлеб", "молоко", "мука", "сахар", "соль", "чай"), 1)),
    "numbers": "\n".join("12.5  889.1  0.44  17.2 " * 3 for _ in range(9)),
    "code": "\n".join(f"var a{k} = document.b{k}('c{k}')[{k}];\n.d{k} {{ margin: {k}px; }}" for k in range(9)),
    "mojibake": (PROSE + prose(4)).encode("cp1251").decode("latin-1"),
    "keywords": "купить недорого окна двери купить окна недорого " * 20,
    "spaced": " ".join(PROSE.replace(" ", "")),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, t, "s", k) for k, t in enumerate(CASES.values())] + [(100 + k, prose(k) + " " + PROSE, "s", 1) for k in range(60)] + [(300, None, "s", 1), (301, "", "s", 1), (302, " \n ", "s", 1), (303, "слово " * 20_000, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")
    words = spark.createDataFrame([(w, "ru", 1) for w in "в и на по у до а из не с о за".split()] + [(None, None, None)], "word string, lang string, ord int")
    return {r.doc_id: r for r in quality.text_quality(docs, words).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_prose_or_not(judged, name):
    r = judged[list(CASES).index(name)]
    assert r.is_prose == (list(CASES).index(name) < 6), (r.profile, r.prose_share)


def test_figures(judged):
    assert all(judged[k].is_prose and judged[k].profile == "empty" and judged[k].n_words == 0 for k in (300, 301, 302))
    assert not judged[303].is_prose and judged[303].n_words == 20_000
    r = judged[4]
    assert (r.n_words, r.mean_word_len, r.n_chars) == (2, 5.5, 11)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.text_quality(docs, spark.createDataFrame([], "word string")).count() == 0


def test_divergence():
    q = np.array([0.5, 0.5, 0.0])
    got = quality.js_divergence(np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]), q)
    assert got[0] == 0 and got[1] == 1 and 0 < got[2] < 1


TEXTS = [
    ("Почта: petrov.ivan@post.example.", [("email", "petrov.ivan@post.example")]),
    ("Пишите ivan [собака] post.example сегодня", [("email", "ivan [собака] post.example")]),
    ("Читатель @nick_92 написал отзыв.", []),
    ("Тел.: +7 (946) 689-62-15, звонить после обеда.", [("phone", "+7 (946) 689-62-15")]),
    ("Запись (8 (43002) 4-41-98) открыта", [("phone", "8 (43002) 4-41-98")]),
    ("Запись (8 948 307 53 91) открыта", [("phone", "8 948 307 53 91")]),
    ("Утерян документ: паспорт серии 5103, номер 130998.", [("id_number", "5103, номер 130998")]),
    ("В заявлении указан СНИЛС 231-027-112-94, и архив", [("id_number", "231-027-112-94")]),
    ("Данные заявителя: личный ИНН: 2050 9035 6010; этап", [("id_number", "2050 9035 6010")]),
    ("Общество «Зоруневы и партнёры», ИНН 8316184088, выиграло", []),
    ("Расчётный счёт фонда 40732404154025672401. Дело № 3-8732/2017 передали.", []),
    ("Кадастровый номер участка 93:08:7392496:031. Артикул 909-58-А065, партия 44120.", []),
    ("Счёт матча 1:3, серия 6-3-0. Показатель вырос с 98 260 до 138 905 рублей.", []),
    ("Приём по адресу: проезд Луговой, 99/5, корп. 3, кв. 75.", [("address", "проезд Луговой, 99/5, корп. 3, кв. 75")]),
    ("Выдача: г. Новочерноград, ул.Дославовая, 26.", [("address", "ул.Дославовая, 26")]),
    ("В доме № 26 по улице Лесной открыли ключ.", [("address", "доме № 26 по улице Лесной")]),
    ("Движение по улице Лесной перекроют до 18:58.", []),
    ("The meeting is held at 85 Serebensk Lane every week.", [("address", "85 Serebensk Lane")]),
    ("Как сообщает Сергей Фёдорович Дубочов, закон принят.", [("name", "Сергей Фёдорович Дубочов")]),
    ("К Светларину Л. К. обратились.", [("name", "Светларину Л. К.")]),
    ("Гостей встречал Совет Ветеранов, завод «Красный Берест».", []),
    ("Победители — ГРАНАРЕВА Нина, Т.Г. Зорский и Черницева Ольга.", [("name", "ГРАНАРЕВА Нина"), ("name", "Т.Г. Зорский"), ("name", "Черницева Ольга")]),
    ("According to Nikita B. Belev, the council agreed.", [("name", "Nikita B. Belev")]),
]


#: Seeds in the contexts and of the forms above: alone, an item without a shape of its own proves nothing.
SUPPORT = [
    t.format(k)
    for k in range(10, 20)
    for t in (
        "Запись (+7 946 689-62-{}) открыта.", "Звоните +7 946 689-62-{} днём.", "Справки по телефону +7 946 689-62-{}.", "Приём по адресу: проезд Луговой, дом {}.", "Выдача: г. Белоград, ул. Лесная, дом {}.",
        "Открыт дом {} по улице Лесной.", "The office is at {} Forest Lane now.", "Пишите post{}@mail.example сегодня.", "В заявлении указан СНИЛС 231-027-112-{}, и архив.", "Утерян документ: паспорт серии 5103 1309{}.",
        "Пришла Нина Сергеевна Дубочова, дом {}.",  # a patronymic tells that the word before is a given name
    )
]


def items(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kind string")
    out = {}
    for r in pii.personal_items(docs).collect():
        out.setdefault(r.doc_id, []).append((r.start_pos, r.kind, texts[r.doc_id][r.start_pos : r.end_pos]))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def test_items(spark):
    got = items(spark, [t for t, _ in TEXTS] + [None, "", "  "] + SUPPORT)
    got = {k: v for k, v in got.items() if k < len(TEXTS) + 3}
    for k, (t, want) in enumerate(TEXTS):
        assert got.get(k, []) == want, t
    assert max(got) < len(TEXTS)


def test_contexts_find_what_shape_leaves_open(spark):
    seeds = [f"Справки по телефону +7 946 689-62-{k:02}." for k in range(10, 40)] + [f"Как сообщает Иван Соколов, день {k}." for k in range(20)]
    open_ = ["Справки по телефону 6-81-14.", "Матч 6-81-14 окончен.", "Как сообщает Виринея Соколова, закон принят.", "Завод купил Виринея Соколова вчера.", "Гостей встречал Дворец Спортов тут."]
    got = items(spark, seeds + open_)
    n = len(seeds)
    assert got[n] == [("phone", "6-81-14")] and n + 1 not in got and got[n + 2] == [("name", "Виринея Соколова")] and n + 4 not in got


def test_withheld_given_names_are_found(spark):
    """Half of the given names unknown: patronymics, initials and contexts discover them."""
    r = random.Random(5)
    given = [n for n in pii.GIVEN_RU.split() if len(n) > 3]
    known = set(r.sample(given, len(given) // 2))
    frames = ["Как сообщает {}, закон принят.", "Благодарность вручили {} за работу.", "Автор снимка {}.", "После обеда {} рассказал о парке.", "Проект, начатый {}, завершён."]
    texts, names = [], []
    for k in range(1500):
        g, surname = r.choice(given), r.choice(["Дубочов", "Светларин", "Белеев", "Крашицин"])
        names.append((g, f"{g.capitalize()} Сергеевич {surname}" if r.random() < 0.3 else f"{g.capitalize()} {surname}"))
        texts.append(r.choice(frames).format(names[-1][1]))
    texts += ["Гостей встречал Дворец Спортов тут.", "Город Новый Краснов ждёт."] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, texts[r.doc_id][r.start_pos : r.end_pos]) for r in pii.personal_items(docs, names=tuple(known)).collect()}
    unknown = [(k, n) for k, (g, n) in enumerate(names) if g not in known]
    assert len(unknown) > 500 and sum(x in found for x in unknown) >= 0.9 * len(unknown)
    assert not any(k >= 1500 for k, _ in found)


def test_what_fits_no_shape_needs_a_sure_context(spark):
    seeds = [f"Справки по телефону +7 946 689-62-{k:02} днём." for k in range(10, 60)]
    got = items(spark, [*seeds, "Справки по телефону 12 345 678 9 днём.", "Выделили 12 345 678 9 рублей.", "Справки 12.05.2023 днём."])
    n = len(seeds)
    assert got[n] == [("phone", "12 345 678 9")] and n + 1 not in got and n + 2 not in got


def test_masking(spark):
    rows = [(1, "Пишите a@b.example или +7 946 689-62-15 😀 Ивану Соколову.", "x"), (2, None, "x"), (3, "чисто", "x"), (4, "", "x")]
    got = {r.doc_id: r.text for r in pii.masked_texts(spark.createDataFrame(rows, "doc_id long, text string, items string")).collect()}
    assert got == {1: "Пишите [EMAIL] или [PHONE] 😀 [NAME].", 2: None, 3: "чисто", 4: ""}
    assert pii.personal_items(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_positions_are_code_points(spark):
    text = "😀😀 a@b.example"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.personal_items(docs).first().start_pos == 3


def test_numbers_next_to_each_other():
    want = {
        "23-45-67\n34-56-78\n45-67-89": ["23-45-67", "34-56-78", "45-67-89"],
        "Приём с 12.05.2023\n8 (343) 212-34-56 каждый день": ["8 (343) 212-34-56"],
        "Телефоны 23-45-67 34-56-78, ждём": ["23-45-67", "34-56-78"],
        "Телефоны 8 (343) 212-34-56. 8 (343) 212-34-57, ждём": ["8 (343) 212-34-56", "8 (343) 212-34-57"],
        "413.42  369.174  7.758  209.4954  820.42  291.51": [],
        "СНИЛС 231-027-112-94 +7 946 689-62-15, архив": ["231-027-112-94", "+7 946 689-62-15"],
    }
    for text, numbers in want.items():
        assert [text[s:e] for _, s, e, form, _ in pii._numbers(text) if form != pii.ANY] == numbers, text
