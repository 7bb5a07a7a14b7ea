import random
import textwrap



from docloom.llm import pages, scans

DOC = "id string, title string, raw_text string, metadata map<string,string>, source_type string, source_url string, line_no int, kind string, summary string"


def doc(id_, text, title=None, meta=None, kind="web", url=None):
    return (id_, title, text, meta, kind, url, 1, "x", None)


def articles(n, seed):
    rng = random.Random(seed)
    nouns, verbs = "crane quay ledger valve pump harbour mast survey notebook sample index shelf".split(), "covers follows limits moves records replaces shows".split()
    out = []
    for i in range(n):
        say = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} of the second {rng.choice(nouns)} in {rng.randint(1900, 2020)}."
        parts = [" ".join(say() for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 7))]
        if rng.random() < 0.5:
            parts.insert(2, "\n".join(f"- {rng.choice(nouns)} {rng.choice(nouns)}" for _ in range(4)))
        if rng.random() < 0.3:
            parts.insert(1, "## Contact")
        out.append((f"{rng.choice(nouns).capitalize()} {rng.choice(nouns)} {i}", "\n\n".join(parts)))
    return out


def test_pages_held_out():
    train = pages.lay_out(articles(60, 1), 500, 1)
    model = pages.PageModel([(pages.Page(t, a, u), y) for t, a, u, y in train])
    # Other articles laid out as pages, then also short texts and ones in words that no page of the training has.
    for mixed, most_lost in ((False, 0.02), (True, 0.05)):
        lost = kept = content = boiler = 0
        for text, title, url, labels in pages.lay_out(articles(40, 2), 120, 2, mixed):
            page = pages.Page(text, title, url)
            assert len(page.at) == len(labels)
            for p, y in zip(model.content(page), labels):
                content += y
                boiler += 1 - y
                lost += y == 1 and p < 0.5
                kept += y == 0 and p >= 0.5
        assert lost / content < most_lost and kept / boiler < 0.05


def test_marginals_are_exact():
    """The messages give what summing over all labellings gives."""
    import itertools

    import numpy as np

    train = pages.lay_out(articles(20, 3), 60, 3)
    model = pages.PageModel([(pages.Page(t, a, u), y) for t, a, u, y in train], rounds=10)
    page = pages.Page("Home | Blog\n\n# Head\n\nThe crane moves the mast of the old quay in 1999 again.\n- one\n- two\n\nPrivacy", "Head", None)
    own = model.evidence(page) - 0.5 * model.prior
    of = dict(zip(page.block, page.section))
    total, marginal = 0.0, np.zeros(len(page.at))
    for top in (0, 1):
        for ss in itertools.product((0, 1), repeat=max(page.section) + 1):
            for bs in itertools.product((0, 1), repeat=max(page.block) + 1):
                base = sum(model.pairs["page"][top, x] for x in ss) + sum(model.pairs["section"][ss[of[b]], x] for b, x in enumerate(bs))
                terms = np.array([[model.pairs["block"][bs[page.block[i]], x] + own[i, x] for x in (0, 1)] for i in range(len(page.at))])
                each = np.logaddexp(terms[:, 0], terms[:, 1])
                w = np.exp(base + each.sum())
                total += w
                marginal += w * np.exp(terms[:, 1] - each)
    assert np.allclose(model.content(page), marginal / total, atol=1e-9)


def test_boilerplate_rows(rows):
    article = articles(30, 5)
    clean = [doc(f"d{i}", b * 3, t, None, "markdown") for i, (t, b) in enumerate(article)]
    title, body = article[0]
    page = f"Home | About us | Contact | Search\n\n# {title}\n\n{body}\n\nAdvertisement\n\n### Most read\n- Other page\n- Third page\n\nPrivacy policy · Imprint · Terms of use\n© 2020 Site. All rights reserved.\r"
    data = clean + [doc("w", page, title, url="https://site.example/a"), doc("w", page, title, url="https://site.example/a"), doc("e", ""), doc("n", None), doc("b", " \n \n"), doc("u", page, None, None, None, "http://x"), doc("r", page, title, None, "repository", "http://x")]
    df = rows(data, DOC)
    got = {}
    for r in pages.boilerplate(df).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    lines = page.split("\n")
    want = {i + 1 for i, x in enumerate(lines) if x.startswith(("Home", "Advert", "### Most", "- Other", "- Third", "Privacy", "©"))}
    assert set(got) == {"w", "u"} and got["w"] == want
    main = {r.id: r.main_text for r in pages.main_text(df).collect()}
    assert main["w"] == f"# {title}\n\n{body}" and main["b"] == "" and set(main) == {"w", "u", "b"}
    assert pages.boilerplate(df.limit(0)).count() == 0


def test_line_model_held_out():
    model = scans.model()
    wrong = furniture = total = 0
    for lines, labels, title in scans.labelled_pages(50, seed=99):
        for a, b in zip(model.label(lines, title), labels):
            wrong += a != b
            total += 1
            furniture += b == scans.HEADER
    assert furniture > 50 and wrong / total < 0.04
    assert model.label([], None) == [] and model.label(["", " "], None) == ["break", "break"]


def scan(i, rng, words):
    text = " ".join(rng.choice(words) for _ in range(160))
    lines = textwrap.wrap(text, 48)
    cut = lines[3].rsplit(" ", 1)
    lines[3], lines[4] = cut[0] + " obser-", "vation " + lines[4]
    lines[6] += " short-"
    lines[7] = "and long-term " + lines[7]
    lines[9] = lines[9].replace("harbour", "barbour") + " s*ction"
    lines = [f"Quay Reports, Vol. {i}", *lines[:10], "", f"- {i} -", f"Quay Reports, Vol. {i}", *lines[10:]]
    return "\n".join(lines), lines


def test_repairs(rows):
    rng = random.Random(4)
    words = "harbour section crane ledger valve observation winter notebook quiet margin record second survey moved".split()
    plain = [doc(f"p{i}", " ".join(rng.choice(words) for _ in range(80)) + ". short and long-term", kind="text") for i in range(60)]
    text, lines = scan(7, rng, words)
    data = plain + [doc("s", text, "Quay", {"page_count": "2"}, "pdf"), doc("s", text, "Quay", {"page_count": "2"}, "pdf"), doc("e", "", meta={"page_count": "1"}), doc("n", None, meta={"page_count": "1"}), doc("b", " \n ", meta={"page_count": "1"}), doc("m", "x", meta=None)]
    df = rows(data, DOC)
    got = {(r.line_no, r.kind) for r in scans.find_repairs(df).collect() if r.id == "s"}
    n = lambda start: next(i for i, x in enumerate(lines, 1) if start in x)
    heads = {(i, "furniture") for i, x in enumerate(lines, 1) if x.startswith(("Quay Reports", "- 7"))}
    assert heads <= got and (n("obser-"), "broken_word") in got and (n("s*ction"), "misread") in got
    assert (n("short-"), "broken_word") not in got and {k for _, k in got} == {"furniture", "broken_word", "misread"}
    back = {r.id: r.repaired for r in scans.repaired(df).collect()}
    assert "observation" in back["s"] and "obser-" not in back["s"] and "Reports" not in back["s"] and "s*ction" not in back["s"] and "short- and" in back["s"]
    assert back["b"] == "" and set(back) == {"s", "b"}
    assert scans.find_repairs(df.limit(0)).count() == 0


def test_copies_of_a_scan_are_one_text(rows):
    rng = random.Random(6)
    words = "harbour section crane ledger valve observation winter notebook quiet margin record second survey moved".split()
    plain = [doc(f"p{i}", " ".join(rng.choice(words) for _ in range(80)), kind="text") for i in range(60)]
    text, lines = scan(7, rng, words)
    # Rows delivered twice, and copies under other ids, some with other line ends.
    copies = [doc(f"c{i}", text.replace("\n", "\r\n") if i % 5 == 0 else text, "Quay", {"page_count": "2"}, "pdf") for i in range(450)]
    df = rows(plain + copies + copies[:100], DOC)
    n = {r.lower: r.n for r in scans.vocabulary(df).collect()}
    assert n["s*ction"] == 1 and n["crane"] <= 61
    line = next(i for i, x in enumerate(lines, 1) if "s*ction" in x)
    got = scans.find_repairs(df).where(f"kind = 'misread' AND line_no = {line}")
    assert {r.id for r in got.collect()} == {f"c{i}" for i in range(450)}


def test_frequent_misread_words_are_decided_by_ratio(rows):
    vocab = rows([("every", 60_000), ("everv", 500), ("crane", 500)], "lower string, n long")
    asked = rows([("everv",), ("every",), ("crane",)], "word string")
    assert [tuple(r) for r in scans.corrections(asked, vocab).collect()] == [("everv", "every")]


def test_word_classes():
    assert scans.looks("rnodern") == scans.looks("modern") and scans.looks("Tab1e") == scans.looks("table") and scans.looks("flle") == scans.looks("file")
    assert scans.looks("crane") != scans.looks("quay")


def test_roman_numerals_and_numbers_of_letters(rows):
    text = "After World War II the yard grew and III came\nThe crane of lO 12 was moved, and Il reste\nThe ledger names 2O11 as the year."
    vocab = [doc(f"p{i}", "The crane moved and the ledger names the yard after World War", kind="text") for i in range(8)]
    df = rows(vocab + [doc("s", text, "Quay", {"page_count": "1"}, "pdf")], DOC)
    fixes = {(r.word, r.fix) for r in scans.found_words(df).where("fix IS NOT NULL").collect()}
    assert fixes == {("lO", "10"), ("2O11", "2011")}


def test_words_of_many_noise_marks(rows):
    vocab = rows([("observation", 60), ("harbour", 50), ("modern", 50), ("quay", 3)], "lower string, n long")
    asked = rows([("o^b~s*erv^ti@n",), ("h^^rb~~ur",), ("~^~^",), ("^~o~*rn",), ("q~^~^*",)], "word string")
    got = {r.word: r.fix for r in scans.corrections(asked, vocab).collect()}
    assert got == {"o^b~s*erv^ti@n": "observation", "h^^rb~~ur": "harbour", "^~o~*rn": "modern"}
    assert scans.could_be("~~o~ern^", scans.looks("modern")) and not scans.could_be("q^^~~", scans.looks("harbour"))


#: Pages written by hand, apart from what training pages are laid out from: title, address, text, lines around the main body.
PAGES = [
("Why cities plant trees","https://www.greenpaper.example/trees","""Greenpaper
Home | News | Science | About | Sign in

We use cookies to improve your browsing experience and to analyze our traffic. Learn more.
Accept all | Manage preferences

# Why cities plant trees

Trees cool the air in summer because water evaporates from their leaves, and the shade keeps the asphalt from heating up.
A single old oak can do more than ten young maples.

Several mayors have promised a million trees. Few have counted how many died.

Watering them is the hard part.

Advertisement

Related articles
- The river that came back
- A roof full of bees

Privacy policy | Terms of use | Contact
© 2024 Greenpaper. All rights reserved.""",{1,2,4,5,16,18,19,20,22,23}),
("Ein Nachmittag im Moor","https://moorblatt.example/a","""Startseite | Aktuelles | Kontakt

# Ein Nachmittag im Moor

Das Moor liegt still.
Wer hier geht, bleibt auf dem Steg.
Unter den Brettern gluckst es.
Im Juni blüht das Wollgras.
Am Abend kommen die Kraniche.

Newsletter abonnieren
Impressum | Datenschutz""",{1,11,12}),
("Утро на рынке","https://gazeta.example/1","""Главная | Новости | Контакты

# Утро на рынке

Торговцы приходят в пять часов.
Они раскладывают яблоки и мёд.
К восьми появляются первые покупатели.
Торгуются громко и весело.
К полудню всё пусто.

Читайте также: Старый мост
Политика конфиденциальности
© 2023 Газета. Все права защищены.""",{1,11,12,13}),
("Consent under the new rules","https://law.example/x","""Law Weekly
Home / Topics / Consent under the new rules

# Consent under the new rules

Consent to cookies must be given freely.
A banner that only offers Accept is not enough.
Users must be able to reject cookies with one click.
The regulator explained this in a short note.
Sites that use tracking for advertising need consent first.
Necessary cookies are exempt.
The first fines are expected in spring.

Share this article
Privacy | Imprint""",{1,2,14,15}),
("Die Post im Gebirge","https://alpenkurier.example/post","""Alpenkurier
Startseite › Kultur › Die Post im Gebirge

# Die Post im Gebirge

Bis in die Sechzigerjahre brachte ein Bote die Briefe zu Fuß auf die Almen, und im Winter nahm er die Skier.
Er ging zweimal in der Woche los, meistens noch vor Sonnenaufgang, und kam am späten Nachmittag zurück.

Viele Höfe hatten damals weder Telefon noch Straße. Der Bote war oft der einzige Besuch.

## Was er mitbrachte

Neben den Briefen trug er Medikamente, Zeitungen und manchmal ein Huhn in seinem Rucksack den Berg hinauf.
Das Huhn überlebte.

Das könnte Sie auch interessieren
* Käse aus Heumilch
* Der letzte Köhler

AGB | Impressum | Datenschutz
© 2022 Alpenkurier GmbH""",{1,2,16,17,18,20,21}),
("Реки под землёй","https://nauka.example/reki","""Главная » Наука » Реки под землёй

# Реки под землёй

Под многими городами текут реки, которые сто лет назад убрали в трубы, чтобы освободить место для улиц и домов.
О них напоминают только названия переулков и сырые подвалы.

В последние годы некоторые из них снова открывают, потому что открытая вода охлаждает воздух и задерживает ливни.
Это стоит дорого.

Популярное
- Кто строил мосты
- Зачем городу деревья

Мы используем файлы cookie, чтобы анализировать посещаемость. Подробнее.
Принять""",{1,11,12,13,15,16}),
("Le retour des loups","https://lagazette.example/loups","""Accueil | Actualités | Contact
# Le retour des loups

Disparus depuis près d’un siècle, les loups sont revenus d’Italie par les crêtes et se sont installés dans les vallées.
Les bergers s’en plaignent. Les naturalistes s’en réjouissent.

Chaque hiver, des agents relèvent les traces dans la neige.
On compte aujourd’hui une centaine de meutes.

Publicité
Abonnez-vous à notre newsletter
Mentions légales | Plan du site""",{1,10,11,12}),
]


def test_pages_written_by_hand():
    """Short running text of other subjects and languages is main body, also where it speaks of cookies or ends in a short line."""
    train = pages.lay_out(articles(60, 1), 1_500, 1)
    model = pages.PageModel([(pages.Page(t, a, u), y) for t, a, u, y in train])
    lost = kept = total = 0
    for title, url, text, around in PAGES:
        page = pages.Page(text, title, url)
        got = {i + 1 for i, p in zip(page.at, model.content(page)) if p < 0.5}
        assert len(got - around) <= 2 and len(around - got) <= 2, (title, got - around, around - got)
        lost, kept, total = lost + len(got - around), kept + len(around - got), total + len(page.at)
    assert lost <= 0.06 * total and kept <= 0.06 * total
