from docloom.llm import encoding as enc

CLEAN = ["Größe", "später", "für", "café", "déjà", "naïve", "señal", "więcej", "łódź", "Москва", "порядок", "всегда", "прежде", "источник", "“draft”", "4…9"]


def wrong(text, read_as, written_in="utf-8"):
    return text.encode(written_in).decode(read_as)


def test_reread_round_trips():
    for word in CLEAN[:11]:
        for codec in ("latin-1", "mac-roman", "cp437", "cp850", "koi8-r"):
            assert enc.reread(wrong(word, codec), codec, "utf-8") == word
    twice = wrong(wrong("“draft”", "latin-1"), "latin-1")
    assert enc.fully(twice, "latin-1") == "“draft”"
    assert enc.reread("Größe", "cp1252", "utf-8") is None and enc.reread("документ", "cp866", "utf-8") is None
    assert enc.reread(wrong("порядок", "cp1252", "cp1251"), "cp1252", "cp1251") == "порядок"
    assert enc.explained("GrÃ¶Ã¶e", "Gröse") == [] and ("cp1252", "utf-8") in enc.explained("GrÃ¶ÃŸe", "Größe")


def corpus():
    texts = [(i, f"Der {CLEAN[i % 16]} und {CLEAN[(i * 7) % 16]} bleibt, {CLEAN[(i * 3) % 16]} auch.") for i in range(160)]
    bad = {
        1000: wrong("Die Größe ist später für alle da.", "cp1252", "utf-8"),
        1001: wrong("Ein café am Hafen", "latin-1"),
        1002: wrong("Die Größe und für später", "mac-roman", "cp1252"),
        1003: "порядок всегда прежде источник".encode("cp1251").decode("latin-1"),
        1004: "Die Gr�ße war l�ngst bekannt",
        1005: "&Atilde;¼berall f&Atilde;¼r alle",
        1006: "ï»¿Ensuite le déjà",
        1007: "Nur ein Wort in der Mitte: spÃ¤ter, sonst nichts.",
    }
    fine = {
        2000: "Readers report sequences such as â€™ in old exports.",
        2001: "The preview shows “Ã©” where “é” was typed, and ‘Ã¼’ for ‘ü’.",
        2002: "Label: ™ ® © ¶ † ‡ — all kept; √(n² + 3) ≈ 4",
        2003: "workspace\n├── sources\n│   └── scans",
        2004: "日本語の要約は21件あります。",
        2005: "Обозначение А59: й, ё и щ сохраняются.",
        2006: None,
        2007: "",
        2008: "plain ASCII &amp; entities &copy; alone",
    }
    return texts, bad, fine


def test_found_and_restored(rows):
    texts, bad, fine = corpus()
    data = texts + list(bad.items()) + list(fine.items()) + [(1000, bad[1000])]
    df = rows([(k, t, "x", 1) for k, t in data], "doc_id long, text string, word string, n int")
    got = {r.doc_id for r in enc.find_garbled(df).collect()}
    assert got == set(bad)
    back = {r.doc_id: (r.restored, r.complete) for r in enc.restore(df.dropDuplicates(["doc_id"])).collect()}
    assert back[1000] == ("Die Größe ist später für alle da.", True) and back[1001][0] == "Ein café am Hafen" and back[1002][0] == "Die Größe und für später"
    assert back[1003][0] == "порядок всегда прежде источник" and back[1005][0] == "überall für alle" and back[1007][0].count("später") == 1
    assert back[1006][0] == "Ensuite le déjà" and "Größe" in back[1004][0] and back[1004][1] is False


def test_copies_are_one_text_and_a_confirmed_pair_holds_for_all_words(rows):
    texts, bad, fine = corpus()
    texts = [(k, f"{t} Blatt {k}") for k, t in texts]
    hot = {3000 + i: bad[1002] for i in range(150)}
    # A word seen nowhere else, in a text whose other words confirm the pair; and one that is right as it stands.
    rare = {4000: "порядок всегда прежде источник рассадка".encode("cp1251").decode("latin-1"), 4001: bad[1002] + ", der Rest fällt", 5000: "Es fällt auf"}
    data = [*texts, *bad.items(), *fine.items(), *hot.items(), *rare.items()]
    df = rows(data, "doc_id long, text string")
    assert {r.doc_id for r in enc.find_garbled(df).collect()} == set(bad) | set(hot) | {4000, 4001}
    back = {r.doc_id: r.restored for r in enc.restore(df).collect()}
    assert {back[k] for k in hot} == {"Die Größe und für später"} and back[4000] == "порядок всегда прежде источник рассадка"
    assert back[4001] == "Die Größe und für später, der Rest fällt"


def test_empty_table_and_long_text(rows):
    s = "doc_id long, text string"
    assert enc.find_garbled(rows([], s)).count() == 0 and enc.restore(rows([], s)).count() == 0
    long_ = "wort " * 200_000 + "spÃ¤ter"
    assert [r.doc_id for r in enc.find_garbled(rows([(1, long_), (2, "später"), (3, "später")], s)).collect()] == [1]


def test_characters_are_aligned():
    assert enc.aligned("GrÃ¶ÃŸe", "Größe") == [("Ã¶", "ö"), ("ÃŸ", "ß")]
    assert enc.aligned("f&Atilde;¼r", "für") == [("Ã¼", "ü")] and enc.aligned("Größe", "Größe") == []
    assert enc.aligned("l�ngst", "längst") == [("�", "ä")] and enc.aligned("dâ€™Ã©t", "d’ét") == []
    assert ("cp1252", "utf-8") in enc.transformations("Ã¶", "ö") and enc.transformations("é", "qu") == ()


def test_without_a_twin_nothing_is_found(rows):
    s = "doc_id long, text string"
    alone = [(1, "sÃ¼ÃŸer Wein"), (2, "nothing else"), (3, "Gr�ße"), (4, "Fluss und Tal")]
    assert enc.find_garbled(rows(alone, s)).count() == 0
    report = {(r.read_as, r.written_in): r for r in enc.transformation_report(rows(alone, s)).collect()}
    assert report["cp1252", "utf-8"].words == 1 and not report["cp1252", "utf-8"].learned and report["lost", "lost"].records == 1
    # One twin teaches the transformation, and it is applied to words that have none.
    taught = [*alone, (5, "spÃ¤ter"), (6, "später"), (7, "später da"), (8, "l�ngst"), (9, "längst"), (10, "längst ja")]
    assert {r.doc_id for r in enc.find_garbled(rows(taught, s)).collect()} == {1, 3, 5, 8}
    report = {(r.read_as, r.written_in): r for r in enc.transformation_report(rows(taught, s)).collect()}
    assert report["cp1252", "utf-8"].learned and report["cp1252", "utf-8"].support == 1 and report["lost", "lost"].learned


def test_a_mark_that_never_stands_alone_is_only_spoken_of(rows):
    s = "doc_id long, text string"
    clean = [(i, f"später – und l’été {i}") for i in range(4)]
    got = enc.find_garbled(rows([*clean, (10, "spÃ¤ter"), (11, "Old exports hold â€™ in places"), (12, "so â€“ it goes"), (13, "lâ€™Ã©tÃ© revient")], s))
    assert {r.doc_id for r in got.collect()} == {10, 12, 13}
