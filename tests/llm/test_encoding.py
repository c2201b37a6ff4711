import pytest

from quire.llm import encoding as E
from quire.llm.charlm import CharModel, count_texts, sample_texts

CLEAN = [
    "Der Kräuterhof prüft die Liste der Gezeiten während der trockenen Wochen, über mehrere Abende.", "Le métier étroit réécrit la plus vieille note à côté du poêle, après un long débat.",
    "El pequeño taller señala la máquina ruidosa después de una larga discusión, según el año.", "Школа на холме забывает медленный рецепт, и речной архив находит таблицу приливов.",
    "安静的读者打开了旧信，我们在图书馆里写下第一个故事。", "古い手紙を読みました。図書館の人は静かな町を歩いています。", "It’s the café’s façade — “quite” naïve.",
]


@pytest.fixture(scope="module")
def lab():
    return E.Labeller(CharModel(CLEAN * 40))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_clean(lab, text):
    assert not lab.garbled(text) and lab.repair(text) == (text, [])


@pytest.mark.parametrize("written,read,i", [("utf-8", "cp1252", 0), ("utf-8", "cp1252", 1), ("utf-8", "iso-8859-1", 2), ("utf-8", "cp1251", 0), ("utf-8", "koi8-r", 3), ("koi8-r", "cp1251", 3), ("cp1251", "koi8-r", 3), ("cp1251", "iso-8859-1", 3), ("gb18030", "iso-8859-1", 4), ("utf-8", "gb18030", 0)])
def test_round_trip(lab, written, read, i):
    garbled = CLEAN[i].encode(written).decode(read)
    assert lab.garbled(garbled)
    assert lab.repair(garbled)[0] == CLEAN[i]


def test_only_the_garbled_part_changes(lab):
    bad = "Kräuterhof".encode().decode("cp1252")
    assert lab.repair(f"Der {bad} prüft die Körner")[0] == "Der Kräuterhof prüft die Körner"


@pytest.mark.parametrize("a,b", [("cp1252", "cp1252"), ("cp437", "iso-8859-1"), ("iso-8859-1", "gb18030")])
def test_twice_garbled(lab, a, b):
    t = "prüft während".encode().decode(a).encode().decode(b)
    assert lab.repair(t)[0] == "prüft während"


def test_twice_garbled_by_different_writings(lab):
    t = CLEAN[3]
    bad = t.encode("cp1251").decode("cp1252").encode().decode("gb18030")
    assert lab.repair(bad)[0] == t


def test_unusual_accents_are_clean(lab):
    assert not lab.garbled("Copper Ferrieš at the Façade") and not lab.garbled("Ferrieš")


def test_lost_bytes_are_found_and_read_again(lab):
    raw = CLEAN[3].encode("cp1251")
    text = raw.decode("utf-8", "replace")
    assert lab.garbled(text)
    assert lab.read(raw, text, ["loss"]) == CLEAN[3]


@pytest.mark.parametrize("head", ["", "© "])
def test_bytes_are_read_by_the_whole_page(lab, head):
    page = head + "plain words " * 2000 + CLEAN[1] * 3
    raw = page.encode("cp1252")
    assert lab.read(raw, raw.decode("utf-8", "replace"), ["loss"]) == page


def test_correct_references_and_capitals_are_clean(lab):
    for t in ["caf&eacute; &#233; &#x4e2d; &amp; &lt;", "PROMOÇÃO", "RÈGLES ÉCRITES", "5 €", "&unknown;"]:
        assert not lab.garbled(t)


def test_garbled_references_are_restored(lab):
    t = "It&#226;&#128;&#153;s the caf&Atilde;&copy; &amp; caf&eacute;"
    assert lab.repair(t)[0] == "It’s the café &amp; caf&eacute;"
    shown, at = E.unreferenced("a&#233;b &amp; &eacute;")
    assert shown == "aéb &amp; é" and [at[i] for i in (0, 1, 2, len(shown))] == [0, 1, 7, 23]


def test_holes_are_filled(lab):
    t = "Старый дом стоит у реки, и читатель открывает письмо."
    raw = t.encode()
    bad = "".join("?" if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in raw)
    assert "?" in bad and E.Labeller(CharModel([*CLEAN, t] * 40)).repair(bad)[0] == t
    assert not lab.garbled("Где? Ñandú? À? «été?»")


@pytest.mark.parametrize("written,read", [("utf-8", "iso-8859-1"), ("gb18030", "cp1251")])
def test_stretches_longer_than_what_is_settled_at_once(lab, written, read):
    """One stretch without blanks, put out in parts; its context is never cut."""
    t = CLEAN[4] * 250
    bad = t.encode(written).decode(read)
    assert len(bad) > 2 * E.SETTLE and lab.repair(bad)[0] == t


def test_a_page_of_100_000_characters(lab):
    """Every place counts, the last as the first."""
    head = "plain words and more of them, line by line.\n" * 2400
    assert len(head) > 100_000 and not lab.garbled(head + "café")
    bad = head + "It’s the café’s façade".encode().decode("cp1252")
    assert lab.garbled(bad) and lab.repair(bad)[0] == head + "It’s the café’s façade"


def test_twice_garbled_has_no_limit_of_length(lab):
    """A stretch without blanks, of any length, may be garbled twice."""
    t = "ж".join(["хлеб"] * 60)
    bad = t.encode().decode("iso-8859-1").encode().decode("iso-8859-1")
    assert E.Labeller(CharModel([t] * 50)).repair(bad)[0] == t


def test_bytes_are_evidence():
    assert E.evidence("cafÃ©", "café".encode(), "text/html; charset=ISO-8859-1") == {"utf-8>cp1252", "utf-8>iso-8859-1"}
    assert E.evidence("café", "café".encode(), "text/html") == frozenset() == E.evidence("cafÃ©", None, None)
    assert len(E.evidence("cafÃ©", "café".encode(), "text/html; charset=nonsense")) > 5


def test_very_long_text(lab):
    t = "安静的读者" * 40_000
    assert not lab.garbled(t)


def test_tables(spark, lab):
    rows = [(1, "café"), (1, "café"), (2, "caf" + "é".encode().decode("cp1252")), (3, None), (4, ""), (5, "plain"), (6, "�")]
    df = spark.createDataFrame(rows, "fetch_id int, text string").selectExpr("*", "encode(text, 'UTF-8') AS content", "1 AS restored", "2 AS pairs")
    assert {r.fetch_id for r in E.find_garbled(df, lab.model).collect()} == {2, 6}
    got = {r.fetch_id: r.restored for r in E.repair(df, lab.model).collect()}
    assert got[1] == got[2] == "café" and got[3] is None and got[4] == ""
    assert E.repair(df, lab.model, content=None).count() == len(rows)
    empty = df.limit(0)
    assert sample_texts(empty, "fetch_id", "text") == [] and E.find_garbled(empty, E.fit(empty, "fetch_id", "text")).count() == 0


def test_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id AS STRING) AS t")
    s = sample_texts(df, "id", "t", 100)
    assert len(s) == 100 and s == sample_texts(df.repartition(7), "id", "t", 100)


def test_every_row_of_clean_text_counts(spark):
    """Characters that one row of thousands has are known, at their rates over all rows."""
    df = spark.createDataFrame([(i, chr(0x4E00 + i) + " plain") for i in range(4000)], "id int, t string")
    m = E.fit(df, "id", "t")
    assert all(m.uni[chr(0x4E00 + i)] >= 1 for i in range(4000)) and m.bi["pl"] >= 4000


def test_weighed_counts_leave_the_seed_its_say(spark):
    """Marks that only the seed has stay clean text, however much text is counted; rates are those of all rows."""
    df = spark.range(2000).selectExpr("id", "repeat('der ', 250) AS t")
    all_, w, seed = count_texts(df, "t"), count_texts(df, "t", weight=1000), CharModel([])
    assert w.uni["’"] == seed.uni["’"] == all_.uni["’"] and abs(w.total - seed.total - 1000) < 1e-6
    assert abs((w.uni["d"] - seed.uni["d"]) - 250) < 1 and all_.uni["d"] == seed.uni["d"] + 500_000
    assert w.logp("r", "’") - all_.logp("r", "’") > 10
    assert w.prior("\u4e01") == CharModel.HAN


def test_characters_seen_less_than_once_by_weight(spark):
    """A seen character is no less likely than one never seen."""
    df = spark.range(1000).selectExpr("id", "concat(IF(id = 7, '龍 ЖЩ', ''), repeat('der жщ ', 100)) AS t")
    m = count_texts(df, "t", weight=1000)
    assert 0 < m.uni["龍"] < 1 and m.prior("龍") >= m.prior("龘")
    assert m.bi["ЖЩ"] < 1 and m.logp("Ж", "Щ") > m.logp("Ж", "Ы")


def test_counting_in_arrays():
    texts = ["", " a  b\t\n1 23", "  x", "é\r\n", "", "\x00\U0001f600\U0001f600 ", " ", "7", *CLEAN]
    one, all_ = CharModel(texts, seed=""), CharModel([], seed="")
    all_.add_all(texts)
    all_.add_all([""])
    all_.add_all([])
    assert all_.uni == one.uni and all_.bi == one.bi
