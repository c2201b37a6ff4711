from itertools import combinations

from quire.llm import lookalike as L
from quire.llm.charlm import CharModel

TEXTS = ["Common Orchards under Repair", "Тихие чайники до завтрака", "借来的果园", "Nine Hopes"]


def form():
    return L.Form(CharModel([L.fold(t) for t in TEXTS * 5]))


def test_equal_looking_strings_get_one_form():
    f = form()
    same = ["Common Hopes", "Cоmmоn Hоpeѕ", "Ｃommon Hopes", "Common Hopes", "Com​mon Ho­pes", "Cοmmοn Ηopes", "Common Hopes "]
    assert {f(s) for s in same} == {"Common Hopes"}
    assert f("caf́é") != f("café") and f("é") == f("é") and f("ﬁne") == "fine" and f("⽔") == "水" and f("ﾘ") == f("リ")


def test_different_looking_strings_stay_apart():
    f = form()
    texts = ["no. 2", "no. ²", "no. ②", "no. ½", "No. 2", "no. 2!", "nó. 2", "no - 2", "no, 2", "no 2"]
    assert len({f(t) for t in texts}) == len(texts)


def test_all_lookalike_tokens_agree_and_classes_are_apart():
    f = form()
    assert f("СОР") == f("COP") == f("СОΡ")
    seen = "".join(L.CLASSES)
    assert len(seen) == len(set(seen))


def test_script_follows_the_token():
    f = form()
    assert f("чaйники") == "чайники" and f("Rеpair") == "Repair"


def test_idempotent_null_and_empty(spark):
    f = form()
    for t in ["Cоmmon", " ​", "", "借来的　果园"]:
        assert f(f(t)) == f(t)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "​")], "key int, text string")
    assert [r.form for r in L.add_form(df, f.model, "text", "form").orderBy("key").collect()] == [None, "", ""]


def test_pairs_against_brute_force(spark):
    f = form()
    rows = [("x", i, t) for i, t in enumerate(["Hope", "Hоpe", "Hope", "H​ope", "hope", None, "", "​"])] + [("y", 90, "Hоpe"), (None, 91, "Hope"), (None, 92, "Hоpe")]
    rows += rows[:2]
    df = L.add_form(spark.createDataFrame(rows, "site string, key long, text string"), f.model, "text", "form")
    got = {(r.site, r.key_a, r.key_b) for r in L.equal_looking(df, ["site"]).collect()}
    want = {(a[0], *sorted((a[1], b[1]))) for a, b in combinations(set(rows), 2) if a[0] and a[0] == b[0] and a[2] is not None and b[2] is not None and a[2] != b[2] and f(a[2]) == f(b[2])}
    assert got == want and ("x", 0, 1) in got
    assert L.equal_looking(df.limit(0), ["site"]).count() == 0


def test_every_string_is_counted(spark):
    rows = [(f"Ｔitle {i}\U0001f600",) for i in range(21_000)] + [("Πηγή",)] * 3 + [(None,), ("",)]
    df = spark.createDataFrame(rows, "text string").repartition(5)
    m, want = L.fit(df, "text"), CharModel([L.fold(t) for t, in rows if t])
    assert (m.uni, m.bi, m.total) == (want.uni, want.bi, want.total) and m.uni["T"] >= 21_000 and m.bi["Πη"] == 3
    assert L.fit(df.limit(0), "text").uni == CharModel([]).uni


def test_letters_alike_in_ipa_greek_and_armenian():
    f = form()
    for a, b in [("gap", "ɡɑρ"), ("pain", "ραιո"), ("hun", "հսո"), ("gut", "ցυt")]:
        assert f(a) == f(b)


def test_members_and_pairs_of_spellings(spark):
    """Many rows of two spellings: one class, two representatives, one pair of spellings, all pairs of rows."""
    f = form()
    rows = [("x", i, "Hope" if i % 3 else "Hоpe") for i in range(60)] + [("x", 100, "Only")]
    df = L.add_form(spark.createDataFrame(rows, "site string, key long, text string"), f.model, "text", "form")
    of = L.members(df, ["site"])
    got = of.collect()
    assert len(got) == 60 and {r.class_key for r in got} == {0} and {r.spelling_key for r in got} == {0, 1}
    assert L.linked(of, ["site"]).count() == 1
    assert L.equal_looking(df, ["site"]).count() == 20 * 40


def test_two_models_in_one_session(spark):
    """Workers tell models apart, whatever addresses their broadcasts get."""
    df = spark.createDataFrame([(1, "Rеp")], "key long, text string").repartition(1)
    latin, greek = CharModel(["Rep rep"] * 50, seed=""), CharModel(["Ρερ Rεp ер"] * 50 + ["Rер"] * 500, seed="")
    for _ in range(3):
        a = L.add_form(df, latin, "text", "form").first().form
        b = L.add_form(df, greek, "text", "form").first().form
        assert a == L.Form(latin)("Rеp") and b == L.Form(greek)("Rеp") and a != b
