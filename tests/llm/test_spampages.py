import random

import pytest

from quire.llm import spampages as P

rnd = random.Random(4)
A, B, C = "quiet slow narrow winter copper".split(), "baker porter teacher cook surveyor".split(), "repairs measures keeps sorts carries".split()
KEYS, MODS = ["linen clock", "oak blanket", "copper pan"], ["buy", "cheap", "price", "best", "near me", "free shipping", "coupon"]


def sentence():
    return f"The {rnd.choice(A)} {rnd.choice(B)} {rnd.choice(C)} the {rnd.choice(A)} letter of {rnd.choice(['Ilmby', 'Tenau', 'Pelrick'])} under the stairs, and nobody asked {rnd.choice(B)}s about it."


def prose(n=6):
    return "\n\n".join(" ".join(sentence() for _ in range(4)) for _ in range(n))


def stuffed(n=40):
    return " ".join(f"{rnd.choice(MODS)} {rnd.choice(KEYS)}" for _ in range(n))


def tags(n=40):
    return " ".join("#" + rnd.choice(MODS).replace(" ", "") + rnd.choice(KEYS).replace(" ", "") for _ in range(n))


def link_list(n=20):
    return "\n".join(f"- [{rnd.choice(KEYS)}](https://x{rnd.randrange(999)}.example/a)" for _ in range(n))


def round_up(n=8):
    return "\n".join(f"- [{rnd.choice(KEYS)}](https://x.example/{i}) {sentence()} {sentence()}" for i in range(n))


def products(n=20):
    return "\n".join(f"{rnd.choice(KEYS)} | {rnd.randrange(400)}.99 | {rnd.choice(MODS)}" for _ in range(n))


def recipe():
    return "\n".join(f"- {rnd.randrange(900)} g {rnd.choice(B)}" for _ in range(6)) + "\n\n" + prose(3)


SPAM, FINE = [stuffed, tags, link_list, products], [prose, round_up, recipe]


@pytest.fixture(scope="module")
def model():
    return P.Model([P.features(f()) for _ in range(40) for f in FINE * 4 + SPAM])


def spam(model, text):
    return sum(model.shares(text)[1:]) > 0.5


def test_held_out_pages(model):
    assert all(spam(model, f()) for f in SPAM for _ in range(15))
    assert not any(spam(model, f()) for f in FINE for _ in range(15))


def test_share_counts_characters(model):
    assert spam(model, prose(1) + "\n\n" + stuffed(200)) and not spam(model, prose(8) + "\n\n" + stuffed(20))


def test_code_and_verse_are_fine(model):
    assert not spam(model, "```py\nfor x in y: buy(x)\n```\n\n" + prose(2)) and not spam(model, "\n".join(sentence() for _ in range(12)))


def test_tables(spark, model):
    rows = [(1, prose()), (2, stuffed()), (3, None), (4, ""), (5, " \n "), (6, "…"), (7, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "'x' AS links", "'y' AS spam")
    got = {r.doc_id: r.spam for r in P.page_shares(df, model).collect()}
    assert got[1] is False and got[2] is True and not any(got[i] for i in (3, 4, 5, 6))
    empty = df.limit(0)
    assert P.page_shares(empty, P.fit(empty)).count() == 0
