"""Visually identical text with different characters, brought to one form.

1. Compatibility normalization for what doesn't change the look (width, ligatures, radicals, kinds
   of blank), not for raised, circled or fraction figures; canonical decomposition.
2. Deletion of ignorable characters.
3. Each token becomes a lattice: at every letter or sign its look-alikes in all scripts. Viterbi
   finds the path with the best character bigram score, with a price for changing the script.
4. Canonical composition.

The best path is the form, and strings look the same if their forms are equal. A character's
look-alikes are a class, itself included, and classes don't overlap: tokens that look the same have
the same lattice and thus the same best path, and tokens that differ in look have lattices without a
common path. So the scores decide which spelling stands for a look, never whether two looks are one.

NULL stays NULL; an empty string, or one of ignorable characters alone, becomes empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.charlm import CharModel, count_texts
from quire.session import small, written

#: Log-price of a change of script within a token.
SWITCH = -6.0
#: Buckets that the rows of one spelling are dealt to when pairs are made.
SPREAD = 16
#: Looks of several spellings that may be broadcast to choose rows by; more are joined by a shuffle.
MIXED = 200_000

# Characters drawn alike, a class each.
CLASSES = [
    "AАΑᎪ", "BВΒᏴ", "CСϹᏟ", "DᎠ", "EЕΕᎬ", "GᏀ", "HНΗᎻ", "IІΙӀ", "JЈͿᎫ", "KКΚᏦ", "LᏞ", "MМΜᎷ", "NΝ", "OОΟՕ", "PРΡᏢ", "QԚ", "SЅᏚ", "TТΤᎢ", "VѴᏙ", "WԜᎳ", "XХΧ", "YΥҮ", "ZΖᏃ",
    "aаɑα", "cсϲ", "dԁ", "eе", "gɡց", "hһհ", "iіι", "jјϳ", "lӏ", "nո", "oоοօ", "pрρ", "qԛ", "sѕ", "uυս", "vѵν", "wԝ", "xх", "yуү", "ГΓ", "ПΠ", "ФΦ", "кκĸ", "əә", "ӕæ",
    "-‐", "–‒", "’ʼ", ":∶꞉", "/∕⁄", ",‚", "!ǃ", "|ǀ∣", "*∗", "~∼", "·‧⋅", "二ニ", "口ロ", "力カ", "夕タ", "工エ", "八ハ", "卜ト", "一ー",
]
# Compatibility mappings that keep the look, and characters to leave as they are.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
KEEP = "ſ"

_CLASS = {c: k for k, cs in enumerate(CLASSES) for c in cs}
_folded: dict[str, str] = {}


def _fold(c: str) -> str:
    """One character without differences of width, ligature or blank, decomposed; '' if it is invisible."""
    got = _folded.get(c)
    if got is not None:
        return got
    kind = unicodedata.category(c)
    if kind in ("Zs", "Zl", "Zp") or c in "\t\n\r\v\f\x85":
        out = " "
    elif kind in ("Cf", "Cc") or c in "͏ᅟᅠㅤﾠ᠋᠌᠍" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        out = ""
    else:
        d = unicodedata.decomposition(c)
        if not d or c in KEEP:
            out = c
        elif d[0] == "<":
            tag, *codes = d.split()
            parts = [chr(int(x, 16)) for x in codes]
            # spacing accents would lose their look beside a blank
            out = "".join(map(_fold, parts)) if tag in SAME_LOOK and parts[0] != " " or parts == [" "] else c
        else:
            out = "".join(_fold(chr(int(x, 16))) for x in d.split())
    if len(_folded) < 200_000:
        _folded[c] = out
    return out


def fold(s: str) -> str:
    """Step 1 and 2: decomposed, without invisible characters, blanks at the ends removed."""
    if s.isascii():
        out = "".join(map(_fold, s)) if not s.isprintable() else s
    else:
        out = unicodedata.normalize("NFD", "".join(map(_fold, s)))
    return out.strip(" ")


def script_of(c: str) -> str:
    o = ord(c)
    if o < 0x2B0:
        return "L" if c.isalpha() else ""
    if 0x370 <= o <= 0x3FF:
        return "G"
    if 0x400 <= o <= 0x52F:
        return "C"
    if 0x530 <= o <= 0x58F:
        return "A"
    if 0x13A0 <= o <= 0x13FF:
        return "K"
    if 0x3040 <= o <= 0x30FF:
        return "J"
    if 0x3400 <= o <= 0x9FFF:
        return "H"
    return ""


class Form:
    """The consistent form of strings, by bigram scores of one character model."""

    CACHE = 200_000

    def __init__(self, model: CharModel):
        self.model = model
        self.cache: dict[str, str] = {}

    def __call__(self, s: str) -> str:
        return unicodedata.normalize("NFC", " ".join(self.token(t) if t else t for t in fold(s).split(" ")))

    def token(self, t: str) -> str:
        got = self.cache.get(t)
        if got is None:
            got = self.viterbi([CLASSES[_CLASS[c]] if c in _CLASS else c for c in t])
            if len(self.cache) < self.CACHE:
                self.cache[t] = got
        return got

    def viterbi(self, lattice: list[str]) -> str:
        """The best path through the characters that each place may hold."""
        logp = self.model.logp
        # state: (score, last script, character, node before); ties go to the earlier member of a class
        layer = [(0.0, "", " ", None)]
        for place in lattice:
            now = []
            for x in place:
                s = script_of(x)
                best = None
                for node in layer:
                    v = node[0] + logp(node[2], x) + (SWITCH if s and node[1] and s != node[1] else 0.0)
                    if best is None or v > best[0]:
                        best = (v, s or node[1], x, node)
                now.append(best)
            layer = now
        node = max(layer, key=lambda z: z[0])
        out = []
        while node[3] is not None:
            out.append(node[2])
            node = node[3]
        return "".join(reversed(out))


def fit(df: DataFrame, text: str) -> CharModel:
    """Bigram scores of all strings, decomposed as the lattices are."""
    return count_texts(df, text, fold)


_forms: dict[str, Form] = {}


def _form_of(model: CharModel) -> Form:
    if model.mark not in _forms:
        _forms.clear()
        _forms[model.mark] = Form(model)
    return _forms[model.mark]


def add_form(df: DataFrame, model: CharModel, text: str, out: str) -> DataFrame:
    """`df` with the consistent form of the column `text` as `out`."""
    b = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        f = _form_of(b.value)
        return s.map(lambda t: None if t is None else f(t))

    return df.withColumn(out, form(F.col(text)))


def members(forms: DataFrame, by: list[str], key: str = "key", text: str = "text", form: str = "form") -> DataFrame:
    """(by..., form, spelling, class_key, spelling_key, key): the rows whose look has several spellings.

    `class_key` is the smallest key of the look and names its class, `spelling_key` that of the spelling,
    which represents it. Rows of looks with one spelling are absent. NULL texts look like nothing.
    """
    # written, as the forms are used twice and each costs a search
    every = written(forms.where(F.col(text).isNotNull()).select(*by, F.col(form).alias("form"), F.col(text).alias("spelling"), F.col(key).alias("key")), "forms")
    # most looks have one spelling; their rows go before anything is shuffled
    mixed = every.groupBy(*by, "form").agg((F.min("spelling") != F.max("spelling")).alias("mixed")).where("mixed").drop("mixed")
    rows = every.join(small(mixed, MIXED), [*by, "form"], "left_semi").distinct()
    reps = rows.groupBy(*by, "form", "spelling").agg(F.min("key").alias("spelling_key"))
    several = reps.groupBy(*by, "form").agg(F.min("spelling_key").alias("class_key"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(reps.join(several, [*by, "form"]), [*by, "form", "spelling"]).select(*by, "form", "spelling", "class_key", "spelling_key", "key")


def linked(of: DataFrame, by: list[str]) -> DataFrame:
    """(by..., a, b), a < b: each pair of spellings of one look, by the keys that represent them; `of` comes from `members`."""
    reps = of.where("key = spelling_key").select(*by, "form", "spelling", "spelling_key")
    a = reps.select(*by, "form", F.col("spelling").alias("sa"), F.col("spelling_key").alias("a"))
    b = reps.select(*by, "form", F.col("spelling").alias("sb"), F.col("spelling_key").alias("b"))
    return a.join(b, [*by, "form"]).where("sa <> sb AND (a < b OR a = b AND sa < sb)").select(*by, "form", "sa", "sb")


def equal_looking(forms: DataFrame, by: list[str], key: str = "key", text: str = "text", form: str = "form") -> DataFrame:
    """(by..., key_a, key_b), key_a < key_b: rows of different text but one form within equal `by` columns.

    Pairs of spellings, few for any look, are made first and then opened into pairs of rows, one side at
    a time, so no task holds all pairs of a frequent look: the rows of a spelling are dealt to SPREAD
    buckets, and each bucket meets the rows of the other spelling by itself. Rows that differ in
    nothing make no pairs. NULL in a `by` column makes no pairs.
    """
    of = written(members(forms, by, key, text, form), "looks")
    pairs = linked(of, by).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    left = of.select(*by, "form", F.col("spelling").alias("sa"), F.col("key").alias("ka"), F.pmod(F.hash("key"), F.lit(SPREAD)).alias("_deal"))
    right = of.select(*by, "form", F.col("spelling").alias("sb"), F.col("key").alias("kb"))
    opened = pairs.join(left, [*by, "form", "sa", "_deal"]).join(right, [*by, "form", "sb"])
    return opened.where("ka <> kb").select(*by, F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
