"""Text rules: sentence goldens, fact parsing, answers, rounding."""

import pytest
from pyspark.sql import functions as F

from veracity.functions import answers as A
from veracity.functions import text as T

# ---- fixed values: sentence goldens
GOLDENS = [
    ('When a child asks her mother, "Where do babies come from?", the mother said, "Well, when two people '
     'love each other very much, they decide they want to have a baby.',
     ['When a child asks her mother, "Where do babies come from?", the mother said, "Well, when two people '
      'love each other very much, they decide they want to have a baby.']),
    ("Elon Musk was born in South Africa. He founded SpaceX in 2002.",
     ["Elon Musk was born in South Africa. ", "He founded SpaceX in 2002."]),
    ("One partner in the business cannot act unilaterally e.g. over investments, holidays, contracts to accept, etc.",
     ["One partner in the business cannot act unilaterally e.g. over investments, holidays, contracts to accept, etc."]),
    ("Mr. John Johnson Jr. was born in the U.S.A but earned his Ph.D. in Israel before joining Nike Inc. as an "
     "engineer. He also worked at craigslist.org as a business analyst.",
     ["Mr. John Johnson Jr. was born in the U.S.A but earned his Ph.D. in Israel before joining Nike Inc. as an "
      "engineer. ", "He also worked at craigslist.org as a business analyst."]),
    ("Thierry Henry (born 17 August 1977) is a French professional football coach, pundit, and former player. "
     "He is considered one of the greatest strikers of all time, and one the greatest players of the Premier "
     "League history. He has been named Arsenal F.C's greatest ever player. Henry made his professional debut "
     "with Monaco in 1994 before signing for defending Serie A champions Juventus. However, limited playing "
     "time, coupled with disagreements with the club's hierarchy, led to him signing for Premier League club "
     "Arsenal for £11 million in 1999.",
     ["Thierry Henry (born 17 August 1977) is a French professional football coach, pundit, and former player. ",
      "He is considered one of the greatest strikers of all time, and one the greatest players of the Premier "
      "League history. ",
      "He has been named Arsenal F.C's greatest ever player. ",
      "Henry made his professional debut with Monaco in 1994 before signing for defending Serie A champions Juventus. ",
      "However, limited playing time, coupled with disagreements with the club's hierarchy, led to him signing "
      "for Premier League club Arsenal for £11 million in 1999."]),
    ("The U.S. Drug Enforcement Administration (DEA) says hello. And have a nice day.",
     ["The U.S. Drug Enforcement Administration (DEA) says hello. ", "And have a nice day."]),
    ("Michael H. Schneider Sr. is a highly successful entrepreneur and business executive with over 35 years of "
     "experience in the areas of business strategy, operations, finance, and management. He made his acting "
     "debut in the film The Moon is the Sun's Dream (1992), and continued to appear in small and supporting "
     "roles throughout the 1990s.",
     ["Michael H. Schneider Sr. is a highly successful entrepreneur and business executive with over 35 years of "
      "experience in the areas of business strategy, operations, finance, and management. ",
      "He made his acting debut in the film The Moon is the Sun's Dream (1992), and continued to appear in small "
      "and supporting roles throughout the 1990s."]),
    ("have a nice day. 5.5 is a number and/ 6.6 is a number",
     ["have a nice day. ", "5.5 is a number and/ 6.6 is a number"]),
]
# ---- end of fixed values


def _one(spark, expr, values, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_sentence_goldens(spark):
    got = _one(spark, T.sentences, [a for a, _ in GOLDENS])
    for (_, expected), g in zip(GOLDENS, got):
        assert g == expected


@pytest.mark.parametrize("text,facts", [
    ("no bullet", []),
    ("- one", ["one."]),
    ("- a (1939 - 1945)", ["a (1939", "1945)."]),
    ("- first\n\nSome note after a blank line - second", ["first", "second."]),
    ("- x\n\nnotes", ["x."]),
    ("- - x", ["x."]),
    ("- x\n- ", ["x."]),
    ("- \n- x", ["x."]),
    ("- a.\n- b", ["a.", "b."]),
    ("- a \n- b.", ["a", "b."]),
])
def test_parse_facts(spark, text, facts):
    assert _one(spark, T.parse_facts, [text]) == [facts]


def test_parse_facts_null(spark):
    assert _one(spark, T.parse_facts, [None]) == [None]


def test_strip_is_python_strip(spark):
    values = [" a ", " b ", "\x1cc\x1f", "\t\nd e\r\n", "", "   "]
    assert _one(spark, T.strip, values) == [v.strip() for v in values]


def test_paragraphs_and_tokens(spark):
    assert _one(spark, T.paragraphs, ["a\n\n  b \n \nc"]) == [["a", "b", "c"]]
    assert _one(spark, T.tokens, ["a  b "]) == [["a", "", "b", ""]]


@pytest.mark.parametrize("answer,decision", [
    ("True", True), ("False.", False), ("TRUE or FALSE", False), ("untrue", True),
    ("cannot say", None), (None, None), ("true, not false", False),
])
def test_parse_answer(spark, answer, decision):
    assert _one(spark, A.parse_answer, [answer]) == [decision]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(1, 32)], "a int, b int")
    r = df.select(F.bround(F.col("a") / F.col("b"), 4).alias("x")).first()
    assert r.x == 0.0312


def test_titles_and_words(spark):
    assert _one(spark, T.title_of, ["Abcd, def", "Wxyz.z", " lead", "La éa x", "La, éa", "Of. b", "Then b"]) == [
        "Abcd", "Wxyz", "", "La éa", "La", "Of", "Then"]
    assert _one(spark, T.words, ["Élan, (abc) -- d.e's!", "", " "]) == [["Élan", "abc", "d.e's"], [], []]
    assert _one(spark, T.starts_upper, ["Élan", "abc", "1", ""]) == [True, False, False, False]

def python_parse(text):
    """The fact-list rule in plain Python (empty pieces dropped, last fact closed)."""
    import re
    pieces = text.split("- ")[1:]
    facts = [re.sub(r"\n\n.*", "", p.strip(), flags=re.DOTALL).strip() for p in pieces]
    facts = [f for f in facts if f]
    if facts and not facts[-1].endswith("."):
        facts[-1] += "."
    return facts


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_alphabet = st.sampled_from(["- ", "-", " ", "\n", "\n\n", "a", "b.", "1939", " ", "x y", "."])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(_alphabet, max_size=12).map("".join), min_size=1, max_size=20))
def test_parse_facts_property(spark, texts):
    assert _one(spark, T.parse_facts, texts) == [python_parse(t) for t in texts]
