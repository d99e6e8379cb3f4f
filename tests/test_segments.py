"""The sentence cascade: goldens of the plain rule and hand-written cases of each class, in Spark and in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_text import GOLDENS

from veracity.functions.segment import segments
from veracity.plans.oracle import SEGMENTS

#: Sentences; the text is these put together.
CASES = {
    "titles": [["Mr. Smith met Dr. Jones. ", "They spoke."], ["She saw Gen. Lee and Sen. Ann Poe. ", "It rained."], ["Rev. King and St. Paul spoke."],
               ["Prof. Xu, Lt. Col. Ray and Capt. Fo left."]],
    "links": [["Red vs. Blue was close. ", "Blue won."], ["Fruit, e.g. Apples, is good."], ["See cf. Miller for more."], ["Miller et al. Found it."]],
    "references": [["See No. 5 and Fig. 3. ", "Both matter."], ["He was born Jan. 5 in Rome."], ["Read Vol. 2, pp. 10 to 20."], ["He said no. ", "Then he left."],
                   ["Art. 7 applies. ", "Sec. 9 does not."]],
    "suffixes": [["He works at Apple Inc. in Ohio."], ["He works at Apple Inc. ", "He likes it."], ["Nike Inc. Chairman Knight spoke."], ["John Lee Jr. Was here before."],
                 ["He bought pens, ink, etc. ", "Then he wrote."], ["She earned a Ph.D. ", "It took years."], ["Ford Motor Co. Plants closed. ", "Jobs went."],
                 ["They sued Acme Corp. ", "The case failed."]],
    "letters with dots": [["The U.S. Army left. ", "Peace came."], ["He moved to the U.S. ", "He was ten."], ["At 5 p.m. Monday he ate."], ["It was 5 p.m. ", "The shop closed."],
                          ["The U.N. Security Council met."], ["She has an M.D. ", "She is a doctor."], ["Born in Washington D.C. ", "He stayed."]],
    "initials": [["J. K. Rowling wrote it. ", "It sold."], ["George W. Bush won."], ["It was plan B. ", "The end."], ["Michael H. Schneider Sr. is rich."],
                 ["J. R. R. Tolkien and C. S. Lewis met."]],
    "lists": [["1. Mix the flour. ", "2. Bake it. ", "3. Eat."], ["Steps: 1. Mix. ", "2. Bake."], ["It cost 5. ", "Ten were sold."], ["(1) Go home. ", "(2) Sleep."]],
    "ellipses": [["Wait... ", "He left."], ["Well . . . The end came."], ["He was ... tired."], ["Stop… ", "Now go."], ["So... and then."]],
    "names": [["He joined Yahoo! Inc. in May."], ["Yahoo! Japan grew. ", "It is big."], ["Stop! ", "Go now."]],
    "brackets": [["He left (It was late. She slept.) and ran. ", "He fell."], ["It is true [See A. Then see B. Or C.] today."], ["He left. ", "(She stayed.) ", "They met."],
                 ["One (Two. Three. Four. Five. Six.) end."]],
    "quotes": [['He said, "Go. Run now." and left. ', "She hid."], ["“Go. Run. Hide now,” he said. ", "She did."], ['"Who?" ', "He did not know."], ['He asked "Why?" and left.'],
               ['"I came. I saw." ', "He won."]],
    "numbers": [["Pi is 3.14 or so. ", "It never ends."], ["It grew by 5.5 percent. ", "2 of 3 agreed."], ["At 10.30 he left."], ["In 1999. ", "2000 came next."]],
    "white space": [["One.\n", "Two.  \t", "Three."], ["One.Two."], ["lower. case stays"], ["Ends here. "], [" Starts. ", "Here."]],
    "other letters": [["Il est là. ", "Élan arrive."], ["Ü. Müller kam. ", "Er blieb."], ["C'est M. Dupont."]],
    "marks": [["What?! ", "No way."], ["Really?? ", "Yes!!! ", "Good."], ["a\x02b. ", "C\x01d. ", "E\x03."]],
}
TEXTS = [(name, "".join(s), s) for name, cases in CASES.items() for s in cases] + [("goldens", t, s) for t, s in GOLDENS]


@pytest.fixture(scope="module")
def cut(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(TEXTS)] + [(-1, None), (-2, "")], "i int, t string")
    return {r.i: r.s for r in df.select("i", segments(F.col("t")).alias("s")).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)), ids=[f"{n}-{t[:18]}" for n, t, _ in TEXTS])
def test_cases(cut, i):
    assert cut[i] == TEXTS[i][2]


def test_enough_cases():
    assert len(TEXTS) >= 48 + len(GOLDENS)


def test_null_and_empty(cut):
    assert cut[-1] is None and cut[-2] == []


def test_sql_cuts_alike(cut):
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", [(i, t) for i, (_, t, _) in enumerate(TEXTS)])
    got = dict(con.execute(f"SELECT i, {SEGMENTS('t')} FROM texts").fetchall())
    assert got == {i: s for i, s in cut.items() if i >= 0}
