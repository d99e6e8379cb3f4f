"""Sentence segmentation by a cascade of rules (P5), the fuller rule beside ``text.sentences``.

Every end mark that white space and a possible sentence start follow gets a
break first.  Passes over the text then take breaks away again, class by class: abbreviations that
never end a sentence, those that may, initials, references, list items,
ellipses, names with marks, and what stands in brackets or quotes.  An abbreviation that may
end a sentence does so where a word follows that sentences often begin with.

Each pass is one regular expression without look-around, so that Spark and
DuckDB run the same cascade; nothing calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions.text import BREAK, ESCAPE, _escape, _unescape

# ---- fixed values: word classes of the cascade
#: Never the last word of a sentence.
TITLES = "Mr|Mrs|Ms|Messrs|Mme|Mlle|Dr|Drs|Prof|St|Ste|Gen|Col|Maj|Capt|Cmdr|Lt|Sgt|Cpl|Pvt|Adm|Rev|Fr|Hon|Pres|Gov|Sen|Rep|Amb|Msgr"
LINKS = r"vs|cf|e\.g|i\.e|viz|approx|ca|esp|incl|al"
#: Not the last word where a number follows.
REFERENCES = "No|Nos|no|nos|Fig|Figs|fig|figs|Eq|Eqs|Vol|Vols|vol|Ch|ch|Sec|sec|Art|art|pp|p|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec|b|d|c"
#: May be the last word.
SUFFIXES = r"Inc|Ltd|Co|Corp|Bros|Jr|Sr|Esq|etc|Ave|Blvd|Rd|Mt|Ft|Dept|Univ|Assn|Ph\.D|Ed\.D|Est|Gmbh|Cie"
#: Words that sentences often begin with.
STARTERS = ("The|A|An|He|She|It|They|We|I|You|This|That|These|Those|His|Her|Its|Their|Our|My|Your|In|On|At|But|And|Or|However|After|Before|When|"
            "While|Although|Though|As|For|If|There|Then|Since|During|By|With|From|Later|Also|To|So|What|Who|How|Why|Where|Not|No|Yes|All|Some|Many|Most|Both|Each|Once|Until|Today")
#: Names that end in a mark.
NAMES = "Yahoo!|Jeopardy!|Yum!|Guess\\?|Which\\?|Oklahoma!"
# ---- end of fixed values

_S = "[ \t\n\r\f]"
_B = r"\x01"
_EDGE = "(^|[ \t\n\r\f(\\[\"'\\x{201c}\\x{2018}\\x{ab}\\x01])"
_OPEN = "[\"'(\\[\\x{201c}\\x{2018}\\x{ab}]*"
_CLOSE = "[\"')\\]\\x{201d}\\x{2019}\\x{bb}]*"
_UPPER = "A-Z\\x{c0}-\\x{d6}\\x{d8}-\\x{de}"


def _may_end(word: str) -> list[tuple[str, str]]:
    """Breaks after the word go, but for those before a starter: they are written twice first."""
    return [(f"{_EDGE}({word})([.]{_S}+){_B}((?:{STARTERS})[ ,'\n])", rf"\1\2\3{BREAK}{BREAK}\4"),
            (f"{_EDGE}({word})([.]{_S}+){_B}([^{_B}])", r"\1\2\3\4")]


#: (pattern, replacement) in order; a break is U+0001.
CASCADE: list[tuple[str, str]] = [
    # end marks before a start; white space stays with the sentence before
    (f"([.!?\\x{{2026}}]{_CLOSE})({_S}+)({_OPEN}[{_UPPER}0-9])", rf"\1\2{BREAK}\3"),
    # words that never end a sentence, two rounds as they follow each other
    *[(f"{_EDGE}({TITLES}|{LINKS})([.]{_S}+){_B}", r"\1\2\3")] * 2,
    # numbers of things
    (f"{_EDGE}({REFERENCES})([.]{_S}+){_B}([0-9])", r"\1\2\3\4"),
    # words that may end a sentence; letters with dots between them; initials, two rounds as they follow each other
    *_may_end(SUFFIXES),
    *_may_end("(?:[A-Za-z][.])+[A-Za-z]"),
    *_may_end(f"[{_UPPER}]") * 2,
    # numbers of a list stay with their item
    (f"(^|{_B}|[:;]{_S}|\n)(\\(?[0-9]{{1,3}}[.)]{_S}+){_B}", r"\1\2"),
    # dots with blanks between them are no end
    (f"([.]{_S}[.]{_S}[.]{_S}+){_B}", r"\1"),
    (f"{_EDGE}({NAMES})({_S}+){_B}", r"\1\2\3"),
    # one sentence as long as a bracket or a quotation is open: up to four breaks in each
    *[(f"(\\([^()]*){_B}+([^()]*\\))", r"\1\2")] * 4,
    *[(f"(\\[[^\\[\\]]*){_B}+([^\\[\\]]*\\])", r"\1\2")] * 4,
    *[(f"(\\x{{201c}}[^\\x{{201c}}\\x{{201d}}]*){_B}+([^\\x{{201c}}\\x{{201d}}]*\\x{{201d}})", r"\1\2")] * 4,
    *[(f"((?:^|[ \t\n(\\x01])\"[^\"{_B} ][^\"{_B}]*){_B}+([^\"]*[^\" (]\")", r"\1\2")] * 4,
    (f"{_B}+", BREAK),
]


def segments(c: Column) -> Column:
    """P5: sentences of English text by the cascade -> array<string>; white
    space stays at each sentence's end, null gives null and an empty text no sentence."""
    def cut(text: Column) -> Column:
        for pattern, new in CASCADE:
            text = F.regexp_replace(text, pattern, "".join(f"${x[1]}" + x[2:] if x[:1] == "\\" else x for x in _parts(new)))
        return F.filter(F.split(text, BREAK), lambda x: x != "")

    return F.when(c.rlike(f"[{BREAK}-{ESCAPE}]"), F.transform(cut(_escape(c)), _unescape)).otherwise(cut(c))


def _parts(new: str) -> list[str]:
    """A replacement cut before each group reference."""
    out, at = [], 0
    for i in range(1, len(new) + 1):
        if i == len(new) or new[i] == "\\":
            out.append(new[at:i])
            at = i
    return out
