"""Text rules as Spark column expressions (JVM side, inside whole-stage codegen).

Each function maps a string Column to a Column; none of them calls Python per
row.  The same rules are written in DuckDB SQL in ``veracity.plans.oracle``;
the patterns below are shared verbatim so both engines cut text the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _python_space_class() -> str:
    """Regex class of exactly the characters Python's ``str.isspace`` accepts.

    Built from the rule (not listed by hand) so ``strip`` here behaves like
    Python's ``str.strip`` - Spark's ``trim`` only removes blanks.
    """
    cps = [c for c in range(0x110000) if chr(c).isspace()]
    parts, start, prev = [], cps[0], cps[0]
    for c in cps[1:] + [None]:
        if c is not None and c == prev + 1:
            prev = c
            continue
        parts.append(f"\\x{{{start:x}}}" if start == prev
                     else f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
        if c is not None:
            start = prev = c
    return "[" + "".join(parts) + "]"


SPACE = _python_space_class()
STRIP_PATTERN = f"\\A{SPACE}+|{SPACE}+\\z"

# ---- fixed values: sentence rule (must stay equal in Spark and the SQL oracle)
# Abbreviations whose trailing dot does not end a sentence, then a single capital.
ABBREVIATION_PATTERN = (
    r"\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Inc|Ltd|Co|vs|etc|e\.g|i\.e|Ph\.D|U\.S|U\.S\.A|[A-Z])\."
)
# End mark, optional closing quote/bracket, white space, then a sentence start.
# The white space stays with the sentence before the break (trailing blanks kept).
BREAK_PATTERN = r"([.!?][\"')\]]?)(\s+)([A-Z\x{c0}-\x{dd}0-9\"'])"
FACT_BULLET = "- "
BLANK_LINE_TAIL = "(?s)\n\n.*"
# ---- end of fixed values
TITLE_PATTERN = r"^(?:[^\s.,]{1,3} [^\s.,]+|[^\s.,]*)"
AROUND_WORD = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


# Markers that stand in the text while it is cut.  A text that holds one of them
# or ESCAPE itself has it written as ESCAPE and a second control character, which
# the sentence rule takes no notice of, and gets it back afterwards.
BREAK = "\u0001"     # a sentence break
PROTECT = "\u0002"   # a dot that ends no sentence
ESCAPE = "\u0003"
ESCAPED = {ESCAPE: ESCAPE + "\u0004", BREAK: ESCAPE + "\u0005", PROTECT: ESCAPE + "\u0006"}


def _escape(c: Column) -> Column:
    for mark, code in ESCAPED.items():
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def _unescape(c: Column) -> Column:
    for mark, code in reversed(ESCAPED.items()):
        c = F.replace(c, F.lit(code), F.lit(mark))
    return c


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def paragraphs(c: Column) -> Column:
    """Split on newline, strip each line, drop blank ones -> array<string>."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """P5: English sentence segmentation -> array<string>.

    Trailing white space stays on each sentence, like the reference's
    segmenter with ``clean=False``.  Empty pieces are dropped.
    """
    def cut(text: Column) -> Column:
        protected = F.regexp_replace(text, ABBREVIATION_PATTERN, "$1" + PROTECT)
        marked = F.regexp_replace(protected, BREAK_PATTERN, "$1$2" + BREAK + "$3")
        return F.filter(F.split(F.translate(marked, PROTECT, "."), BREAK), lambda x: x != "")

    return F.when(c.rlike(f"[{BREAK}-{ESCAPE}]"), F.transform(cut(_escape(c)), _unescape)).otherwise(cut(c))


def parse_facts(c: Column) -> Column:
    """A model's ``- `` bullet list -> array<string> of facts.

    Everything before the first bullet is dropped; ``- `` cuts anywhere, also
    inside a fact (``1939 - 1945`` gives two pieces).  Each piece is stripped
    and loses everything from its first blank line on.  Empty pieces are
    dropped (the reference fails the generation there), then the last fact is
    closed with a ``.`` when it lacks one.  A NULL response gives NULL.
    """
    pieces = F.split(c, FACT_BULLET)
    body = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))
    cleaned = F.transform(
        body, lambda x: strip(F.regexp_replace(strip(x), BLANK_LINE_TAIL, "")))
    facts = F.filter(cleaned, lambda x: x != "")
    # only the last fact is closed with a dot; written with top-level slices so
    # the parsed array is evaluated once (a size() inside the lambda would
    # re-run the whole parse for every element)
    last = F.element_at(facts, -1)
    closed = F.when(last.endswith("."), last).otherwise(F.concat(last, F.lit(".")))
    return F.when(F.size(facts) == 0, facts).otherwise(
        F.concat(F.slice(facts, 1, F.size(facts) - 1), F.array(closed)))


def render_bullets(sentences_col: Column) -> Column:
    """M7 offline extractor: sentences rendered as a ``- `` list, one per line."""
    return F.array_join(
        F.transform(sentences_col, lambda s: F.concat(F.lit(FACT_BULLET), strip(s))), "\n")


def tokens(c: Column) -> Column:
    """Split on single blanks, case kept, empty tokens kept."""
    return F.split(c, " ")


def title_of(text: Column) -> Column:
    """Title of a document that comes without one: its leading word, and the next
    one too if the first has at most three letters; words end at white space, ``.`` and ``,``."""
    return F.regexp_extract(text, TITLE_PATTERN, 0)


def words(c: Column) -> Column:
    """Blank-separated words without the punctuation around them; empty ones are dropped -> array<string>."""
    return F.filter(F.transform(tokens(c), lambda t: F.regexp_replace(t, AROUND_WORD, "")), lambda t: t != "")


def starts_upper(c: Column) -> Column:
    """The first character is an upper-case letter."""
    first = F.substring(c, 1, 1)
    return first != F.lower(first)
