"""Prompts as string-building column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions.text import strip

# ---- fixed values: instruction texts and prompt frames (must equal the reference's)
SENTENCE_INSTRUCTION = """Task: Given the following sentence, break it into individual, independent facts. Ensure that each statement does not rely on context from other statements. Replace all pronouns (e.g., 'he,' 'she,' 'it,' 'they') with the corresponding nouns or proper names to make the meaning clear without additional context. Do not change anything in the citations. If the sentence is inadequate or doesn't contain any information, answer "No facts to extract". Follow the style of output in example.

Example 1:
Input Sentence: "Michael Collins (October 31, 1930 – April 28, 2021) is a retired American astronaut and test pilot who was the Command Module Pilot for the Apollo 11 mission in 1969."
- Michael Collins was born on October 31, 1930
- Michael Collins died on April 28, 2021
- Michael Collins is a retired American astronaut
- Michael Collins is a retired test pilot
- Michael Collins was the Command Module Pilot for the Apollo 11 mission in 1969

Example 2:
Input sentence: In addition to his acting roles, Bateman has written and directed two short films and is currently in development on his feature debut.
Output:
- Bateman has acting roles.
- Bateman has written two short films.
- Bateman has directed two short films.
- Bateman is currently in development on his feature debut.
"""

GENERATION_INSTRUCTION = """Task: Given the following passage, break it into individual, independent facts. Ensure that each statement does not rely on context from other statements. Replace all pronouns (e.g., 'he,' 'she,' 'it,' 'they') with the corresponding nouns or proper names to make the meaning clear without additional context. Do not change anything in the citations. If the passage is inadequate or doesn't contain any information, answer "No facts to extract". Follow the style of output in example.
Example:
Input passage: "Yuri Gagarin (9 March 1934 – 27 March 1968) was a Soviet pilot and cosmonaut who, aboard the first successful crewed spaceflight, became the first person to journey into outer space. Travelling on Vostok 1, Gagarin completed one orbit of Earth on 12 April 1961, with his flight taking 108 minutes. By achieving this major milestone for the Soviet Union amidst the Space Race, he became an international celebrity and was awarded many medals and titles, including his country's highest distinction: Hero of the Soviet Union."
Output:
- Yuri Gagarin was born on 9 March 1934.
- Yuri Gagarin died on 27 March 1968.
- Yuri Gagarin was a Soviet pilot.
- Yuri Gagarin was a Soviet cosmonaut.
- Yuri Gagarin flew aboard the first successful crewed spaceflight. 
- Yuri Gagarin was the first person to journey into outer space.
- Yuri Gagarin completed one orbit of Earth on 12 April 1961.
- Yuri Gagarin completed one orbit of Earth on 12 April 1961 on Vostok 1.
- Yuri Gagarin's orbit of Earth on 12 April 1961 took 108 minutes.
- Yuri Gagarin’s achievement was a major milestone for the Soviet Union.
- Yuri Gagarin’s spaceflight occurred during the Space Race.
- Yuri Gagarin became an international celebrity after the flight on 12 April 1961.
- Yuri Gagarin was awarded many medals and titles.
- Yuri Gagarin was awarded as Hero of the Soviet Union.
- Hero of the Soviet Union is the country’s highest distinction.

"""

PASSAGE_FRAME = ('Now process the following passage:\nInput passage: "', '"\nOutput\n:')
SENTENCE_FRAME = ('Now process the following sentence:\nInput sentence: "', '"\nOutput\n:')
VERIFY_HEADER = "Task: Answer the question based on the given context.\n\n"
VERIFY_LINE = ("Text: ", "\n")
# the reference has a stray backslash before "Question"; it is dropped here
VERIFY_QUESTION = ('\nQuestion: "', '" True or False? '
                   "Answer True if the information is supported by the context above and False otherwise.\n"
                   "Output: ")
# ---- end of fixed values


def extraction_prompt(generation: Column) -> Column:
    """Prompt asking for the atomic facts of a whole generation."""
    return F.concat(F.lit(GENERATION_INSTRUCTION + PASSAGE_FRAME[0]), generation, F.lit(PASSAGE_FRAME[1]))


def sentence_prompt(sentence: Column) -> Column:
    """Prompt asking for the atomic facts of one sentence."""
    return F.concat(F.lit(SENTENCE_INSTRUCTION + SENTENCE_FRAME[0]), sentence, F.lit(SENTENCE_FRAME[1]))


def verification_prompt(fact: Column, ranked_passages: Column) -> Column:
    """True/False prompt.  ``ranked_passages`` is array<struct<rk, text>>
    (any order); passages are listed by rank, one ``Text:`` line each."""
    lines = F.transform(F.array_sort(ranked_passages),
                        lambda p: F.concat(F.lit(VERIFY_LINE[0]), p["text"], F.lit(VERIFY_LINE[1])))
    return F.concat(F.lit(VERIFY_HEADER), F.array_join(lines, ""),
                    F.lit(VERIFY_QUESTION[0]), strip(fact), F.lit(VERIFY_QUESTION[1]))
