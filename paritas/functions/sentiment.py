"""Sentiment of a text by a lexicon of valences, with the usual rules for the words around a valued one.

A valence is raised or lowered by words of degree up to three places before it, turned by a negation there, raised by
capitals where the text has other cases too, and weighed down before and up after a "but"; marks of exclamation and
question add emphasis to the sum. The lexicon is given: a dict of words in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published constants of the rules.
DEGREE, CAPITALS, NEGATION, EXCLAMATION, QUESTION, QUESTIONS, NORMAL = 0.293, 0.733, -0.74, 0.292, 0.18, 0.96, 15
NEARNESS, BEFORE_BUT, AFTER_BUT = (1.0, 0.95, 0.9), 0.5, 1.5

#: Words of degree, up and down, and negations besides words that end in "n't".
UP = frozenset("absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fully greatly highly hugely incredibly intensely more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split())
DOWN = frozenset("almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split())
NOT = frozenset("aint cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt neither never no nobody none nope nor not nothing nowhere rarely seldom shouldnt wasnt werent without wont wouldnt despite".split())

_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _words(text: str) -> list[str]:
    """Between white space, without marks at their ends; what would be left with two characters or fewer stays whole."""
    return [bare if len(bare := token.strip(_EDGES)) > 2 or bare.isalpha() else token for token in text.split()]


def _emphasis(text: str) -> float:
    asked = text.count("?")
    return min(text.count("!"), 4) * EXCLAMATION + (0.0 if asked < 2 else QUESTION * asked if asked <= 3 else QUESTIONS)


def valences(words: list[str], lexicon: Mapping[str, float]) -> list[float]:
    """The valence of each word in its place; 0 for words that the lexicon lacks and words of degree."""
    low = [w.lower() for w in words]
    upper = [w.isupper() and any(map(str.isalpha, w)) for w in words]
    mixed = 0 < sum(upper) < len(words)
    out = []
    for i, word in enumerate(low):
        v = 0.0 if word in UP or word in DOWN else float(lexicon.get(word, 0.0))
        if v:
            v += math.copysign(CAPITALS, v) if upper[i] and mixed else 0.0
            for back in range(1, min(3, i) + 1):
                near = low[i - back]
                if near in lexicon:
                    continue
                if near in UP or near in DOWN:
                    step = DEGREE + (CAPITALS if upper[i - back] and mixed else 0.0)
                    v += math.copysign(step, v if near in UP else -v) * NEARNESS[back - 1]
                if near in NOT or near.endswith("n't"):
                    v *= NEGATION
        out.append(v)
    if "but" in low:
        at = low.index("but")
        out = [v * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1) for i, v in enumerate(out)]
    return out


def tone(text: str | None, lexicon: Mapping[str, float]) -> tuple[float, float, float, float]:
    """Shares of negative, neutral and positive words, and the compound score in [-1, 1]. Without words: (0, 1, 0, 0)."""
    found = valences(_words(text or ""), lexicon)
    if not found:
        return 0.0, 1.0, 0.0, 0.0
    total, marks = sum(found), _emphasis(text or "")
    total += math.copysign(marks, total) if total else 0.0
    plus, minus = sum(v + 1 for v in found if v > 0), sum(1 - v for v in found if v < 0)
    plus, minus = plus + marks * (plus > minus), minus + marks * (minus > plus)
    every = plus + minus + found.count(0.0)
    return minus / every, found.count(0.0) / every, plus / every, max(-1.0, min(1.0, total / math.sqrt(total * total + NORMAL)))


def lexicon_tone(lexicon: Mapping[str, float]) -> Callable[[Column], Column]:
    """From a column of texts to a struct (neg, neu, pos, compound); the lexicon is a table of fixed size and goes along."""
    names = ("neg", "neu", "pos", "compound")

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def run(texts: pa.Array) -> pa.Array:
        rows = [tone(t.as_py(), lexicon) for t in texts]
        columns = list(zip(*rows)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=list(names))

    return run
