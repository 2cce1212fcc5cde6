"""Instruments by name: each gives a column function from a text to a score in [-1, 1]."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paritas.functions.sentiment import lexicon_tone
from paritas.functions.texts import parse_tone

Scorer = Callable[[Column], Column]
_MAKERS: dict[str, Callable[..., Scorer]] = {}


def register(name: str) -> Callable:
    """Adds an instrument: a function from what it needs to its column function."""

    def keep(maker: Callable[..., Scorer]) -> Callable[..., Scorer]:
        _MAKERS[name] = maker
        return maker

    return keep


@register("lexicon")
def lexicon(lexicon: Mapping[str, float], **_) -> Scorer:
    """Valences of words, with the rules of ``functions.sentiment``."""
    score = lexicon_tone(lexicon)
    return lambda text: score(text)["compound"]


@register("transformer")
def transformer(transformer: Scorer, **_) -> Scorer:
    """A classifier's score, by a given column function."""
    return lambda text: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), transformer(text)))


@register("llm")
def llm(ask: Scorer, **_) -> Scorer:
    """The number in a model's answer; ``ask`` is a column function from a text to an answer. Null where it has none."""
    return lambda text: parse_tone(ask(text))[0]


def instruments(names: Sequence[str], **needs) -> dict[str, Scorer]:
    """The column functions of these instruments, in order, for ``audits.paragraph_audit`` and ``audits.dilution``."""
    unknown = [n for n in names if n not in _MAKERS]
    if unknown:
        raise ValueError(f"unknown instruments {unknown}; there are {sorted(_MAKERS)}")
    return {n: _MAKERS[n](**needs) for n in names}
