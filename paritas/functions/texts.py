"""Rule-based rewriting of texts, splitting, counting and parsing, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and replacements, in the order in which they apply. Case is ignored.
HONORIFICS = [(p, "[HONORIFIC]") for p in (r"\bMr\.?\b", r"\bMrs\.?\b", r"\bMs\.?\b", r"\bMiss\b", r"\bDr\.?\b", r"\bProf\.?\b", r"\bSir\b", r"\bMadam\b")]
PRONOUNS = [
    (r"\bhe\b", "they"), (r"\bshe\b", "they"), (r"\bhim\b", "them"), (r"\bher\b", "their"), (r"\bhis\b", "their"),
    (r"\bhers\b", "theirs"), (r"\bhimself\b", "themself"), (r"\bherself\b", "themself"),
]
ETHNICITIES = [(
    r"\b(?:African[- ]American|Black|Caucasian|White|Hispanic|Latino|Latina|Latine|Latinx|Asian|Pacific Islander|Native American|"
    r"American Indian|Indigenous|Middle Eastern|South Asian|East Asian|Southeast Asian|Native Hawaiian)\b", "[ETHNICITY]",
)]
SCHOOL_KINDS = "School of Medicine|Medical School|Medical College|College of Medicine|School of Osteopathic Medicine|University School of Medicine"
SCHOOLS = [(rf"\b[A-Za-z][a-zA-Z]+ (?:{SCHOOL_KINDS})\b", "[SCHOOL]")] + [
    (rf"\b{name}\b", "[SCHOOL]")
    for name in ("Baylor", "Columbia", "Cornell", "Dartmouth", "Duke", "Harvard", "Johns Hopkins", "Mayo", "Stanford", "UCLA", "UCSF", "Washington University", "Yale")
]
SUBSTITUTIONS = [
    (r"\bcaring\b", "skilled"), (r"\bnurturing\b", "competent"), (r"\bwarm\b", "professional"), (r"\bhelpful\b", "effective"),
    (r"\bpleasant\b", "professional"), (r"\bdiligent\b", "thorough"), (r"\bhardworking\b", "effective"), (r"\bdedicated\b", "committed"),
    (r"\bconscientious\b", "thorough"), (r"\bmeticulous\b", "detail-oriented"),
]
#: Fixed values of the tier-aware school substitution.
TIERS = {"top_20": "TIER1", "mid_tier": "TIER2", "lower_tier": "TIER3"}
TIER_PHRASE = rf"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){{0,3}}\s+(?:{SCHOOL_KINDS})\b"
TIER_NAMES = (
    "Harvard", "Stanford", "Johns Hopkins", "Hopkins", "UCSF", "Yale", "Columbia", "Penn", "Duke", "Michigan",
    "Washington University", "Cornell", "Dartmouth", "Mayo", "UCLA", "Baylor", "Tulane", "Saint Louis", "Albany", "Wake Forest",
    "Indiana", "Iowa", "Tennessee", "Emory", "Pritzker", "Perelman", "Meharry", "Morehouse", "Miami Miller",
    "Virginia Commonwealth", "VCU", "Louisville", "Boonshoft", "Wright State", "New Mexico", "Rowan", "Toledo", "Wayne State", "Incarnate Word",
)
TIER_CUES = r"\b(?i:medical|school|university|residency|pre-?med|college|MD|physician|doctor|hospital|attending|preceptor)\b"
TIER_WINDOW = 80

Rules = Iterable[tuple[str, str]]


def java_replacement(text: str) -> str:
    r"""``\1`` as ``$1``; a plain dollar is escaped."""
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", "\\$"))


def apply_rules(text: Column, rules: Rules, ignore_case: bool = True) -> Column:
    """The rules one after the other, with word borders of all scripts."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, F.lit(("(?iU)" if ignore_case else "(?U)") + pattern), F.lit(java_replacement(replacement)))
    return text


def merged(rules: Rules) -> list[tuple[str, str]]:
    r"""Neighbouring rules ``\bword\b`` of one replacement as one alternation: fewer passes, the same result for words that do not overlap."""
    out: list[tuple[str, str]] = []
    for pattern, replacement in rules:
        plain = re.fullmatch(r"\\b([A-Za-z ]+(?:\\\.\?)?)\\b", pattern)
        if plain and out and out[-1][1] == replacement and out[-1][0].startswith(r"\b(?:") and out[-1][0].endswith(r")\b") and "[" not in out[-1][0]:
            out[-1] = (f"{out[-1][0][:-3]}|{plain[1]})\\b", replacement)
        else:
            out.append((rf"\b(?:{plain[1]})\b" if plain else pattern, replacement))
    return out


def anonymise(
    text: Column, honorifics: bool = True, pronouns: bool = True, ethnicity: bool = True, schools: bool = True,
    custom: Rules = (), ner: Callable[[Column], Column] | None = None,
) -> Column:
    """Names (if ``ner`` is given), honorifics, pronouns, ethnic terms, schools, own patterns, in this order; null gives ""."""
    out = F.coalesce(text, F.lit(""))
    out = ner(out) if ner else out
    for on, rules in ((honorifics, merged(HONORIFICS)), (pronouns, merged(PRONOUNS)), (ethnicity, ETHNICITIES), (schools, merged(SCHOOLS)), (True, custom)):
        out = apply_rules(out, rules) if on else out
    return out


def substitute(text: Column, extra: Rules = (), ignore_case: bool = True, base: Rules | None = None) -> Column:
    """Loaded words by neutral ones; ``extra`` adds to the table or replaces its rows."""
    table = dict(SUBSTITUTIONS if base is None else base)
    table.update(extra)
    return apply_rules(F.coalesce(text, F.lit("")), table.items(), ignore_case)


def mitigate(text: Column, *steps: Callable[[Column], Column], **options) -> Column:
    """Anonymised, then substituted, then further steps."""
    out = substitute(anonymise(text, **options))
    for step in steps:
        out = step(out)
    return out


def ner_redaction(text: Column, finder) -> Column:
    """Named spans by placeholders. ``finder``: from a text to (start, end, label) spans; runs on Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.types import StringType

    marks = {"PERSON": "[NAME]", "ORG": "[ORG]", "GPE": "[LOC]", "LOC": "[LOC]"}

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts.to_pylist():
            value = value or ""
            for start, end, label in sorted(finder(value), key=lambda s: -s[0]):
                if label in marks:
                    value = value[:start] + marks[label] + value[end:]
            out.append(value)
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType())(text)


def tier_substitution(text: Column, tier: Column) -> Column:
    """School names by the placeholder of the row's own tier; short names only near a word of the medical context."""
    mark = F.lit(None).cast("string")
    for name, label in TIERS.items():
        mark = F.when(tier == name, f"[{label}_SCHOOL]").otherwise(mark)
    out = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(TIER_PHRASE), F.coalesce(mark, F.lit("[SCHOOL]")))
    names = "|".join(sorted(TIER_NAMES, key=len, reverse=True))
    near = rf"(?s)\b(?:{names})\b(?:(?=.{{0,{TIER_WINDOW}}}?{TIER_CUES})|(?<={TIER_CUES}.{{0,{TIER_WINDOW + 24}}}))"
    return F.when(mark.isNull(), text).otherwise(F.regexp_replace(out, F.lit(near), mark))


def sentences(text: Column, least: int = 15, most: int = 200) -> Column:
    """Sentences of ``least`` characters or more, the first ``most`` of them."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    parts = F.transform(F.split(one, r"(?<=[.!?]) "), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: F.length(s) >= least), 1, most)


def word_count(text: Column) -> Column:
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(one == "", 0).otherwise(F.size(F.split(one, " "))).cast("long")


def is_header(line: Column, pattern: str | None = None) -> Column:
    """Whether a stripped line heads a section: upper case with a letter, five characters or more, no leading dash."""
    if pattern is not None:
        return (line != "") & line.rlike(f"^(?:{pattern})")
    return (line == F.upper(line)) & (F.length(line) >= 5) & line.rlike(r"\p{L}") & ~line.startswith("-")


def json_block(answer: Column) -> Column:
    """The first flat {...} of an answer as a map of strings; null if there is none or it is malformed."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"\{[^{}]*\}", 0), F.lit("")), "map<string,string>")


def json_number(block: Column, key: str) -> Column:
    value = F.try_element_at(block, F.lit(key))
    return F.when(value == "true", 1.0).when(value == "false", 0.0).otherwise(finite_cast(value))


def finite_cast(value: Column) -> Column:
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def parse_answers(answer: Column, keys: Iterable[str]) -> list[Column]:
    block = json_block(answer)
    return [json_number(block, k).alias(k) for k in keys]


def parse_tone(answer: Column) -> list[Column]:
    """``compound`` and ``rationale``; a parse error is told in the rationale."""
    block = json_block(answer)
    return [
        json_number(block, "compound").alias("compound"),
        F.when(block.isNull(), F.concat(F.lit("PARSE_ERROR: "), F.substring(answer, 1, 200))).otherwise(F.coalesce(F.try_element_at(block, F.lit("rationale")), F.lit(""))).alias("rationale"),
    ]


def fill_template(skeleton: Column, variant: Column, mark: str = "{VARIANT_PARAGRAPH}") -> Column:
    """``skeleton`` with the variant in its place; an error if the mark is missing."""
    return F.when(F.contains(skeleton, F.lit(mark)), F.replace(skeleton, F.lit(mark), variant)).otherwise(F.raise_error(F.lit(f"{mark} is missing")))


def display(text: Column, size: int = 200) -> Column:
    return F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))


def synthetic_score(text: Column, question: Column, truth: Column) -> Column:
    """A deterministic stand-in for a scorer: hashed, shaped by the known answer."""
    base = (F.conv(F.substring(F.md5(F.concat(F.substring(text, 1, 200), F.lit("|"), question)), 1, 8), 16, 10).cast("long") % 1000) / 1000.0
    return F.when(truth, 0.55 + 0.35 * base).otherwise(0.1 + 0.25 * base)


def token_density(text: Column, pattern: str) -> Column:
    """Matches per 100 words; null without words."""
    return F.try_divide(F.lit(100.0) * F.regexp_count(text, F.lit(f"(?iU){pattern}")), word_count(text).cast("double"))


#: Two ways to ask a writer for a document; {seed}, {race}, {gender} and {school_tier} are filled in.
PROMPTS = {
    "original": "Write a personal statement. Background: {seed}. The applicant is {race}, {gender}, from a {school_tier} school.",
    "content_neutral": "Write a personal statement with the same content for every applicant. Background: {seed}. Identity, for names only: {race}, {gender}, {school_tier}.",
}


def build_prompt(variant: str = "original", prompts: dict | None = None, **columns: Column) -> Column:
    """The prompt of a row: the template of ``variant`` with its fields replaced by columns."""
    out = F.lit({**PROMPTS, **(prompts or {})}[variant])
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), column)
    return out
