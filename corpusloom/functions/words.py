"""Word functions: the stop words, the measure of a word, and a five-step suffix stemmer, as SQL text for either engine.

A step replaces the longest suffix whose condition holds, once. The Spark column and the SQL of the checks come from one table of
rules by different ways, and both stay inside the engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(sorted(set((
    "the of to in and on at by for from with as is are was were be has had have he it its they this that these an a "
    "will but what when where who which why how all any both each few more most other some such no nor not only own same so than too very"
).split()) - {"these"}))

# (suffixes with what comes in their place, least measure of what is left, or None for no condition)
STEPS: list[tuple[dict[str, str], int | None]] = [
    ({"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, None),
    ({"eed": "ee", "ed": "", "ing": ""}, 1),
    (
        dict(
            pair.split(">")
            for pair in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble".split()
        ),
        1,
    ),
    (dict(pair.split(">") for pair in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split()), 1),
    (dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), ""), 2),
]
VOWEL_BREAK = "[aeiou][^aeiou]"


def measure(word: Column) -> Column:
    """How often a run of vowels is followed by another letter."""
    return F.regexp_count(word, F.lit(VOWEL_BREAK))


def _step(step: tuple[dict[str, str], int | None]):
    """One step, as a function of a column."""
    return lambda x: _replaced(x, *step)


def _replaced(x: Column, rules: dict[str, str], least: int | None) -> Column:
    """Suffixes are tried by their last letter, so that most words take a few comparisons."""
    by_end: dict[str, list[str]] = {}
    for suffix in sorted(rules, key=lambda s: (-len(s), s)):
        by_end.setdefault(suffix[-1], []).append(suffix)
    out = F
    for end, suffixes in sorted(by_end.items()):
        inner = F
        for suffix in suffixes:
            n = len(suffix)
            rest = F.left(x, F.length(x) - n)
            test = F.endswith(x, F.lit(suffix)) & (F.length(x) > n)
            if least is not None:
                test = test & (measure(rest) >= least)
            inner = inner.when(test, F.concat(rest, F.lit(rules[suffix])))
        out = out.when(F.endswith(x, F.lit(end)), inner.otherwise(x))
    return out.otherwise(x)


def with_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """Adds the stem of a lower-case word; words of up to two bytes stay. Stop words are the caller's."""
    return df.withColumn(out, stemmed_column(F.col(word)))


def stemmed_column(word: Column) -> Column:
    """The stem. Lambdas bind the result of each step to a name: as plain nested expressions the steps would multiply when a filter moves through them."""
    x = F.array(word)
    for step in STEPS:
        x = F.transform(x, _step(step))
    return F.when(F.octet_length(word) <= 2, word).otherwise(F.element_at(x, 1))


def stem_sql(source: str, word: str, out: str) -> str:
    """DuckDB: a query that adds the stem to all columns of a source. Written as the rules read, suffix by suffix."""
    sql = f"select *, {word} as {out} from {source}"
    for rules, least in STEPS:
        whens = []
        for suffix in sorted(rules, key=lambda s: (-len(s), s)):
            n = len(suffix)
            rest = f"left({out}, length({out}) - {n})"
            test = f"length({out}) > {n} and right({out}, {n}) = '{suffix}'"
            if least is not None:
                test += f" and len(regexp_extract_all({rest}, '{VOWEL_BREAK}')) >= {least}"
            whens.append(f"when {test} then {rest} || '{rules[suffix]}'")
        sql = f"select * replace (case when strlen({word}) <= 2 then {out} {' '.join(whens)} else {out} end as {out}) from ({sql})"
    return sql


_BY_END = [({e: [(s, r) for s, r in sorted(rules.items(), key=lambda p: (-len(p[0]), p[0])) if s[-1] == e] for e in {s[-1] for s in rules}}, least) for rules, least in STEPS]
_BREAK = re.compile(VOWEL_BREAK)


def stem(word: str) -> str:
    """The same for one word, in Python, for whole blocks of tokens, queries at the driver and tests."""
    if len(word.encode()) <= 2:
        return word
    for by_end, least in _BY_END:
        for suffix, other in by_end.get(word[-1], ()):
            if word.endswith(suffix) and len(word) > len(suffix):
                rest = word[: -len(suffix)]
                if least is None or len(_BREAK.findall(rest)) >= least:
                    word = rest + other
                    break
    return word
