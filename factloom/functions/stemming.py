"""Porter's stemmer as column expressions: a cascade of suffix rules, each under a condition on what is left of the word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm (Porter 1980, with the author's later departures -bli and -logi).
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# A consonant run begins with any letter but a, e, i, o, u; y is a vowel behind a consonant. A word that begins with y has it as a capital for the time.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^({_C})?{_V}{_C}"  # measure above 0
ONE = f"^({_C})?{_V}{_C}({_V})?$"  # measure 1
MORE = f"^({_C})?{_V}{_C}{_V}{_C}"  # measure above 1
VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonant, vowel, consonant at the end
DOUBLE = r"([^aeiouylsz])\1$"  # a doubled consonant but l, s, z


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _without(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _rules(w: Column, rules: list[tuple[str, str]], condition: str) -> Column:
    """The longest suffix that the word has decides; it is replaced if the condition holds for the rest."""
    out = w
    for suffix, put in sorted(rules, key=lambda r: len(r[0])):
        rest = _without(w, suffix)
        out = F.when(F.endswith(w, F.lit(suffix)), F.when(F.rlike(rest, F.lit(condition)), F.concat(rest, F.lit(put))).otherwise(w)).otherwise(out)
    return out


def _plural(w: Column) -> Column:
    cut = F.when(F.rlike(w, F.lit("(ss|i)es$")), _without(w, "es"))
    return cut.when(F.rlike(w, F.lit("[^s]s$")), _without(w, "s")).otherwise(w)


def _past(w: Column) -> Column:
    def ending(suffix: str) -> Column:
        return F.endswith(w, F.lit(suffix)) & F.rlike(_without(w, suffix), F.lit(VOWEL))

    def mended(x: Column) -> Column:
        out = F.when(F.rlike(x, F.lit("(at|bl|iz)$")), F.concat(x, F.lit("e"))).when(F.regexp_like(x, F.lit(DOUBLE)), _without(x, "x"))
        return out.when(F.rlike(x, F.lit(ONE)) & F.rlike(x, F.lit(SHORT)), F.concat(x, F.lit("e"))).otherwise(x)

    eed = F.when(F.rlike(_without(w, "eed"), F.lit(SOME)), _without(w, "d")).otherwise(w)
    return F.when(F.endswith(w, F.lit("eed")), eed).when(ending("ed"), _let(_without(w, "ed"), mended)).when(ending("ing"), _let(_without(w, "ing"), mended)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("y")) & F.rlike(_without(w, "y"), F.lit(VOWEL)), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w)


def _residual(w: Column) -> Column:
    plain = _rules(w, [(s, "") for s in STEP_4], MORE)
    return F.when(F.endswith(w, F.lit("ion")), F.when(F.rlike(_without(w, "ion"), F.lit("[st]$")) & F.rlike(_without(w, "ion"), F.lit(MORE)), _without(w, "ion")).otherwise(w)).otherwise(plain)


def _final_e(w: Column) -> Column:
    rest = _without(w, "e")
    return F.when(F.endswith(w, F.lit("e")) & (F.rlike(rest, F.lit(MORE)) | (F.rlike(rest, F.lit(ONE)) & ~F.rlike(rest, F.lit(SHORT)))), rest).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & F.rlike(w, F.lit(MORE)), _without(w, "l")).otherwise(w)


def porter(word: Column) -> Column:
    """The stem of a word, lower-cased. Words of up to two letters are left as they are; anything but a to z counts as a consonant; null gives null."""
    x = F.lower(word)
    y = F.startswith(x, F.lit("y"))
    out = F.when(y, F.concat(F.lit("Y"), F.substring(x, 2, 1 << 30))).otherwise(x)
    for step in (_plural, _past, _final_y, lambda w: _rules(w, STEP_2, SOME), lambda w: _rules(w, STEP_3, SOME), _residual, _final_e, _final_l):
        out = _let(out, step)
    return F.when(F.length(word) < 3, x).when(y, F.concat(F.lit("y"), F.substring(out, 2, 1 << 30))).otherwise(out)
