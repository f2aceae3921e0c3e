"""Column expressions over text."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words (fixed values: the usual public list).
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself
it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has
had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
WHITE = " \t\n\x0b\f\r"


def terms(text: Column) -> Column:
    """Distinct lower-cased words: split at spaces as they are, and again with punctuation as spaces; empty and stop words dropped."""
    low = F.btrim(F.lower(text), F.lit(WHITE))
    plain = F.btrim(F.translate(low, string.punctuation, " " * len(string.punctuation)), F.lit(WHITE))
    both = F.array_union(F.split(low, " "), F.split(plain, " "))
    return F.filter(both, lambda t: (t != "") & ~t.isin(STOP_WORDS))


def first_authors(authors: Column, n: int = 5, sep: str = " | ") -> Column:
    """The first n authors and how many more there are."""
    parts = F.split(authors, re.escape(sep))
    more = F.size(parts) - n
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, n), sep), F.lit(sep), more.cast("string"), F.lit("+"))).otherwise(authors)


def shortened(text: Column, n: int = 1500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("[...]"))).otherwise(text)


def normal_name(name: Column) -> Column:
    """Words capitalised, commas dropped."""
    return F.initcap(F.replace(name, F.lit(", "), F.lit(" ")))


def search_words(term: str) -> list[str]:
    """Lower-cased words of a search term, punctuation as spaces; at least three characters are asked for."""
    words = term.lower().translate(str.maketrans(string.punctuation, " " * len(string.punctuation))).split()
    if len("".join(words)) < 3:
        raise ValueError("a search term needs three characters")
    return words


def title_condition(text: str, title: Column) -> Column:
    """A boolean title filter as a column: ``and``, ``or``, ``and not`` and parentheses combine phrases, which are substrings in any case.

    Without `` and `` or `` or `` in it, plain spaces mean and; with one, they belong to the phrases. ``+`` is a space inside a phrase, ``*`` is ignored. The
    first operator outside parentheses splits a text, what follows it belongs together: ``a and b or c`` is ``a and (b or c)``.
    """
    low = F.lower(title)
    text = re.sub(" +", " ", text.replace("*", "").strip())
    if not text:
        return F.lit(True)
    if " and " not in text and " or " not in text:
        text = text.replace(" ", " and ")

    def balanced(t: str) -> bool:
        depth = 0
        for c in t:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                return False
        return depth == 0

    def read(t: str) -> Column:
        t = t.strip()
        while t.startswith("(") and t.endswith(")") and balanced(t[1:-1]):
            t = t[1:-1].strip()
        for m in re.finditer(r" (and not|and|or) ", t, re.IGNORECASE):
            if balanced(t[: m.start()]):
                left, right, how = read(t[: m.start()]), read(t[m.end() :]), m[1].lower()
                return left | right if how == "or" else left & ~right if how == "and not" else left & right
        if not t or not balanced(t):
            raise ValueError(f"title filter is malformed: {text!r}")
        return F.contains(low, F.lit(t.strip('"').lower()))

    return read(text.replace("+", " "))


def rounded(x: Column) -> Column:
    """x to two decimals, a tie to the even digit, judged by the exact binary value (0.125 to 0.12, 2.675 to 2.67).

    The fraction is taken as a whole number of 2**-60, which loses nothing from 0.005 up, and multiplied by 100 in two halves of 30 bits.
    """
    whole, low = F.floor(F.abs(x)), (1 << 30) - 1
    m = ((F.abs(x) - whole) * F.lit(float(1 << 60))).cast("long")
    upper = F.shiftright(m, 30) * 100 + F.shiftright(m.bitwiseAND(low) * 100, 30)
    q, rest, half = F.shiftright(upper, 30), F.shiftleft(upper.bitwiseAND(low), 30) + (m.bitwiseAND(low) * 100).bitwiseAND(low), 1 << 59
    up = F.when((rest > half) | ((rest == half) & (q % 2 == 1)), 1).otherwise(0)
    return F.signum(x) * (whole * 100 + q + up) / 100.0
