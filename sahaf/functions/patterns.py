"""Regular expressions as several engines read them, and the literals that a match must hold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character of a word, whatever the engine's flags.
WORD = r"[\p{L}\p{N}_]"
#: Marks around matches; they stand in no text.
OPEN, CLOSE = "\x01", "\x02"
#: Letters that are one letter if case doesn't count.
SAME = ("İIıſ", "iiis")


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode classes, words of letters and digits, and their bounds, for the JVM."""
    bound = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    return ("(?iuU)" if ignore_case else "(?U)") + pattern.replace(r"\b", bound).replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", WORD)


def folded(text: Column) -> Column:
    """Text in which letters that differ in case, or in the dot of an i, are the same."""
    return F.translate(F.lower(F.translate(text, *SAME)), *SAME)


def _fold(literal: str) -> str:
    table = str.maketrans(*SAME)
    return literal.translate(table).lower().translate(table)


def _walk(items) -> list[set[str]]:
    """Of a parsed pattern, sets of literals: of each set one stands in every match."""
    out: list[set[str]] = []
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is parser.LITERAL:
            run += chr(arg)
            continue
        if run:
            out.append({_fold(run)})
            run = ""
        if op is parser.BRANCH:
            own = [_walk(b) for b in arg[1]]
            if all(own):  # of each branch the set of the longest literals
                out.append(set().union(*(max(sets, key=_least) for sets in own)))
        elif op is parser.SUBPATTERN:
            out += _walk(arg[3])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] > 0:
            out += _walk(arg[2])
    return out


def _least(literals: set[str]) -> int:
    return min(map(len, literals))


#: Characters of the grams by which texts and rules meet, at most.
GRAM = 3


def required(pattern: str) -> tuple[set[str], list[list[str]]]:
    """What a match holds, in folded text: grams one of which stands in it, the ends of its longest literals, and sets of literals of each of which one does."""
    sets = _walk(parser.parse(pattern))
    if not sets:
        raise ValueError(f"no literal stands in every match of {pattern}")
    key = max(sets, key=_least)
    return {w[-GRAM:] for w in key}, [sorted(s) for s in sets]


def may_match(low: Column, pattern: str) -> Column:
    """Whether folded text holds what every match of a pattern does; searching for literals is much cheaper than matching."""
    plain = pattern.replace(WORD, r"\w").replace(r"[\p{L}", r"[\w")
    _, sets = required(plain)
    held = [reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in own)) for own in sorted(sets, key=len)]
    return reduce(lambda a, b: a & b, held)


def grams(text: Column, sizes: set[int]) -> Column:
    """The distinct grams of those sizes of a text."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)) for n in sorted(sizes))))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once however often it is used."""
    return F.get(F.transform(F.array(x), use), 0)


#: Numbers that are summed up one by one; sums of longer arrays are put together from theirs.
CHUNK = 256


def running_sums(numbers: Column) -> Column:
    """The sum up to each of an array of ints, in steps that stay nearly linear for long arrays."""

    def grow(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.expr("CAST(array() AS ARRAY<INT>)").alias("sums"))
        return F.aggregate(values, start, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["sums"], F.array(a["sum"] + n)).alias("sums")), lambda a: a["sums"])

    def put_together(own: Column) -> Column:
        return let(grow(F.transform(own, lambda e: F.element_at(e, -1))), lambda ends: F.flatten(F.transform(own, lambda e, k: F.transform(e, lambda v: v + F.when(k > 0, F.get(ends, k - 1)).otherwise(0)))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int")), lambda c: grow(F.slice(numbers, c * CHUNK + 1, F.lit(CHUNK))))
    return F.when(F.size(numbers) <= CHUNK, grow(numbers)).otherwise(let(chunks, put_together))


NO_PLACES = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, text: STRING>>)"


def between_marks(marked: Column) -> Column:
    """(start, end, text) of what stands between marks, places counted without them."""

    def cut(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda x: F.length(x)))
        both = F.arrays_zip(parts.alias("text"), ends.alias("end"))
        inner = F.filter(both, lambda x, k: k % 2 == 1)
        return F.transform(inner, lambda x: F.struct((x["end"] - F.length(x["text"])).alias("start"), x["end"].alias("end"), x["text"].alias("text")))

    def told(own: Column) -> Column:
        return F.when(F.contains(own, F.lit(OPEN)), let(F.split(own, f"[{OPEN}{CLOSE}]", -1), cut)).otherwise(F.when(own.isNotNull(), F.expr(NO_PLACES)))

    return let(marked, told)


def unmarked(text: Column) -> Column:
    """A text in which blanks stand for marks."""
    return F.translate(text, OPEN + CLOSE, "  ")


def places(text: Column, pattern: str) -> Column:
    """(start, end, text) of every match of a pattern."""
    return between_marks(F.regexp_replace(unmarked(text), f"({pattern})", f"{OPEN}$1{CLOSE}"))
