"""JSON texts compared by value, as columns: texts are parsed to variants, printed again and cut into tokens.

A variant prints objects with sorted keys and decimals without trailing zeros; what is left to do is
to print doubles that are whole numbers as such, and true and false as 1 and 0, which they equal. A
text with something behind its value is no JSON; nor, unlike in Python, is one that repeats a key of an
object or holds NaN or Infinity. Whole numbers of more than 38 digits are compared as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a printed value: strings, numbers, and what stands between them.
_TOKEN = r'"(?:[^"\\]|\\.)*"|-?\d[\d.E+-]*|[^"\d-]+|-'
#: A string of white space only, as it is printed.
_BLANK = r'(?U)^"(?:\\[nrtf]|\\u00(?:0[bB]|1[c-fC-F]|85|[aA]0)|\s)*"$'
#: An object around a text: its key sorts before the one behind.
_BEFORE, _BEHIND = '{"\\u0000":', ',"\\u0001end":0}'


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value taken once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _printed(text: Column) -> Column:
    """The value's text as a variant prints it; null if the text isn't one JSON value. A second parse, with something behind the text, sees what the first leaves unread."""
    framed = F.to_json(F.try_parse_json(F.concat(F.lit(_BEFORE), text, F.lit(_BEHIND))))
    return _let(F.to_json(F.try_parse_json(text)), lambda value: F.when(framed == F.concat(F.lit(_BEFORE), value, F.lit(_BEHIND)), value))


def _tokens(printed: Column) -> Column:
    return F.regexp_extract_all(printed, F.lit(_TOKEN), F.lit(0))


def _by_value(printed: Column) -> Column:
    """Equal texts for equal values."""

    def same(token: Column) -> Column:
        whole = lambda x: (x == F.floor(x)) & (F.abs(x) < 1e37)
        double = _let(token.try_cast("double"), lambda x: F.when(whole(x), x.try_cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")))
        words = F.replace(F.replace(token, F.lit("true"), F.lit("1")), F.lit("false"), F.lit("0"))
        return F.when(token.startswith('"'), token).when(token.rlike(r"^-?\d.*[.E]"), double).otherwise(words)

    return F.array_join(F.transform(_tokens(printed), same), "")


def canonical(text: Column) -> Column:
    """One text for all JSON texts of equal values; null if the text isn't JSON."""
    return _by_value(_printed(text))


def concrete(text: Column) -> Column:
    """Somewhere inside stands a number, a boolean or a string that isn't blank; keys don't count. False if the text isn't JSON."""

    def says(token: Column, after: Column) -> Column:
        key = F.coalesce(after.startswith(":"), F.lit(False))
        return F.when(token.startswith('"'), ~key & ~token.rlike(_BLANK)).otherwise(token.rlike(r"\d|true|false"))

    found = _let(_tokens(_printed(text)), lambda tokens: F.exists(F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), says), lambda x: x))
    return F.coalesce(found, F.lit(False))


def tool_score(answer: Column, reference: Column, safety: tuple[str, ...], cap: float) -> Column:
    """Tool name .35, arguments .15, their keys .20 and values .30; a wrong safety argument caps the sum. 0 unless both are objects, 1 for equal ones."""

    def call(text: Column) -> Column:
        """The parts of a call: all, name, arguments (each by value)."""
        shown = lambda v: F.coalesce(_by_value(F.to_json(v)), F.lit("null"))

        def parts(v: Column) -> Column:
            arguments = F.transform_values(F.try_variant_get(v, "$.arguments", "map<string,variant>"), lambda _, x: shown(x))
            return F.struct(shown(F.try_variant_get(v, "$.tool_name", "variant")).alias("name"), arguments.alias("arguments"))

        return _let(F.try_parse_json(text), parts)

    def score(c: Column) -> Column:
        have, want = c["have"]["arguments"], c["want"]["arguments"]
        keys = F.map_keys(want)
        n = F.size(keys)
        right = lambda k: F.coalesce(F.element_at(have, k), F.lit("null")) == F.element_at(want, k)
        both = have.isNotNull() & (n > 0)
        told = 0.15 + 0.20 * F.size(F.array_intersect(keys, F.map_keys(have))) / n + 0.30 * F.size(F.filter(keys, right)) / n
        whole = F.when(c["have"]["name"] == c["want"]["name"], 0.35).otherwise(0.0) + F.when(both, told).otherwise(0.0)
        wrong = F.exists(keys, lambda k: k.isin(*safety) & ~right(k))
        return _let(whole, lambda s: F.least(F.when(both & wrong, F.least(s, F.lit(cap))).otherwise(s), F.lit(1.0)))

    def compared(c: Column) -> Column:
        objects = F.coalesce(c["said"].startswith("{") & c["gold"].startswith("{"), F.lit(False))
        parts = F.struct(call(answer).alias("have"), call(reference).alias("want"))
        return F.when(~objects, 0.0).when(c["said"] == c["gold"], 1.0).otherwise(_let(parts, score))

    return _let(F.struct(canonical(answer).alias("said"), canonical(reference).alias("gold")), compared)
