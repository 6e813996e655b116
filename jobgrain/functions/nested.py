"""Nested cells: literal text to typed values, element and field access."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.functions.text import strip

# A run of quoted strings and unquoted text, then a bare word: the words inside
# quotes are never touched.
_BARE_WORD = (r"""\G((?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"])*?)"""
              r"""\b%s\b""")


def literal_to_json(c: Column) -> Column:
    """Rewrite bare None/True/False outside quotes; single quotes are read as is."""
    words = {"None": "null", "True": "true", "False": "false"}
    rewritten = c
    for word, json_word in words.items():  # never run on text without the word: it would go through long text to its end
        rewritten = F.when(F.contains(c, F.lit(word)), F.regexp_replace(rewritten, _BARE_WORD % word, f"$1{json_word}")).otherwise(rewritten)
    # The cheap test spares almost every cell the regular expressions; `c` is named once in each branch, not once more for every word.
    return F.when(reduce(or_, [F.contains(c, F.lit(w)) for w in words]), rewritten).otherwise(c)


def looks_nested(c: Column) -> Column:
    return _nested(strip(c))


def _nested(text: Column) -> Column:
    return ((F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")))
            | (F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))))


def parse_cell(c: Column, schema: T.DataType) -> Column:
    """Typed value of a stringified dict or list; NULL when it cannot be read."""
    options = {"allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}
    # A lambda binds the stripped text once; written out, it would be stripped again wherever it is named.
    read = F.transform(F.array(strip(c)), lambda t: F.when(_nested(t), F.from_json(literal_to_json(t), schema, options)))
    return F.get(read, F.lit(0))


def first_field(c: Column, field: str) -> Column:
    """Field of the first element; NULL for an absent or empty list."""
    return F.get(c, F.lit(0))[field]


def names_of(c: Column) -> Column:
    """The `name` of every element; an absent list is an empty one."""
    return F.coalesce(F.transform(c, lambda e: e["name"]), F.array().cast("array<string>"))
