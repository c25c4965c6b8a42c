"""Column functions over text and code; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens import dims


def lines(text: str | Column) -> Column:
    """Lines without carriage returns and without the empty one behind a final line break."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.regexp_replace(F.regexp_replace(c, "\r", ""), "\n$", ""), "\n", -1)


def basename(path: str) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "\\\\", "/"), "([^/]+)$", 1)


def extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def language(path: str) -> Column:
    mapping = F.create_map(*(F.lit(x) for kv in dims.LANGUAGES.items() for x in kv))
    return F.coalesce(mapping[extension(path)], F.lit("other"))


def called_names(code: str) -> Column:
    """Names in front of an opening parenthesis, in order of appearance."""
    return F.regexp_extract_all(code, F.lit("([A-Za-z_][A-Za-z0-9_]*) *\\("), F.lit(1))


def matched_kinds(code: str, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur, joined with commas in the order of the table."""
    return F.concat_ws(",", *(F.when(F.col(code).rlike(p), F.lit(k)) for k, p in patterns.items()))


def json_object(text: str) -> Column:
    """From the first opening to the last closing brace; null where there is none."""
    return F.nullif(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), F.lit(""))


def first_integer(text: str | Column) -> Column:
    """The first run of digits as a number, null where there is none (``line 42-50`` is 42)."""
    return F.expr("try_cast(nullif(regexp_extract({}, '([0-9]+)', 1), '') as int)".format(text))


def is_script(path: str) -> Column:
    return F.lower(path).rlike("\\.(js|ts|jsx|tsx|mjs|cjs)$")


def any_prefix(name: str, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(name).startswith(p)
    return out


def any_match(code: str, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col(code).rlike(p)
    return out


def first_match(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that occurs matches, null where none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns))


def matched_texts(code: str, patterns: list[str], most: int = 40) -> Column:
    """The first match of each pattern, cut to ``most`` characters, joined in the order of the table."""
    return F.concat_ws("|", *(F.nullif(F.substring(F.regexp_extract(code, p, 0), 1, most), F.lit("")) for p in patterns))


def json_list_items(text: str) -> Column:
    """Number of items of a JSON list: the whole text, else a fenced one, else from the first to the last bracket; null without a list."""
    tries = (F.trim(text), F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\[.*?\\])\\s*```", 1), F.regexp_extract(text, "(?s)(\\[.*\\])", 1))
    return F.coalesce(*(F.when(t.startswith("["), F.json_array_length(t)) for t in tries))
