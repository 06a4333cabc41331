"""Coercions of loosely typed values, and tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.text import u_trim

#: Default and range of difficulty.
DIFFICULTY, DIFFICULTY_RANGE = 3, (1, 5)
ITEM = "array<struct<content:string,question_type:string,knowledge_points:string,difficulty:string,number:string>>"


def points_from_text(x: Column) -> Column:
    """Knowledge points of a text, divided at commas, semicolons and line feeds; trimmed, without blank ones; [] for NULL."""
    return F.coalesce(F.filter(F.transform(F.split(x, r"[\n,，、;；]+"), u_trim), lambda s: s != ""), F.array().cast("array<string>"))


def points_from_list(x: Column) -> Column:
    """Knowledge points of a list: trimmed, without NULL and blank ones; [] for NULL."""
    return F.coalesce(F.filter(F.transform(x, u_trim), lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))


def difficulty(x: Column) -> Column:
    """A whole number from 1 to 5; 3 for anything else. Numbers lose their fraction; text must be a whole number, white space
    around it allowed."""
    t, kind = u_trim(x.cast("string")), F.typeof(x)
    plain = F.when(t.rlike(r"^[+-]?[0-9]{1,9}$"), t.try_cast("int"))
    v = x.try_cast("double")
    whole = F.when(F.abs(v) < 1e9, F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int"))
    n = F.when(kind.isin("double", "float", "boolean") | kind.startswith("decimal"), whole).otherwise(plain)
    return F.when(n.between(*DIFFICULTY_RANGE), n).otherwise(DIFFICULTY)


def json_items(x: Column, schema: str = ITEM) -> Column:
    """The array of objects in a reply: fences are dropped, the text from the first [ to the last ] is read with straight
    quotes and without trailing commas; if that fails, the text from the first [ with a ] added; if that fails as well, each
    flat object that can be read alone. [] if there is none."""
    bare = F.regexp_replace(x, r"```(?:json)?", "")
    tidy = lambda s: F.regexp_replace(F.translate(s, "“”‘’", "\"\"''"), r",\s*([}\]])", "$1")
    one = schema.removeprefix("array<").removesuffix(">")
    read = lambda s: F.filter(F.from_json(tidy(s), schema), lambda r: r.isNotNull())
    whole = read(F.regexp_extract(bare, r"(?s)(\[.*\])", 1))
    closed = read(F.concat(F.regexp_replace(F.regexp_extract(bare, r"(?s)(\[.*)", 1), r"[,\s]+$", ""), F.lit("]")))
    salvaged = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"(\{[^{}]*\})"), 1), lambda s: F.from_json(s, one)), lambda s: s["content"].isNotNull())
    ok = lambda items: F.exists(F.coalesce(items, F.array().cast(schema)), lambda s: s["content"].isNotNull())
    return F.coalesce(F.when(ok(whole), whole), F.when(ok(closed), closed), salvaged, F.array().cast(schema))


def first_object(x: Column, schema: str) -> Column:
    """The first flat JSON object of a text."""
    return F.from_json(F.regexp_extract(x, r"(\{[^}]+\})", 1), schema)


def first_array(x: Column, schema: str) -> Column:
    """The first JSON array of a text, up to the first closing bracket."""
    return F.from_json(F.regexp_extract(x, r"(?s)(\[.*?\])", 1), schema)


def flag(value: str | None) -> bool:
    """Whether a setting is on: all but 0, false, no and nothing."""
    return (value or "").strip().lower() not in ("", "0", "false", "no")
