"""Text templates compiled to one Column expression: values, loops over arrays, and templates within templates.

{{ path }} is a value, escaped for XML; {{{ path }}} is it as it stands; {% for item in path %} ... {% endfor %} repeats what is between
for each member of an array; {% include "name" %} stands for another template's text. A path is a name of the scope and members of
structs, parted by dots; what doesn't exist, or is null, reads as nothing. A template's text and each turn of a loop lose the blanks
around them. Values are never read as templates.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructType

from tracelens.functions.text import strip

#: What a name stands for: a column and its type, or none of both.
Scope = Mapping[str, tuple[Column, DataType]]
MARK = re.compile(r"\{%\s*(?P<word>\w+)(?P<rest>[^%]*)%\}|\{\{\{\s*(?P<raw>[^}]+?)\s*\}\}\}|\{\{\s*(?P<safe>[^}]+?)\s*\}\}")


@dataclass(frozen=True)
class Value:
    path: tuple[str, ...]
    raw: bool


@dataclass(frozen=True)
class Loop:
    item: str
    path: tuple[str, ...]
    body: tuple


def parse(template: str, includes: Mapping[str, str] | None = None, within: tuple[str, ...] = ()) -> tuple:
    """A template's nodes: texts, Values and Loops. Unclosed loops, unknown words and templates that hold themselves raise ValueError."""
    stack: list[tuple[str, tuple[str, ...], list]] = [("", (), [])]
    at = 0
    for m in MARK.finditer(template):
        stack[-1][2].append(template[at : m.start()])
        at = m.end()
        path = m["raw"] or m["safe"]
        if path:
            stack[-1][2].append(Value(tuple(path.split(".")), m["raw"] is not None))
        elif m["word"] == "for" and (loop := re.fullmatch(r"\s+(\w+)\s+in\s+([\w.]+)\s*", m["rest"])):
            stack.append((loop[1], tuple(loop[2].split(".")), []))
        elif m["word"] == "endfor" and len(stack) > 1:
            item, over, body = stack.pop()
            stack[-1][2].append(Loop(item, over, tuple(body)))
        elif m["word"] == "include" and (name := re.fullmatch(r'\s+"([^"]+)"\s*', m["rest"])):
            if name[1] in within or name[1] not in (includes or {}):
                raise ValueError(f'no template "{name[1]}" can be included here')
            stack[-1][2].extend(parse(includes[name[1]], includes, (*within, name[1])))
        else:
            raise ValueError(f"not understood: {m[0]}")
    if len(stack) > 1:
        raise ValueError(f"a loop over {'.'.join(stack[-1][1])} is not closed")
    return (*stack[0][2], template[at:])


def scope_of(rows: DataFrame) -> Scope:
    """All columns of rows, by name."""
    return {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields}


def escape(value: Column) -> Column:
    """Text for XML; null reads as nothing."""
    t = F.coalesce(value.cast("string"), F.lit(""))
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(plain), F.lit(safe))
    return t


def _at(path: tuple[str, ...], scope: Scope) -> tuple[Column, DataType] | None:
    found = scope.get(path[0])
    for member in path[1:]:
        if found is None:
            return None
        value, kind = found
        if isinstance(kind, StructType) and member in kind.names:
            found = value[member], kind[member].dataType
        elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
            found = F.try_element_at(value, F.lit(member)), kind.valueType
        else:
            return None
    return found


def _compiled(nodes: tuple, scope: Scope) -> Column:
    parts = []
    for node in nodes:
        if isinstance(node, str):
            parts.append(F.lit(node))
            continue
        found = _at(node.path, scope)
        if found is None:
            continue
        value, kind = found
        if isinstance(node, Value):
            text = F.when(value, "True").when(~value, "False") if isinstance(kind, BooleanType) else value.cast("string")
            parts.append(F.coalesce(text, F.lit("")) if node.raw else escape(text))
        elif isinstance(kind, ArrayType):
            turns = F.transform(value, _turn(node, scope, kind.elementType))
            parts.append(F.coalesce(F.array_join(turns, ""), F.lit("")))
        else:
            raise ValueError(f"{'.'.join(node.path)} is no array")
    return F.concat(*parts) if parts else F.lit("")


def _turn(loop: Loop, scope: Scope, kind: DataType):
    return lambda x: strip(_compiled(loop.body, {**scope, loop.item: (x, kind)}))


def render(template: str, scope: Scope, includes: Mapping[str, str] | None = None) -> Column:
    """The template's text for each row."""
    return strip(_compiled(parse(template, includes), scope))
