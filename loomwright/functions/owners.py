"""Owner names in definitions: which qualifiers name the owning schema, and texts without them. Aliases are looked up in scopes; nothing
is parsed beyond them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexing import tokens

# Words that a relation follows, and words that no alias can be.
RELATION_AFTER = {"FROM", "JOIN", "INTO", "UPDATE", "TABLE", "USING", "ONLY", "VIEW", "FUNCTION", "PROCEDURE", "TRIGGER", "PACKAGE", "BODY", "TYPE", "SEQUENCE", "REFERENCES", "ON"}
NO_ALIAS = set("SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH FOR WINDOW JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER ON USING UNION INTERSECT EXCEPT MINUS SET VALUES RETURNING WHEN THEN ELSE END AND OR NOT AS LATERAL ONLY CONNECT START WITH TABLESAMPLE IS BEGIN LOOP DEFAULT".split())

_REGCLASS = re.compile(r"\s*::\s*(?:pg_catalog\s*\.\s*)?regclass\b", re.IGNORECASE)
_QUALIFIED = re.compile(r"\s*(\"(?:[^\"]|\"\")+\"|[A-Za-z_\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)\s*\.\s*(?=\S)")


@dataclass
class _Scope:
    outer: _Scope | None = None
    names: set[str] = field(default_factory=set)

    def knows(self, name: str) -> bool:
        return name in self.names or self.outer is not None and self.outer.knows(name)


def fold(name: str, mode: str = "postgres") -> str:
    """The stored form of a written name."""
    if name.startswith('"'):
        return name[1:-1].replace('""', '"')
    return name.upper() if mode == "oracle" else name.lower()


def without_owner(definition: str | None, owner: str | None, mode: str = "postgres") -> str | None:
    """The definition without its owner's qualifiers, in whatever form they are written; null where that can't be told.

    A name before a dot is the owner's if it follows a word that a relation follows, or is the first of a list there, or if no alias or relation of its scope or one
    around it has that name. Names in quotes, comments and dollar blocks stay, but those of regclass literals are names, too. A definition
    that uses the owner's name as an alias and before a call, or has broken comments, can't be told."""
    if definition is None or owner is None:
        return definition
    spans = [(k, a, b) for k, a, b in tokens(definition, mode) if k not in ("space", "comment")]
    if any(k == "broken" for k, _, _ in spans):
        return None
    name = [fold(definition[a:b], mode) if k in ("word", "name") else None for k, a, b in spans]
    word = [definition[a:b].upper() if k == "word" else "" for k, a, b in spans]
    kind = [k for k, _, _ in spans]
    scope_of, related, scope, in_list = [], set(), _Scope(), [False]
    at = 0
    while at < len(spans):
        scope_of.append(scope)
        if kind[at] == "(":
            scope = _Scope(scope)
            in_list.append(False)
        elif kind[at] == ")" and scope.outer is not None:
            scope = scope.outer
            in_list.pop()
            scope_of[at] = scope
            # A subquery's alias.
            alias = at + 1 + (at + 1 < len(spans) and word[at + 1] == "AS")
            if in_list[-1] and alias < len(spans) and name[alias] is not None and word[alias] not in NO_ALIAS:
                scope.names.add(name[alias])
        elif word[at] in ("FROM", "JOIN", "UPDATE", "INTO", "USING"):
            in_list[-1] = True
        elif word[at] in ("WHERE", "GROUP", "HAVING", "ORDER", "SET", "VALUES", "SELECT", "RETURNING", "ON", "UNION", "INTERSECT", "EXCEPT", "MINUS"):
            in_list[-1] = False
        before = word[at - 1] if at else ""
        starts = before in RELATION_AFTER or in_list[-1] and at and kind[at - 1] == ","
        if name[at] is not None and starts and (in_list[-1] or before not in ("ON", "USING", "ONLY")) and word[at] not in NO_ALIAS:
            end = at
            while end + 2 < len(spans) and kind[end + 1] == "." and name[end + 2] is not None:
                end += 2
            if end > at:
                related.add(at)
            if in_list[-1]:
                alias = end + 1 + (end + 1 < len(spans) and word[end + 1] == "AS")
                own = alias < len(spans) and name[alias] is not None and word[alias] not in NO_ALIAS
                scope.names.add(name[alias] if own else name[end])
            scope_of += [scope] * (end - at)
            at = end
        at += 1
    out, last = [], 0
    for i, (k, a, b) in enumerate(spans):
        if k == "quote" and mode == "postgres" and definition[a] == "'" and _REGCLASS.match(definition, b):
            found = _QUALIFIED.match(definition, a + 1, b)
            if found and fold(found.group(1)) == owner:
                out.append(definition[last : a + 1])
                last = found.end()
        if name[i] != owner or i + 2 >= len(spans) or kind[i + 1] != "." or name[i + 2] is None or i and kind[i - 1] == ".":
            continue
        if i not in related and scope_of[i].knows(owner):
            if i + 3 < len(spans) and kind[i + 3] == "(":
                return None
            continue
        out.append(definition[last:a])
        last = spans[i + 2][1]
    return "".join(out) + definition[last:]


def without_owner_column(definition: Column, owner: Column, mode: str = "postgres") -> Column:
    return F.pandas_udf(lambda d, o: pd.Series([without_owner(x, y, mode) for x, y in zip(d, o, strict=True)], dtype=object), "string")(definition, owner)
