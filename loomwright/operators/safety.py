"""What a statement does, and what is risky in it, by a stack of scopes over its words."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexing import tokens

# First words by kind of statement.
READ = "SELECT SHOW DESCRIBE DESC VALUES TABLE EXPLAIN".split()
WRITE = "INSERT UPDATE DELETE MERGE UPSERT REPLACE CALL DO EXEC EXECUTE DECLARE".split()
DDL = "CREATE ALTER DROP TRUNCATE COMMENT GRANT REVOKE RENAME".split()
TRANSACTION = "BEGIN START COMMIT ROLLBACK SET SAVEPOINT RELEASE".split()
# Commands that EXPLAIN and WITH can have, and how many scopes of WITH are looked at.
EXPLAINED = "SELECT INSERT UPDATE DELETE MERGE WITH VALUES TABLE EXECUTE EXEC CALL DO DECLARE CREATE".split()
COMMANDS = "SELECT INSERT UPDATE DELETE MERGE".split()
SCOPES = 64

_KINDS = {w: k for k, words in (("READ", READ), ("WRITE", WRITE), ("DDL", DDL), ("TRANSACTION_CONTROL", TRANSACTION)) for w in words}


@dataclass
class Scope:
    """A level of parentheses. body: it is what a name of a WITH stands for; owed: names without a body so far."""

    body: bool = False
    first: str = ""
    command: str = ""
    has_with: bool = False
    names: int = 0
    owed: bool = False
    lacking: int = 0
    where: bool = False
    explains: bool = False
    ends: bool = False

    def take(self, word: str) -> None:
        self.ends |= word == "END"
        self.where |= word == "WHERE" and bool(self.command)
        if not self.first:
            self.first, self.has_with, self.explains = word, word == "WITH", word == "EXPLAIN" and not self.body
            self.command = "" if self.has_with or self.explains else word
        elif self.command:
            return
        elif self.explains and not self.has_with:
            self.has_with, self.command = word == "WITH", word if word in EXPLAINED and word != "WITH" else ""
        elif self.has_with and word in COMMANDS:
            self.command = word
            self.lacking += self.owed
            self.owed = False
        elif self.has_with and word == "AS":
            self.lacking += self.owed
            self.names, self.owed = self.names + 1, True


def judge(sql: str | None, mode: str = "postgres") -> tuple[str, str, list[str]]:
    """(first word, kind, risks) of one statement. Each command of a WITH is judged in its own scope: a WHERE elsewhere is none
    of its own, and a command that isn't known there, or none at all, makes the statement unknown."""
    stack, words, others, broken, analyze, scopes = [Scope()], [], 0, False, False, 0
    found = set()

    def close(scope: Scope) -> None:
        nonlocal scopes
        if scope.has_with:
            scopes += 1
            if not scope.command or not scope.names or scope.lacking or scope.owed or scopes > SCOPES:
                found.update(("unknown", "MISSING_WHERE"))
        elif not scope.first:
            found.update(("unknown", "MISSING_WHERE"))
        if scope.command:
            kind = _KINDS.get(scope.command)
            found.add({"READ": "read", "WRITE": "write"}.get(kind, "unknown"))
            if scope.command in ("UPDATE", "DELETE") and not scope.where:
                found.add("MISSING_WHERE")

    for kind, a, b in tokens(sql or "", mode):
        top = stack[-1]
        if kind == "word":
            word = sql[a:b].upper()
            words.append(word)
            analyze |= word == "ANALYZE"
            top.take(word)
        elif kind == "(":
            inner = Scope(body=top.owed or top.body and not top.first)
            # Parentheses around a whole body hand it on.
            top.body, top.owed = top.body and bool(top.first), False
            stack.append(inner)
        elif kind == ")" and len(stack) > 1:
            if stack.pop().body:
                close(top)
        broken |= kind == "broken"
        others += kind not in ("word", "space", "comment", "broken")
    while len(stack) > 1:
        if (top := stack.pop()).body:
            close(top)
    root = stack[0]
    command = root.command or ("WITH" if root.has_with else "" if analyze or not root.explains else "EXPLAIN")
    kind = _KINDS.get(command, "UNKNOWN")
    if mode == "oracle" and command == "BEGIN" and root.ends:
        kind = "WRITE"
    risks = set()
    if root.has_with:
        close(root)
        kind = "WRITE" if "write" in found else "UNKNOWN" if "unknown" in found else kind
        risks |= found & {"MISSING_WHERE"}
    if command in ("UPDATE", "DELETE") and not root.where:
        risks.add("MISSING_WHERE")
    if command in ("DROP", "TRUNCATE"):
        risks.add("DESTRUCTIVE_DDL")
    if kind == "UNKNOWN":
        risks.add("UNKNOWN_STATEMENT")
    if kind == "TRANSACTION_CONTROL" and (broken or others or words not in (["COMMIT"], ["ROLLBACK"])):
        risks.add("SESSION_STATE_CONFLICT")
    return root.first, kind, sorted(risks)


def judged(sql: Column, mode: str) -> Column:
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(x, mode) for x in texts], columns=["first_word", "kind", "risks"])

    return F.pandas_udf(told, "first_word string, kind string, risks array<string>")(sql)
