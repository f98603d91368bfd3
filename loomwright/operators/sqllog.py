"""Statement logs: history, statements of scripts, their kinds and risks, and command lines. Statements are cut into tokens and
scopes; none is parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexing
from . import safety

# Commands that need a confirmation, and those that a console can't run.
CONFIRM = "FLUSHALL FLUSHDB SHUTDOWN DEBUG".split()
BLOCKED = "SUBSCRIBE PSUBSCRIBE MONITOR BLPOP BRPOP BRPOPLPUSH BLMOVE BZPOPMIN BZPOPMAX WAIT".split()

def blanked(sql: Column, mode: str = "postgres", keep_names: bool = False) -> Column:
    """The text with comments as a space and quoted texts as ''; quoted names as x, or, if asked for, as they are."""
    return lexing.blank_column(sql, mode, keep_names)


def dedupe_history(history: DataFrame, keep: int = 200, per: list[str] | None = None) -> DataFrame:
    """history (ts, sql, ...) with each statement once, at its newest, newest first; `keep` of them, in all or for each of `per`."""
    rows = history.withColumn("sql", F.trim("sql")).where("sql <> ''")
    rest = [c for c in rows.columns if c != "sql" and c not in (per or [])]
    newest = rows.groupBy(*(per or []), "sql").agg(F.max_by(F.struct(*rest), F.struct("ts", *(c for c in rest if c != "ts"))).alias("r")).select(*(per or []), "sql", "r.*")
    if not per:
        return newest.orderBy(F.desc("ts"), "sql").limit(keep).select(*history.columns)
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("ts"), "sql"))
    return newest.withColumn("place", place).where(F.col("place") <= keep).select(*history.columns)


def split_statements(scripts: DataFrame, mode: str = "postgres") -> DataFrame:
    """(columns of scripts but script, idx, sql): the statements of each script, from 1 on. Semicolons in quotes, comments (which nest to
    any depth) and dollar blocks don't end one; pieces of comments alone are left out, what is broken stays. In oracle mode a line
    with a slash alone ends one, too, and inside a block only that does. A null script has none."""
    rest = [c for c in scripts.columns if c != "script"]
    pieces = scripts.select(*rest, F.posexplode(lexing.split_column(F.col("script"), mode)).alias("idx", "sql"))
    return pieces.select(*rest, (F.col("idx") + 1).alias("idx"), "sql")


def classify_statements(statements: DataFrame, mode: str = "postgres", script: str = "script_id") -> DataFrame:
    """statements with first_word, kind and risks. Each command of a WITH or EXPLAIN is judged in its own scope, and the statement counts as
    the strongest of them; UPDATE and DELETE without a WHERE of their own, DROP and TRUNCATE, unknown commands, and transaction
    commands among other statements or with more than their one word are risks."""
    out = statements.withColumn("__told", safety.judged(F.col("sql"), mode))
    out = out.withColumns({"first_word": F.col("__told.first_word"), "kind": F.col("__told.kind"), "risks": F.col("__told.risks")}).drop("__told")
    several = F.count("*").over(Window.partitionBy(script)) > 1
    conflict = F.array("risks", F.when((F.col("kind") == "TRANSACTION_CONTROL") & several, F.array(F.lit("SESSION_STATE_CONFLICT"))).otherwise(F.expr("cast(array() as array<string>)")))
    return out.withColumn("risks", F.array_sort(F.array_distinct(F.flatten(conflict))))


def policy_decision(classified: DataFrame, script: str = "script_id") -> DataFrame:
    """(script, decision, relevant): blocked, confirm or allow for each script, and the numbers of the statements that
    decide it. classified has environment and read_only for each statement."""
    has = lambda r: F.array_contains("risks", r)
    conflict = has("SESSION_STATE_CONFLICT")
    ends = (F.col("kind") == "TRANSACTION_CONTROL") & ~conflict & F.col("first_word").isin("COMMIT", "ROLLBACK")
    blocks = conflict | (F.col("read_only") & (F.col("kind") != "READ") & ~ends)
    asks = has("MISSING_WHERE") | has("DESTRUCTIVE_DDL") | ((F.col("environment") == "PRODUCTION") & F.col("kind").isin("WRITE", "DDL", "UNKNOWN"))
    rows = classified.groupBy(script).agg(F.sort_array(F.collect_list(F.when(blocks, F.col("idx")))).alias("b"), F.sort_array(F.collect_list(F.when(asks, F.col("idx")))).alias("a"))
    return rows.select(script, F.when(F.size("b") > 0, "blocked").when(F.size("a") > 0, "confirm").otherwise("allow").alias("decision"), F.when(F.size("b") > 0, F.col("b")).otherwise(F.col("a")).alias("relevant"))


def single_source_table(statements: DataFrame) -> DataFrame:
    """statements with source_table: the table of a SELECT from one table, with an optional alias, else null."""
    text = F.trim(F.regexp_replace(blanked(F.col("sql"), "postgres", keep_names=True), r"\s+", " "))
    name = r'(?:"(?:""|[^"])+"|[\w$#]+)'
    pattern = rf"(?i)^SELECT (?:(?!\bFROM\b)[^()]|\([^()]*\))*?\bFROM ({name}(?: ?\. ?{name})?)(?: (?:AS )?(?!WHERE|GROUP|HAVING|ORDER|LIMIT|OFFSET|FETCH|FOR|WINDOW|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|UNION|INTERSECT|EXCEPT|MINUS){name})?(?: (?:WHERE|GROUP|HAVING|ORDER|LIMIT|OFFSET|FETCH|FOR|WINDOW)\b.*)? ?;?$"
    found = F.regexp_extract(text, pattern, 1)
    several = text.rlike(r"(?i)\b(?:UNION|INTERSECT|EXCEPT|MINUS)\b")
    return statements.withColumn("source_table", F.when((found != "") & ~several, found))


def audit_commands(lines: DataFrame) -> DataFrame:
    """lines (line, ...) with tokens, error and policy: NORMAL, CONFIRM or BLOCKED by the command. A quote that isn't closed,
    or a backslash at the end, is an error."""
    token = r"""(?:\\.|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^\s'"\\])+"""
    broken = F.regexp_replace("line", "(?s)" + token, "").rlike(r"\S")
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, r"""(?s)(\\.)|['"]""", "$1"), r"(?s)\\(.)", "$1")
    rows = lines.withColumn("error", F.when(broken, "UNCLOSED")).withColumn("tokens", F.when(~broken, F.transform(F.regexp_extract_all("line", F.lit("(?s)" + token), F.lit(0)), strip)))
    words = F.transform("tokens", lambda t: F.upper(t))
    first = F.get(words, F.lit(0))
    blocked = first.isin(*BLOCKED) | ((first == "XREAD") & F.array_contains(words, "BLOCK"))
    confirm = first.isin(*CONFIRM) | ((first == "CONFIG") & (F.get(words, F.lit(1)) == "SET"))
    return rows.withColumn("policy", F.when(blocked, "BLOCKED").when(confirm, "CONFIRM").otherwise("NORMAL"))
