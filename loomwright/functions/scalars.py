"""Column functions. All are built-in expressions, so they run inside generated code; only normalize_definition scans texts in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexing import ends_open_column

NUMERIC = ("tinyint", "smallint", "integer", "bigint", "decimal", "numeric", "real", "float", "double")
TEXT = ("char", "varchar", "longvarchar", "nchar", "nvarchar", "clob", "nclob")
#: Spark types of coerced values by type name; a name that is missing here passes its text through.
COERCED = {t: "decimal(38,10)" for t in NUMERIC} | {"boolean": "boolean", "bit": "boolean", "date": "date", "time": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp"}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _blank(c: Column) -> Column:
    return F.trim(F.translate(c, "\t\n\r\f", "    ")) == ""


def normalize_timestamp(col: Column | str) -> Column:
    """A text without a space gets midnight as its time."""
    c = _c(col)
    return F.when(F.instr(c, " ") == 0, F.concat(c, F.lit(" 00:00:00"))).otherwise(c)


def parse_bool(col: Column | str) -> Column:
    """true, t, 1, yes, y and false, f, 0, no, n in any case; null for other texts."""
    return F.trim(_c(col)).try_cast("boolean")


def coerce_text(col: Column | str, kind: str) -> Column:
    """The text as a value of the type: null stays null, a blank text is null unless the type holds texts, and a text
    that doesn't parse is null (coerce_error tells that case)."""
    c = _c(col)
    if kind not in COERCED:
        return c
    trimmed = F.trim(c)
    if kind in ("boolean", "bit"):
        value = parse_bool(c)
    elif kind == "time":
        value = F.when(trimmed.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}$"), trimmed)
    elif kind.startswith("timestamp"):
        value = normalize_timestamp(trimmed).try_cast(COERCED[kind])
    elif kind == "date":
        value = F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), trimmed).try_cast("date")
    else:
        value = trimmed.try_cast(COERCED[kind])
    return F.when(c.isNull() | _blank(c), F.lit(None)).otherwise(value)


def coerce_error(col: Column | str, kind: str) -> Column:
    """Whether the text is neither null nor blank and doesn't parse as the type."""
    c = _c(col)
    return F.lit(False) if kind not in COERCED else F.coalesce(~_blank(c) & coerce_text(c, kind).isNull(), F.lit(False))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(col: Column | str, dtype: str, dialect: str = "generic") -> Column:
    """A value of the Spark type dtype as SQL text of a dialect: postgres, oracle or generic."""
    c = _c(col)
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        text = c.cast("string")
    elif dtype == "boolean":
        text = F.when(c, "1" if dialect == "oracle" else "TRUE").otherwise("0" if dialect == "oracle" else "FALSE")
    elif dtype == "binary" and dialect != "generic":
        text = F.concat(F.lit("'\\x" if dialect == "postgres" else "HEXTORAW('"), F.lower(F.hex(c)), F.lit("'" if dialect == "postgres" else "')"))
    elif dtype.startswith("timestamp") and dialect == "oracle":
        # The fraction has nine digits at most, without trailing zeros, one at least.
        fraction = F.regexp_replace(F.date_format(c, "SSSSSS"), "0{1,5}$", "")
        text = F.concat(F.lit("TO_TIMESTAMP('"), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("."), fraction, F.lit("', 'YYYY-MM-DD HH24:MI:SS.FF')"))
    elif dtype == "date" and dialect == "oracle":
        text = F.concat(F.lit("TO_DATE('"), F.date_format(c, "yyyy-MM-dd"), F.lit("', 'YYYY-MM-DD')"))
    else:
        text = _quoted(c.cast("string"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def escape_dump_string(col: Column | str) -> Column:
    """A quoted text of a dump: backslashes and quotes doubled, line breaks and tabs as two characters, NULs gone."""
    c = _c(col)
    for old, new in (("\\", "\\\\"), ("'", "''"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.when(_c(col).isNull(), "NULL").otherwise(F.concat(F.lit("'"), c, F.lit("'")))


def unescape_dump_string(col: Column | str) -> Column:
    """The text of a quoted dump string; NULL is null. Double backslashes are set aside first, so that the others are read left to right."""
    c = _c(col)
    inner = F.replace(F.substring(c, 2, F.length(c) - 2), F.lit("''"), F.lit("'"))
    inner = F.replace(inner, F.lit("\\\\"), F.lit("\0"))
    for old, new in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\0", "\\")):
        inner = F.replace(inner, F.lit(old), F.lit(new))
    return F.when(c.startswith("'"), inner)


def migration_literal(col: Column | str, dtype: str, kind: str, precision: int = 0, scale: int = 0, as_bool: bool = False, most_text: int | None = None, most_bytes: int | None = None) -> Column:
    """A value as text of a migration dump, by its source type. Where limits are given, a CLOB is cut to most_text characters
    and a BLOB of more than most_bytes is NULL; by default both are whole."""
    c = _c(col)
    if kind in ("VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR"):
        return escape_dump_string(c.cast("string"))
    if kind == "NUMBER" and precision == 1 and scale == 0 and as_bool:
        text = F.when(c.cast("int") == 0, "FALSE").otherwise("TRUE")
    elif kind in ("NUMBER", "INTEGER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE"):
        text = c.cast("string")
    elif kind in ("DATE", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE"):
        text = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    elif kind in ("CLOB", "NCLOB"):
        return escape_dump_string(F.left(c.cast("string"), F.lit(most_text)) if most_text is not None else c.cast("string"))
    elif kind in ("BLOB", "RAW"):
        if dtype != "binary":
            return F.lit("NULL")
        text = F.concat(F.lit("'\\x"), F.lower(F.hex(c)), F.lit("'::bytea"))
        text = text if most_bytes is None else F.when(F.octet_length(c) <= most_bytes, text)
    else:
        return escape_dump_string(c.cast("string"))
    return F.coalesce(text, F.lit("NULL"))


def quote_ident(col: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(_c(col), F.lit('"'), F.lit('""')), F.lit('"'))


def quote_if_needed(col: Column | str) -> Column:
    """Names of letters, digits, _ $ # that begin with a letter or _ stay bare; null and empty names are an empty quoted one."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(c.rlike(r"^[\p{L}_][\p{L}\p{Nd}_$#]*$"), c).otherwise(quote_ident(c))


def fold_ident(col: Column | str, dialect: str = "postgres") -> Column:
    return F.upper(_c(col)) if dialect == "oracle" else F.lower(_c(col))


def qualify(schema: Column | str, name: Column | str) -> Column:
    s = _c(schema)
    return F.when(s.isNull() | (s == ""), quote_ident(name)).otherwise(F.concat(quote_ident(s), F.lit("."), quote_ident(name)))


def convert_type(kind: Column | str, length: Column | str, precision: Column | str, scale: Column | str) -> Column:
    """The target's type text of a source column type; unknown names pass."""
    k, p, s = _c(kind), F.coalesce(_c(precision), F.lit(0)), F.coalesce(_c(scale), F.lit(0))
    size = F.concat(F.lit("("), F.coalesce(_c(length), F.lit(0)).cast("string"), F.lit(")"))
    number = F.when((p == 0) & (s == 0), "NUMERIC").when(s > 0, F.format_string("NUMERIC(%d,%d)", p, s)).otherwise(F.format_string("NUMERIC(%d)", p))
    out = F.when(k.isin("VARCHAR2", "NVARCHAR2"), F.concat(F.lit("VARCHAR"), size)).when(k.isin("CHAR", "NCHAR"), F.concat(F.lit("CHAR"), size)).when(k == "NUMBER", number)
    # Source types and their targets.
    for target, names in (("DOUBLE PRECISION", ("FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE")), ("TIMESTAMP", ("DATE",)), ("TIMESTAMPTZ", ("TIMESTAMP WITH TIME ZONE",)), ("TEXT", ("CLOB", "NCLOB", "LONG")), ("BYTEA", ("BLOB", "RAW", "LONG RAW")), ("VARCHAR(18)", ("ROWID",)), ("XML", ("XMLTYPE",))):
        out = out.when(k.isin(*names), target)
    return out.otherwise(k)


def convert_default(col: Column | str) -> Column:
    c = _c(col)
    return F.when(F.upper(c).isin("SYSDATE", "SYSTIMESTAMP"), "CURRENT_TIMESTAMP").when(c.startswith("SYS_GUID()"), "gen_random_uuid()").otherwise(c)


def is_bool_comment(col: Column | str) -> Column:
    c, low = _c(col), F.lower(_c(col))
    found = (c.contains("是") & c.contains("否")) | (low.contains("true") & low.contains("false")) | (low.contains("yes") & low.contains("no")) | low.contains("y/n") | low.contains("y\\n")
    return F.coalesce(found, F.lit(False))


def escape_comment(col: Column | str) -> Column:
    return F.coalesce(F.replace(F.replace(_c(col), F.lit("*/"), F.lit("* /")), F.lit("/*"), F.lit("/ *")), F.lit(""))


def csv_field(col: Column | str) -> Column:
    c = _c(col).cast("string")
    return F.coalesce(F.when(c.rlike('[,"\n\r]'), quote_ident(c)).otherwise(c), F.lit(""))


def html_escape(col: Column | str) -> Column:
    c = _c(col).cast("string")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def xml_escape(col: Column | str) -> Column:
    return html_escape(F.regexp_replace(_c(col).cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def xml_name(name: str | None) -> str:
    """A legal element name: other characters become _."""
    if not name:
        return "COLUMN"
    return "".join(c if c == "_" or c.isalpha() or (i and (c.isalnum() or c in "-.")) else "_" for i, c in enumerate(name))


def cell_ref(column: int, row: Column | int) -> Column:
    """A1-style reference of a 0-based column."""
    letters, n = "", column
    while n >= 0:
        letters, n = chr(ord("A") + n % 26) + letters, n // 26 - 1
    return F.concat(F.lit(letters), (row if isinstance(row, Column) else F.lit(row)).cast("string"))


def format_pg_type(base: Column | str, length: Column | str, precision: Column | str, scale: Column | str) -> Column:
    """char and varying types with their length, numeric with precision and scale, others bare."""
    b, p, s = _c(base), _c(precision), _c(scale)
    sized = b.contains("char") & (_c(length) > 0)
    number = F.when(F.coalesce(s, F.lit(0)) > 0, F.format_string("numeric(%d,%d)", p, s)).otherwise(F.format_string("numeric(%d)", p))
    return F.when(sized, F.format_string("%s(%d)", b, _c(length))).when((b == "numeric") & (p > 0), number).otherwise(b)


def normalize_definition(col: Column | str) -> Column:
    """Line breaks as LF, outer white space and one closing semicolon gone. A semicolon that ends the text stays where a quote,
    comment or dollar block is open there."""
    text = F.regexp_replace(F.regexp_replace(_c(col), "\r\n?", "\n"), r"^\s+|\s+$", "")
    closing = text.endswith(";") & ends_open_column(text)
    return F.when(closing, F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - 1), r"\s+$", "")).otherwise(text)


def identity_key(kind: Column | str, schema: Column | str, name: Column | str, dialect: str = "postgres") -> Column:
    """A key that no two different (kind, schema, name) share."""
    parts = [F.coalesce(_c(p), F.lit("")) for p in (kind, schema, name)]
    if dialect == "oracle":
        return F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)))
    return F.concat_ws("\0", *parts)


# Words that Oracle reserves.
ORACLE_RESERVED = "ACCESS ADD ALL ALTER AND ANY AS ASC AUDIT BETWEEN BY CHAR CHECK CLUSTER COLUMN COMMENT COMPRESS CONNECT CREATE CURRENT DATE DECIMAL DEFAULT DELETE DESC DISTINCT DROP ELSE EXCLUSIVE EXISTS FILE FLOAT FOR FROM GRANT GROUP HAVING IDENTIFIED IMMEDIATE IN INCREMENT INDEX INITIAL INSERT INTEGER INTERSECT INTO IS LEVEL LIKE LOCK LONG MAXEXTENTS MINUS MODE MODIFY NOAUDIT NOCOMPRESS NOT NOWAIT NULL NUMBER OF OFFLINE ON ONLINE OPTION OR ORDER PCTFREE PRIOR PUBLIC RAW RENAME RESOURCE REVOKE ROW ROWID ROWNUM ROWS SELECT SESSION SET SHARE SIZE SMALLINT START SUCCESSFUL SYNONYM SYSDATE TABLE THEN TO TRIGGER UID UNION UNIQUE UPDATE USER VALIDATE VALUES VARCHAR VARCHAR2 VIEW WHENEVER WHERE WITH".split()


def needs_quoting(name: Column | str, dialect: str = "postgres") -> Column:
    c = _c(name)
    if dialect == "oracle":
        return ~c.rlike("^[A-Z][A-Z0-9_$#]*$") | c.isin(*ORACLE_RESERVED)
    return ~c.rlike("^[a-z_][a-z0-9_$]*$")


def printable(col: Column | str) -> Column:
    """Whether bytes are UTF-8 without control characters but CR, LF and tab."""
    c = _c(col)
    return F.expr("true") & F.call_function("is_valid_utf8", c.cast("string")) & ~F.call_function("make_valid_utf8", c.cast("string")).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")


def display(col: Column | str) -> Column:
    c = _c(col)
    return F.when(printable(c), c.cast("string")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(c))))


def canonical_hash(domain: str, *cols: Column | str) -> Column:
    """SHA-256 over the domain and the columns, each as its four-byte length and its UTF-8."""
    fields = [F.lit(domain), *(F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols)]
    parts = [x for f in fields for x in (F.unhex(F.lpad(F.hex(F.octet_length(f)), 8, "0")), F.encode(f, "UTF-8"))]
    return F.sha2(F.concat(*parts), 256)
