"""Text expressions: tokens, white space, scores, budgets, secrets, keywords."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import vocabulary as V

BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"
NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"
NOT_BLANK = r"[^\s\p{Z}\x1c-\x1f\x85]"
#: All white space but the space, and some marks beside it: a class that is tested fast.
MAYBE_BLANK = r"[\t-\r\x1c-\x1f\x85\xa0\x{1680}-\x{3000}]"
#: Anything but characters that composition leaves as they are, whatever stands beside them.
COMPOSABLE = "[^\\x00-\\x{2ff}\\x{400}-\\x{482}\\x{48a}-\\x{52f}\\x{2002}-\\x{20cf}\\x{3000}-\\x{3029}\\x{3041}-\\x{3098}\\x{309b}-\\x{30ff}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7a3}\\x{ff01}-\\x{ffef}]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; even texts are left as they are after one test."""
    uneven = c.rlike(MAYBE_BLANK) | c.contains("  ") | c.startswith(" ") | c.endswith(" ")
    return F.when(uneven, F.regexp_replace(F.regexp_replace(c, BLANK, " "), "^ | $", "")).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and private-use characters."""
    return F.filter(F.split(F.lower(c), NOT_TOKEN), lambda t: t != "")


def token_text(c: Column) -> Column:
    """The tokens of a text with one space before, between and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), NOT_TOKEN, " ")), F.lit(" "))


def _where_found(c: Column, marks: list[str], work) -> Column:
    """A Python function of texts, which only rows that hold each of ``marks``, the quickest first, go through."""
    plain = ~reduce(lambda a, b: a & b, [c.rlike(m) for m in marks])
    return F.when(plain, c).otherwise(F.pandas_udf(work, "string")(F.when(~plain, c)))


def nfc(c: Column) -> Column:
    """Canonical composition; rows without anything to compose reach Python as nulls."""
    def compose(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return _where_found(c, [r"[^\x00-\x{2ff}]", COMPOSABLE], compose)


def strip_accents(c: Column) -> Column:
    """Letters without their combining marks, by full decomposition."""
    def strip(s):
        return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch)))

    return _where_found(c, ["[^\x00-\x7f]"], strip)


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, their letters, and last the marks themselves."""
    letters, bare, marks = [], [], []
    for code in range(0xC0, 0x2000):
        parts = [x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x)]
        if not parts:
            marks.append(chr(code))
        elif len(parts) == 1 and parts[0] != chr(code):
            letters.append(chr(code))
            bare.append(parts[0])
    return "".join(letters + marks), "".join(bare)


def fold_accents(c: Column) -> Column:
    """Accented letters as their plain ones and marks dropped, inside the JVM."""
    return F.translate(c, *_accents())


def normalize_text(c: Column, composed: bool = False) -> Column:
    """NFC, then every run of white space as one space."""
    return collapse(c if composed else nfc(c))


def normalize_query(c: Column) -> Column:
    return F.lower(collapse(c))


def lines(c: Column) -> Column:
    """Lines as text files have them; an empty last line does not count."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lexical_score(text: Column, query: list[str]) -> Column:
    """Whole-word occurrences of the query's words, repeats included, to a million."""
    words = F.split(F.lower(text), r"\s+")


    def hits(q: str) -> Column:
        return F.size(F.filter(words, lambda w: w == q))

    return F.least(F.lit(1_000_000.0), sum(map(hits, query), F.lit(0)).cast("double"))


def estimate_tokens(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def summary(c: Column, cap: int = 280) -> Column:
    return F.left(c, F.lit(cap))


# Role marks that a field may not carry, and the gap that breaks them.
ROLE_MARKS = ("role=system", "role=developer", "role=user", "role:system", "role:developer")
GAP = "\u200b"


def escape_field(c: Column, cap: int = 2000) -> Column:
    """One line of data: no controls, role marks, rules or ellipses; nothing is an empty text."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\x00\r]", ""), "[\n\t]", " ")
    for mark in ROLE_MARKS:
        name, value = mark[:4], mark[5:]
        out = F.replace(out, F.lit(mark), F.lit(f"{name}{GAP}{mark[4]}{GAP}{value} (data)"))
    return F.left(F.replace(F.replace(out, F.lit("---"), F.lit("—")), F.lit("..."), F.lit("…")), F.lit(cap))


def escape_summary(c: Column) -> Column:
    """A field under the cap of summaries."""
    return F.left(escape_field(c), F.lit(280))


def escape_inline(c: Column, cap: int = 2000) -> Column:
    """Text that no Markdown or HTML reader takes for more than text, on one line; nothing is ``(none)``.

    A text of letters, digits and harmless marks is left as it is after one test.
    """
    plain = c.rlike(r"\A[A-Za-z0-9.:,;/@%+=?()-]+\z") & (F.length(c) <= cap)
    flat = collapse(F.regexp_replace(F.regexp_replace(c, "[\n\r\t]", " "), "[\x00-\x1f\x7f]", ""))
    data = F.left(flat, F.lit(cap))
    for mark, entity in (("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        data = F.replace(data, F.lit(mark), F.lit(entity))
    data = F.regexp_replace(data, r"([\[\]|#`*_!$~^{}])", r"\\$1")
    return F.when(plain, c).when(F.coalesce(flat, F.lit("")) == "", "(none)").otherwise(F.when(F.length(flat) > cap, F.concat(data, F.lit("…[truncated]"))).otherwise(data))


def yaml_scalar(c: Column, cap: int = 2000) -> Column:
    """A text as a quoted YAML scalar; null is ``null``."""
    plain = c.rlike(r"\A[ !#-\[\]-~]*\z") & (F.length(c) <= cap)
    out = F.left(c, F.lit(cap))
    for mark, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    rare = out
    for code in [*range(0x20), 0x7F]:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    out = F.when(out.rlike("[\x00-\x1f\x7f]"), rare).otherwise(out)
    out = F.when(plain, c).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def yaml_list(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: yaml_scalar(x)), ", "), F.lit("]")), F.lit("[]"))


def safe_link_display(c: Column, fallback: Column, cap: int = 120) -> Column:
    """A label of plain characters only, or else the fallback."""
    safe = c.rlike(r"^[A-Za-z0-9._:/ -]+\z") & (c == F.trim(c)) & (F.length(c) <= cap) & ~c.contains("..")
    return F.when(F.coalesce(safe, F.lit(False)), c).otherwise(fallback)


def secret_rule(c: Column) -> Column:
    """The first secret rule that a text breaks, or null."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for name, p in V.SECRET_RULES])


def redact(c: Column) -> Column:
    """The text, or one marker in its place if it holds a secret."""
    rule = secret_rule(c)
    return F.when(rule.isNotNull(), F.concat(F.lit("[REDACTED:"), rule, F.lit("]"))).otherwise(c)


def field_rule(key: Column) -> Column:
    """The rule that a field's name alone calls for."""
    k = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return F.coalesce(*[F.when(k.rlike(rf"(?s)\A({pattern})\z"), F.lit(rule)) for rule, pattern in V.FIELD_RULES])


def garbage_share(c: Column) -> Column:
    """Share of control and replacement characters."""
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.regexp_replace(c, "[\x00-\x08\x0e-\x1f\x7f�]", ""))) / F.length(c)).otherwise(0.0)


def slug(c: Column, cap: int = 60) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(cap))


def keywords(c: Column, shortest: int = 3) -> Column:
    """Lower-cased identifier-like words that are long enough and no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z][A-Za-z0-9_-]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= shortest) & ~t.isin(V.STOPWORDS))


def link_list(c: Column) -> Column:
    """Ids of a JSON list or a comma list: trimmed, distinct, none empty."""
    items = F.coalesce(F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")), F.split(c, ","))
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def safe_reference(c: Column) -> Column:
    """References that name no absolute path, climb out of a folder, or carry a secret."""
    path = c.rlike(r"^([/\\~]|[A-Za-z]:)") | c.contains("..") | c.contains("\\")
    return c.isNotNull() & (F.trim(c) != "") & ~path & secret_rule(c).isNull()
