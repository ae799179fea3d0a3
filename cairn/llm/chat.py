"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output, one conversation after another::

    conversation = turn*
    turn         = "[INST]" flag role "[/INST]" body "</s>"
    flag         = "="   role and body stand as they are
                 | "~"   role and body are escaped

The parser is deterministic: it cuts at ``</s>`` and takes the first ``[/INST]``
of each part.  Every turn is first rendered as it is and reparsed; where role or
text do not come back identical, or hold a control string, the turn is rendered
escaped.  At last the whole conversation is reparsed and compared with its
source; if it differs still, all its turns are escaped, and an error is raised
if even that does not come back.

Escaping doubles backslashes and breaks each control string by a backslash
behind its first character; dropping one backslash before any character undoes
both.

Defined cases: a null text or role is empty; turns of equal number are ordered
by role and text; a null turn number comes first; rows with a null conversation
id form one conversation; repeated rows are turns of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template family.
BEGIN, ROLE_END, TURN_END = "[INST]", "[/INST]", "</s>"
CONTROL = r"(\[(?=/?INST\])|<(?=/?s>|</?SYS>>))"
_TURN = r"(?s)\A\[INST\]([=~])(.*?)\[/INST\](.*)\z"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _render(flag: str, role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN + flag), role, F.lit(ROLE_END), text, F.lit(TURN_END))


def parse_turn(part: Column) -> Column:
    """Role and text of one turn without its end mark."""
    flag, role, body = (F.regexp_extract(part, _TURN, i) for i in (1, 2, 3))
    back = lambda c: F.when(flag == "~", unescape(c)).otherwise(c)
    return F.struct(back(role).alias("role"), back(body).alias("text"))


def parse(formatted: Column) -> Column:
    """All turns of a formatted conversation."""
    parts = F.split(formatted, TURN_END, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), parse_turn)


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, loss_mask, parsed``.

    ``loss_mask`` is a run-length mask over the characters of ``formatted``, true
    under assistant bodies; ``parsed`` holds the turns read back from it.
    """
    blank = F.lit("")
    turns = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    plain = _render("=", F.col("role"), F.col("text"))
    parts = F.split(plain, TURN_END, -1)
    back = parse_turn(F.element_at(parts, 1))
    clear = ~F.col("text").rlike(CONTROL) & ~F.col("role").rlike(CONTROL)
    same = clear & (F.size(parts) == 2) & (back["role"] == F.col("role")) & (back["text"] == F.col("text"))
    safe = _render("~", escape(F.col("role")), escape(F.col("text")))
    body = lambda flagged: F.length(F.when(flagged, F.col("text")).otherwise(escape(F.col("text"))))
    turns = turns.withColumn("same", same).withColumns({"out": F.when(F.col("same"), plain).otherwise(safe), "safe": safe, "chars": body(F.col("same")), "safe_chars": body(F.lit(False))})
    turn = F.struct("turn", "role", "text", "out", "safe", "chars", "safe_chars")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    joined = lambda field: F.array_join(F.transform("turns", lambda t: t[field]), "")
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = grouped.select("conv_id", "turns", source.alias("source"), joined("out").alias("first"))
    first = first.withColumn("whole", parse(F.col("first")) == F.col("source"))
    done = first.withColumn("formatted", F.when(F.col("whole"), F.col("first")).otherwise(joined("safe")))
    done = done.withColumn("parsed", parse(F.col("formatted")))
    checked = F.when(F.col("parsed") == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back to its source")))
    run = lambda n, loss: F.struct(n.cast("long").alias("chars"), loss.alias("loss"))

    def runs(t: Column) -> Column:
        chars = F.when(F.col("whole"), t["chars"]).otherwise(t["safe_chars"])
        size = F.length(F.when(F.col("whole"), t["out"]).otherwise(t["safe"]))
        end = len(TURN_END)
        return F.array(run(size - chars - end, F.lit(False)), run(chars, t["role"] == "assistant"), run(F.lit(end), F.lit(False)))

    return done.select("conv_id", checked.alias("formatted"), F.flatten(F.transform("turns", runs)).alias("loss_mask"), "parsed")


def digest(formatted: DataFrame) -> DataFrame:
    """Figures read back from the output alone, the loss text by the runs of its mask.

    Every turn has three runs (marks and role, body, end); runs that do not cover
    it exactly are an error.
    """
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = F.split("formatted", TURN_END, -1)

    def masked(part: Column, i: Column) -> Column:
        whole, runs, at, cut = F.concat(part, F.lit(TURN_END)), [F.get("loss_mask", i * 3 + n) for n in range(3)], F.lit(0), []
        for r in runs:
            cut.append(F.when(r["loss"], whole.substr((at + 1).cast("int"), r["chars"].cast("int"))).otherwise(""))
            at = at + r["chars"]
        told = F.concat(*cut)
        back = F.when(part.startswith(BEGIN + "~"), unescape(told)).otherwise(told)
        return F.when(at == F.length(whole), back).otherwise(F.raise_error(F.lit("a loss mask does not cover its conversation")))

    n = F.size(parts) - 1
    loss = F.array_join(F.transform(F.slice(parts, F.lit(1), n), masked), "")
    loss = F.when(F.size("loss_mask") == 3 * n, loss).otherwise(F.raise_error(F.lit("a loss mask does not cover its conversation")))
    return formatted.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
