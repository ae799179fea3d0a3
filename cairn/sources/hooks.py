"""Host hooks as events: class, type, source and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import canonical_object, plain_json_text

# The closed registry of hooks and the class of each.
CLASSES = {
    "on_session_start": "session_lifecycle",
    "on_session_end": "session_lifecycle",
    "on_session_finalize": "session_lifecycle",
    "on_session_reset": "session_lifecycle",
    "pre_tool_call": "pre_tool_call",
    "post_tool_call": "post_tool_call",
    "pre_llm_call": "llm_api_lifecycle",
    "post_llm_call": "llm_api_lifecycle",
    "on_skill_lifecycle": "skill_lifecycle",
    "subagent_start": "subagent_lifecycle",
    "subagent_stop": "subagent_lifecycle",
    "kanban_task_claimed": "verified_task_or_kanban_lifecycle",
    "kanban_task_completed": "verified_task_or_kanban_lifecycle",
    "kanban_task_blocked": "verified_task_or_kanban_lifecycle",
}
PUBLIC = ("public_user_message", "public_assistant_message", "public_tool_call")
CONDITIONAL = ("pre_api_request", "post_api_request", "api_request_error")
FIELDS = "event_id session_id turn_id tool_call_id request_id trace_id child_subagent_id child_session_id parent_session_id skill_name action use_count task_id run_id".split()


def _stable(hook: Column) -> Column:
    """Canonical JSON of the identifiers that a retry repeats, or null."""
    c = F.col
    has = lambda *names: F.expr(" AND ".join(f"coalesce({n}, '') <> ''" for n in names))
    call, child = F.coalesce(*[F.nullif(c(n), F.lit("")) for n in ("tool_call_id", "request_id", "trace_id")]), F.coalesce(*[F.nullif(c(n), F.lit("")) for n in ("child_subagent_id", "child_session_id")])
    skill = F.concat(F.lit('{"action":'), plain_json_text(c("action")), F.lit(',"session_id":'), plain_json_text(c("session_id")), F.lit(',"skill_name":'), plain_json_text(c("skill_name")), F.lit(',"use_count":'), F.coalesce(c("use_count").cast("string"), F.lit("null")), F.lit("}"))
    return (
        F.when(hook.isin("pre_llm_call", "post_llm_call", "public_user_message", "public_assistant_message") & has("session_id", "turn_id"), canonical_object({"session_id": c("session_id"), "turn_id": c("turn_id")}, True))
        .when(hook.startswith("on_session_") & has("session_id"), canonical_object({"session_id": c("session_id")}, True))
        .when(hook.isin("pre_tool_call", "post_tool_call", "public_tool_call") & call.isNotNull(), canonical_object({"session_id": c("session_id"), "occurrence_id": call}, True))
        .when(hook.isin("subagent_start", "subagent_stop") & child.isNotNull(), canonical_object({"parent_session_id": c("parent_session_id"), "child_id": child}, True))
        .when((hook == "on_skill_lifecycle") & has("session_id", "skill_name", "action"), skill)
        .when(hook.startswith("kanban_") & has("task_id"), canonical_object({"task_id": c("task_id"), "run_id": c("run_id")}, True))
    )


def map_hooks(payloads: DataFrame, host: str = "host") -> DataFrame:
    """Payload rows (``hook`` and any of ``FIELDS``) with status, type, class, source and id.

    An id is the payload's own, else ``observed:{hook}:{digest}`` of identifiers
    (ASCII) that a retry repeats, else a generated one.  Hooks that need a fixture
    or are not supported keep their status and have neither type nor id.
    """
    rows = payloads
    for name in FIELDS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("long" if name == "use_count" else "string"))
    hook = F.col("hook")
    status = F.when(hook.isin(*CLASSES, *PUBLIC), "mapped").when(hook.isin(*CONDITIONAL), "conditional_fixture_required").otherwise("deferred")
    kind = F.when(hook.isin("pre_llm_call", "public_user_message"), "user_statement").when(hook.isin("post_llm_call", "public_assistant_message"), "assistant_claim").when(hook.isin("pre_tool_call", "post_tool_call", "public_tool_call"), "tool_observation").otherwise("system_event")
    source = F.when(hook.startswith("public_"), F.concat(F.lit("public."), F.substr(hook, F.lit(8)))).otherwise(F.concat(F.lit(f"{host}."), hook))
    observed = F.concat(F.lit("observed:"), hook, F.lit(":"), F.left(F.sha2(F.concat(hook, F.lit("\0"), _stable(hook)), 256), F.lit(32)))
    ident = F.coalesce(F.nullif(F.col("event_id"), F.lit("")), observed, F.concat(F.lit("generated:"), hook, F.lit(":"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    mapped = F.col("status") == "mapped"
    return rows.withColumn("status", status).select(
        *payloads.columns,
        "status",
        F.when(mapped, kind).alias("event_type"),
        F.coalesce(*[F.when(hook == k, F.lit(v)) for k, v in CLASSES.items()]).alias("event_class"),
        source.alias("event_source"),
        F.when(mapped, ident).alias("mapped_event_id"),
    )
