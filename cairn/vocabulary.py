"""Closed vocabularies and fixed tables of the evidence model."""

from __future__ import annotations

# Fixed values.
EVENT_TYPES = ("user_statement", "assistant_claim", "tool_observation", "system_event", "external_source", "inference", "decision", "verified_state", "derived_summary")
LIFECYCLES = ("raw", "observed", "candidate", "confirmed", "active", "superseded", "conflicted", "archived", "deleted")
VERIFICATIONS = ("none", "direct_tool_output", "user_confirmation", "deterministic_verification", "approval")
CONFIDENCES = ("low", "medium", "high", "very_high")
SENSITIVITIES = ("public", "internal", "private", "secret")
RETENTIONS = ("temporary", "session", "persistent", "never_store")
UNIT_KINDS = ("text", "heading", "table", "code", "figure", "metadata", "other")
REQUIRED_FIELDS = (
    "event_id", "trace_id", "source", "event_type", "schema_version", "created_at", "observed_at", "sequence", "lifecycle_status",
    "verification_status", "confidence", "sensitivity", "retention", "sanitized_content_hash",
)
MAX_SPACES, MAX_SPACE_LENGTH = 16, 64

SCOPE_PRIORITY = {"exact": 1.0, "composed": 0.9, "global_fallback": 0.8}
TYPE_STRENGTH = {"verified_state": 1.0, "verification": 1.0, "decision": 0.9, "tool_observation": 0.9, "user_statement": 0.8, "assistant_claim": 0.6, "inference": 0.5}
STATUS_STRENGTH = {"none": 0.5, "direct_tool_output": 0.9, "deterministic_verification": 1.0, "user_confirmation": 0.9, "approval": 1.0}
PROVENANCE_VALUE = {"complete": 1.0, "required_only": 0.75}
TEMPORAL_VALUE = {"valid": 1.0, "unknown": 0.75}
RELATION_VALUE = {0: 1.0, 1: 0.9, 2: 0.8}

# Words that never become keywords.
STOPWORDS = (
    "the a an and or of to in on for with is are was were be by as at that this it its from into than then they them their we you he"
    " she his her but not no can will use used using which who what when where how all any"
).split()

# Routes in order of precedence, with the phrases that ask for them.
ROUTES = (
    ("external_current", "EXTERNAL_FRESHNESS_REQUIRED", r"\b(latest|newest|up[ -]to[ -]date|current (version|price|status|market|state|external)|what is .* (now|right now)|as of now|live (status|state))\b"),
    ("global_memory", "EXPLICIT_MULTI_SCOPE", r"\b(combine|across (profiles|projects|knowledge spaces)|multiple (profiles|knowledge spaces)|use (quant|engineering|both|all) .* (and|with) .* (knowledge|profile)|both profiles|all profiles|across all)\b"),
    ("project_memory", "EXPLICIT_PROJECT_CONTEXT", r"\b(project|requirement|decision we made|for this project|the project|project state|what('| i)s (left|unfinished|remaining)|project plan)\b"),
    ("session_memory", "EXPLICIT_SESSION_REFERENCE", r"\b(we just|we discussed|we decided earlier|the file we discussed|our last|our previous|previous (step|turn|message|conversation|session)|last (time|step|turn|session)|continue (from|where we left)|what (did|have) we (just )?(decide|discuss)|recent(ly)? (discussed|decided))\b"),
    ("research_memory", "EXPLICIT_RESEARCH_SOURCE", r"\b(stored research|saved (document|corpus|source)|research (documents|corpus)|source material|use (the |our )?research|recall (the )?source|ingested (docs|knowledge)|my (notes|corpus)|saved knowledge)\b"),
    ("user_memory", "EXPLICIT_USER_PREFERENCE", r"\b(my (usual|preferred|typical)|my preference|preferred (style|format|workflow)|my (style|format|workflow|writing)|(usual|typical) (format|style)|how (do|would) i (usually|normally) like)\b"),
)

# Secrets, a rule's name and its pattern; a bearer token must be the whole text, a URL stands at its start.
SECRET_RULES = (
    ("private_key_block", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    ("bearer_token", r"(?i)^\s*Bearer\s+\S+\s*$"),
    ("credential_url_userinfo", r"(?i)^[a-z][a-z0-9+.-]*://[^/@:]+:[^/@]+@"),
    ("api_key_assignment", r"(?i)(api[_-]?key|api[_-]?secret|password|passwd|passphrase|client[_-]?secret|access[_-]?token|refresh[_-]?token)\s*[:=]\s*\S+"),
)

# The rule that a field's name calls for, in order of precedence; the pattern is of the whole name in
# lower case with underscores for hyphens.
FIELD_RULES = (
    ("password_assignment", r"password|passwd|passphrase|db_password"),
    ("api_key_assignment", r"api_key|apikey|api_secret|secret_key|private_token"),
    ("oauth_secret", r".*oauth.*(secret|token).*|.*(secret|token).*oauth.*|access_token|refresh_token|client_secret"),
    ("authorization_header", r"authorization|proxy_authorization"),
    ("private_key_block", r".*private_key.*|privatekey"),
)

# Fixed value: a private key with its end; a begin without one may not be kept in any form.
WHOLE_PRIVATE_KEY = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*-----END [A-Z0-9 ]*PRIVATE KEY-----"

# What becomes of a text in a payload, in order of precedence: the secret rule that it breaks, the rule
# that its field calls for (None: any of either, "*": some rule), and the rule that is recorded (None: the field's).
LEAF_RULES = (
    ("private_key_block", None, "private_key_block"),
    ("bearer_token", "authorization_header", "bearer_authorization"),
    ("bearer_token", None, "bearer_token"),
    (None, "authorization_header", None),
    ("credential_url_userinfo", None, "credential_url_userinfo"),
    (None, "*", None),
    ("api_key_assignment", None, "api_key_assignment"),
)
