"""Deterministic identities: canonical JSON and domain-separated digests."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


# Domains of the digests that make ids.
EDGE_DOMAIN, ENTITY_DOMAIN, MENTION_DOMAIN, CONTENT_DOMAIN = "zm8.graph_edge", "zm8.entity", "zm8.entity_mention", "zm8.content"
SOURCE_CONTENT, LOGICAL_SOURCE, NORMALIZATION = "zm10.corpus_source_content", "zm10.corpus_logical_source", "m10.3"
SCOPE = ("profile_id", "project_id", "knowledge_space_id")


def json_text(c: Column) -> Column:
    """A JSON string literal in ASCII; every other character is escaped, inside the JVM."""
    plain = ~F.coalesce(c, F.lit("")).rlike("[^ -~]")

    def piece(p):
        short = [F.when(p == mark, F.lit(name)) for mark, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))]
        quoted = F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        units = F.regexp_replace(F.lower(F.hex(F.encode(p, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(F.ascii(p).between(0x20, 0x7E), quoted).otherwise(F.coalesce(*short, units))

    # Runs of printable ASCII stay whole; only the characters between them are looked at one by one.
    pieces = F.regexp_extract_all(c, F.lit("[ -~]+|[^ -~]"), F.lit(0))
    return F.when(plain, plain_json_text(c)).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(pieces, piece), ""), F.lit('"')))


def plain_json_text(c: Column) -> Column:
    """A JSON string literal of text known to be printable ASCII, without leaving the JVM."""
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), quoted, F.lit('"')), F.lit("null"))


def utf8_json_text(c: Column) -> Column:
    """A JSON string literal that keeps its letters; marks and controls are escaped, inside the JVM."""
    out = c
    for mark, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    rare = out
    for code in range(0x20):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(out.rlike("[\x00-\x1f]"), rare).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def canonical_object(fields: dict[str, Column], ascii_only: bool = False) -> Column:
    """Canonical JSON of string fields: sorted keys, no spaces, nulls kept."""
    literal = plain_json_text if ascii_only else json_text
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + json.dumps(name) + ":"), literal(fields[name])]
    return F.concat(*parts, F.lit("}"))


def digest(domain: str, canonical: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{domain}|v1|"), canonical), 256)


def short_id(prefix: str, domain: str, canonical: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(digest(domain, canonical), F.lit(32)))


def content_id(text: Column, kind: Column, ascii_only: bool = False) -> Column:
    return F.concat(F.lit("c_"), F.left(F.sha2(canonical_object({"text": text, "kind": kind}, ascii_only), 256), F.lit(32)))


def unit_id(source_ref: Column, location_id: Column, ascii_only: bool = False) -> Column:
    return F.concat(F.lit("u_"), F.left(F.sha2(canonical_object({"source_ref": source_ref, "location_id": location_id}, ascii_only), 256), F.lit(32)))


def edge_id(edge: dict[str, Column], ascii_only: bool = False) -> Column:
    return short_id("edg_", EDGE_DOMAIN, canonical_object(edge, ascii_only))


def entity_id(kind: Column, key: Column, ascii_only: bool = False) -> Column:
    return short_id("ent_", ENTITY_DOMAIN, canonical_object({"entity_type": kind, "key": key}, ascii_only))


def source_id(ascii_only: bool = False) -> Column:
    """The id of a logical source: where it lies, its kind and its scope, never its content."""
    place = canonical_object({c: F.col(c) for c in ("external_ref", "kind", *SCOPE)}, ascii_only)
    return digest(CONTENT_DOMAIN, F.concat(F.lit('{"descriptor":'), place, F.lit(f',"domain":"{LOGICAL_SOURCE}"}}')))


def source_content_hash(content: Column) -> Column:
    """The id of a source's bytes alone."""
    return digest(CONTENT_DOMAIN, F.concat(F.lit('{"bytes_sha256":"'), F.sha2(content, 256), F.lit(f'","domain":"{SOURCE_CONTENT}"}}')))


def source_version_id(source: Column, content_hash: Column, ascii_only: bool = False) -> Column:
    """The id of a version: source, content, scope and the rules of normalization."""
    literal = plain_json_text if ascii_only else json_text
    scope = [x for c in SCOPE for x in (F.lit(","), literal(F.col(c)))][1:]
    body = F.concat(F.lit('{"content_hash":"'), content_hash, F.lit(f'","normalization_version":"{NORMALIZATION}","scope":['), *scope, F.lit('],"source_id":"'), source, F.lit('"}'))
    return F.concat(F.lit("sv_"), F.left(digest(CONTENT_DOMAIN, body), F.lit(32)))


def mention_id(entity: Column, event: Column, start: Column, end: Column, ascii_only: bool = False) -> Column:
    """The id of a mention: its entity, its event and its span; an unknown end stays unknown.

    Null where the entity or event is blank or the span is negative or runs backwards.
    """
    literal = plain_json_text if ascii_only else json_text
    place = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    body = F.concat(F.lit('{"entity_id":'), literal(entity), F.lit(',"source_event_id":'), literal(event), F.lit(',"span_end":'), place(end), F.lit(',"span_start":'), place(start), F.lit("}"))
    named = F.coalesce((F.trim(entity) != "") & (F.trim(event) != ""), F.lit(False))
    sound = F.coalesce(start >= 0, F.lit(True)) & F.coalesce(end >= 0, F.lit(True)) & F.coalesce(end >= start, F.lit(True))
    return F.when(named & sound, short_id("men_", MENTION_DOMAIN, body))
