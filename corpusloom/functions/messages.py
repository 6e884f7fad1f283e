"""Message traces and structured outputs as column expressions: flattening, submissions, validation, audit records.

A message is a struct (kind, name, content, artifact, calls); content blocks are structs (type, text, thinking), calls (name, args).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let, text_of

# Blocks that hold thoughts.
THOUGHTS = ("thinking", "reasoning")


def content_text(blocks: Column) -> Column:
    """The text of content blocks one after another, without thoughts; empty for none."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: ~F.coalesce(b["type"].isin(*THOUGHTS), F.lit(False))), lambda b: text_of(b["text"])), "")


def content_thoughts(blocks: Column) -> Column:
    """The thoughts of content blocks one after another: their text, or else their thinking."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin(*THOUGHTS)), lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), b["thinking"], F.lit(""))), "")


def submission(messages: Column, tool: str, schema: str) -> Column:
    """What a trace submits with a tool, parsed by schema: the last result of that tool that parses, else the last such call's arguments.

    Null if neither is there; then the run is to be asked again.
    """
    usable = lambda raw: raw.isNotNull() & F.get_json_object(raw, "$").isNotNull() & F.startswith(F.ltrim(raw), F.lit("{"))
    results = F.filter(messages, lambda m: (m["kind"] == "tool") & (m["name"] == tool) & usable(m["artifact"]))
    calls = F.filter(F.flatten(F.transform(messages, lambda m: F.coalesce(m["calls"], F.array().cast("array<struct<name:string,args:string>>")))), lambda c: (c["name"] == tool) & usable(F.coalesce(c["args"], F.lit("{}"))))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.from_json(F.coalesce(last(F.transform(results, lambda m: m["artifact"])), last(F.transform(calls, lambda c: F.coalesce(c["args"], F.lit("{}"))))), schema)


def faults(value: Column, enums: Mapping[str, Sequence[str]] | None = None, shares: Sequence[str] = (), required: Sequence[str] = (), prefix: str = "") -> Column:
    """What is wrong with a struct: fields that are missing, outside their values, or no share of 0 to 1; empty if nothing is."""
    tests = [(value[f].isNull(), f"missing {prefix}{f}") for f in required]
    tests += [(value[f].isNotNull() & ~value[f].isin(*allowed), f"unknown {prefix}{f}") for f, allowed in (enums or {}).items()]
    tests += [(value[f].isNotNull() & ~value[f].between(0.0, 1.0), f"{prefix}{f} out of range") for f in shares]
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(said)) for test, said in tests)))


def output_faults(output: Column, opinion: Mapping[str, Sequence[str]], assessment: Mapping[str, Sequence[str]], texts: Sequence[str] = ("finding", "recommendation")) -> Column:
    """What is wrong with a review's output (has_opinion, opinions, risk_assessment), each fault once; null output is itself one."""
    each = F.flatten(F.transform(output["opinions"], lambda o: faults(o, opinion, ("confidence",), (*opinion, *texts), "opinion.")))
    whole = F.concat(
        faults(output, required=("has_opinion", "risk_assessment")),
        F.coalesce(each, F.array().cast("array<string>")),
        F.when(output["risk_assessment"].isNotNull(), faults(output["risk_assessment"], assessment, ("confidence",), (*assessment, "rationale"), "risk.")).otherwise(F.array().cast("array<string>")),
    )
    return F.when(output.isNull(), F.array(F.lit("no output"))).otherwise(F.array_distinct(whole))


def empty_review(facts: Column, note: str = "no facts to compare") -> Column:
    """The outcome of a consistency review without facts, null where there are facts to review."""
    fixed = F.struct(F.lit(False).alias("has_opinion"), F.lit("none").alias("risk_level"), F.lit(note).alias("rationale"), F.lit("不适用").alias("affected_party"), F.lit(1.0).alias("confidence"))
    return F.when(F.coalesce(F.size(facts), F.lit(0)) <= 0, fixed)


def last_attempt(attempts: Column, valid) -> Column:
    """Struct of the first attempt that is valid (null if none), how many were made up to it, and the faults of those before it.

    attempts: array of structs; valid: what is wrong with one, as an array.
    """
    judged = F.transform(attempts, lambda a: F.struct(a.alias("value"), valid(a).alias("faults")))

    def chosen(js: Column) -> Column:
        at = F.array_position(F.transform(js, lambda j: F.size(j["faults"]) == 0), True)
        n = F.when(at > 0, at).otherwise(F.size(js)).cast("int")
        before = F.slice(js, F.lit(1), F.when(at > 0, n - 1).otherwise(n))
        return F.struct(F.when(at > 0, F.get(js, (at - 1).cast("int"))["value"]).alias("value"), n.alias("attempts"), F.flatten(F.transform(before, lambda j: j["faults"])).alias("reasons"))

    return let(judged, chosen)


def audit_record(event: Column, at: Column, **details: Column) -> Column:
    """One JSON line of an event with its time and present details, in order of name."""
    rows = [F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in sorted(details.items())]
    there = F.filter(F.array(*rows), lambda r: r["value"].isNotNull())
    return F.to_json(F.struct(event.alias("event"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.map_from_entries(there).alias("details")))


def blocks_of(items: Column) -> Column:
    """Array of (type, text, page, box) from a document tree's items (class, text, prov): those with text, with their first place.

    prov: array of (page_no, bbox), bbox an array of left, top, right, bottom or null. Title and section header items are headings.
    """
    place = lambda i: F.get(i["prov"], F.lit(0))
    made = F.transform(items, lambda i: F.struct(F.when(i["class"].isin("TitleItem", "SectionHeaderItem"), "heading").otherwise("paragraph").alias("type"), F.trim(text_of(i["text"])).alias("text"), place(i)["page_no"].alias("page"), place(i)["bbox"].alias("box")))
    return F.filter(made, lambda b: b["text"] != "")


def polygon_box(points: Column) -> Column:
    """[left, top, right, bottom] around an array of points (x, y); null for none."""
    x, y = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(points) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def tree_title(blocks: Column, default: Column, first: int = 10) -> Column:
    """The first heading among the first blocks, else ``default``."""
    heads = F.filter(F.slice(blocks, 1, first), lambda b: b["type"] == "heading")
    return F.coalesce(F.get(heads, F.lit(0))["text"], default)
