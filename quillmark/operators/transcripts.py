"""Cleaning of transcripts: system messages, reasoning, tool calls written as text, leaked names, arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tools there are, with the arguments that each requires.
TOOLS = {
    "ampliar_hallazgo": ("finding_id", "detalles"), "buscar_documentos": ("tema",), "describir_capacidades": (), "escalate_to_quality": (), "generar_material_visual": ("titular", "descripcion", "clausula"),
    "get_capa_status": ("finding_id",), "leer_documento": ("documento",), "register_finding": ("description",), "registrar_accion_correctiva": ("finding_id", "description"),
}
NAMES = "|".join(sorted(TOOLS))
LEAKED = rf"(?i)^\s*(?:<tool_call>|```json|```|\*\*)?\s*({NAMES})\b.*$"
ARGUMENT = r"(?i)^\s*(?:motivo|raz[oóÓ]n|reason|description|descripci[oóÓ]n|finding_id|argumentos?|arguments?)\s*[:=]"
MESSAGE = "array<struct<role:string,content:string>>"


def merge_system(messages: Column) -> Column:
    """The leading system messages as one, with blank lines between them; later ones stay."""
    first = F.coalesce(F.array_min(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] != "system", i)), lambda i: i.isNotNull())), F.size(messages))
    lead = F.filter(F.transform(F.slice(messages, F.lit(1), first), lambda m: m["content"]), lambda c: c.isNotNull() & (c != ""))
    one = F.when(F.size(lead) > 0, F.array(F.struct(F.lit("system").alias("role"), F.array_join(lead, "\n\n").alias("content")))).otherwise(F.array()).cast(MESSAGE)
    return F.concat(one, F.slice(messages, first + 1, F.size(messages)))


def strip_reasoning(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", ""))


def recovered_call(c: Column) -> Column:
    """(name, arguments) of a tool call written as text: tagged, fenced, bare, or a name before its arguments; null if none."""
    call = "struct<name:string,arguments:string>"
    shapes = (r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)^\s*(\{.*\})\s*$")
    found = [F.from_json(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), "name string, arguments string") for p in shapes]
    good = [F.when(f["name"].isin(*TOOLS), F.struct(f["name"].alias("name"), F.coalesce(f["arguments"], F.lit("{}")).alias("arguments")).cast(call)) for f in found]
    named = r"(?s)^\s*([a-z_]{3,40})\s*[:\n]\s*(\{.*\})\s*$"
    name, args = F.regexp_extract(c, named, 1), F.regexp_extract(c, named, 2)
    last = F.when(name.isin(*TOOLS) & F.from_json(args, "map<string,string>").isNotNull(), F.struct(name.alias("name"), args.alias("arguments")).cast(call))
    return F.coalesce(*good, last)


def strip_tool_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?i)^\s*(?:<tool_call>|```json|```)?\s*(?:{NAMES})\s*[:\-–]\s*", ""))


def split_leaks(c: Column) -> Column:
    """(text, mentioned): the text without lines that a tool's name heads and the argument lines after them."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    state = "struct<kept:array<string>,skipping:boolean>"

    def step(a: Column, line: Column) -> Column:
        leak = line.rlike(LEAKED)
        drop = a["skipping"] & (line.rlike(ARGUMENT) | F.trim(line).isin("", "{", "}", "{}", "`", "``", "```", "}```"))
        return F.struct(F.when(leak | drop, a["kept"]).otherwise(F.concat(a["kept"], F.array(line))).alias("kept"), (leak | drop).alias("skipping")).cast(state)

    kept = F.aggregate(lines, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skipping")).cast(state), step, lambda a: a["kept"])
    clean = F.regexp_replace(F.array_join(kept, "\n"), r"(?m)^\s*(?:```(?:json)?|</?tool_call>|\{|\})\s*$", "")
    names = F.transform(F.filter(lines, lambda x: x.rlike(LEAKED)), lambda x: F.lower(F.regexp_extract(x, LEAKED, 1)))
    return F.struct(F.regexp_replace(clean, r"^\s+|\s+$", "").alias("text"), F.array_sort(F.array_distinct(names)).alias("mentioned"))


def parsed_arguments(c: Column) -> tuple[Column, Column]:
    """The arguments as a map, empty for none, and whether the text is no JSON object."""
    blank = F.coalesce(F.trim(c), F.lit("")) == ""
    m = F.from_json(c, "map<string,string>")
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return F.when(blank | ~ok, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(m), ~blank & ~ok


def call_error(name: Column, arguments: Column) -> Column:
    """unknown_tool, invalid_arguments, or null for a call that could run."""
    blank = lambda k: F.trim(F.coalesce(arguments[k], F.lit(""))) == ""
    out = F.when(~name.isin(*TOOLS), "unknown_tool")
    for tool, needed in TOOLS.items():
        for k in needed:
            bad = F.coalesce(~F.trim(arguments[k]).rlike(r"^[+-]?\d+$"), F.lit(True)) if k == "finding_id" else blank(k)
            out = out.when((name == tool) & bad, "invalid_arguments")
    return out


def native_calls(calls: Column) -> Column:
    """Tool calls (name, arguments as text) in the dialect that takes arguments as an object."""
    return F.transform(calls, lambda t: F.struct(t["name"].alias("tool_name"), F.from_json(t["arguments"], "map<string,string>").alias("arguments")))
