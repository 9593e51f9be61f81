"""Column functions that assemble answers and design reports from structured parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks, limits, words and texts that results have to equal.
STATUS_RANK = {"conflict": 5, "applies": 4, "conditional": 3, "needs_code": 2, "not_applicable": 1}
LEGACY = {"compliant": "applies", "non_compliant": "conflict", "not_assessed": "conditional"}
SCOPES = {"deliverables": "Drawings & specifications", "design_checks": "Design checks (clearances, sizing, access)", "coordination": "Coordinate with", "confirm": "Confirm before detailing"}
MAX_SCOPE_ITEMS = 8
UNCERTAIN = ["not confirmed", "tbc", "to be confirmed", "proposed but", "subject to", "may include", "if required", "depends on", "confirm ", "to confirm", "uncertain", "under review"]
SCOPE_HINTS = {
    "deliverables": ["drawing", "drawings", "schedule", "schedules", "specification", "specifications", "spec", "layout", "single-line", "single line", "schematic", "diagram", "documentation", "document on", "show on", "include on"],
    "design_checks": ["clearance", "clearances", "access", "spacing", "dimension", "size", "sizing", "location", "route", "routing", "coverage", "capacity", "rating", "segregation", "setback", "working space", "maintenance", "intelligibility", "zone", "zoning"],
    "coordination": ["coordinate", "coordination", "liaise", "consult", "fire engineer", "structural", "mechanical", "hydraulic", "distributor", "builder", "architect", "acoustic", "services engineer"],
    "confirm": ["confirm", "tbc", "to be confirmed", "verify", "check whether", "depends on", "subject to", "proposed", "not confirmed", "uncertain"],
}
STOP_WORDS = ["and", "the", "for", "with", "from", "into", "design", "requirements", "requirement", "electrical", "installation", "system", "systems", "services", "service", "project", "building"]
TOPICS = {
    "supply_switchboard": ["supply", "switchboard", "substation", "incoming", "msb", "point", "kiosk", "demand", "diversity", "kva", "scheduling"],
    "emergency_lighting": ["emergency", "lighting", "exit", "sign", "signage", "2293"],
    "ewis_warning": ["ewis", "warning", "intercom", "wip", "ewcie", "occupant", "1670.4", "speaker", "sound"],
    "fire_detection": ["detection", "fdcie", "fip", "smoke", "detector", "detectors", "1670.1"],
    "ev_charging": ["ev", "charging", "charger", "vehicle", "j9d4"],
    "der_embedded": ["embedded", "generation", "pv", "photovoltaic", "solar", "rooftop", "bess", "battery", "storage", "inverter", "der", "distributed", "renewable"],
    "metering": ["metering", "meter", "meters", "submeter", "sub-meter", "odd", "odds"],
    "essential_services": ["essential", "safety", "fire", "pump", "pumps"],
    "lift": ["lift", "lifts", "elevator", "vertical", "transportation"],
    "energy_efficiency": ["energy", "efficiency", "section", "monitoring", "j9d3", "j9d5"],
    "telecommunications": ["telecommunication", "telecommunications", "nbn", "mdf", "idf"],
    "earthing": ["earthing", "earth", "rcd", "bonding", "men"],
}
WARNING_FIRST = ["ewis", "wip", "ewcie", "intercom"]
#: Words of detection and of warning where the source is the standard of warning systems.
DETECTION_ONLY = ["fdcie", "detector", "detectors", "smoke", "fip", "detection"]
WARNING_WORDS = ["ewis", "warning", "intercom", "wip", "ewcie", "occupant", "speaker", "sound", "voice", "alarm"]
SUPERSEDED = [["der_embedded", "solar_pv", "bess_storage", "embedded", "generation"], ["supply_switchboard", "maximum_demand"], ["metering", "energy_efficiency"], ["essential_services", "electrical", "installation"]]
OUTCOMES = {"permitted": "appears **permitted**", "not_permitted": "appears **not to comply** or is **not permitted**", "depends": "apply the requirements below to the installation and use any verification items as applicable"}


def cleaned(values: Column, limit: int) -> Column:
    """Trimmed values that aren't empty, each once, in their order, up to limit."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")), 1, limit)


def uncertain(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*map(F.lit, UNCERTAIN)), lambda m: low.contains(m)), F.lit(False))


def status(value: Column) -> Column:
    """A planning status; legacy names are translated, others count as conditional."""
    s = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    for old, new in LEGACY.items():
        s = F.when(s == old, new).otherwise(s)
    return F.when(s.isin(*STATUS_RANK), s).otherwise("conditional")


def status_rank(value: Column) -> Column:
    r = F.lit(0)
    for name, n in STATUS_RANK.items():
        r = F.when(value == name, n).otherwise(r)
    return r


def scope_of(line: Column) -> Column:
    """The part of a design scope whose words a line has most of; the first of equals, design_checks if there are none."""
    low = F.lower(line)
    score = {k: F.size(F.filter(F.array(*map(F.lit, hints)), lambda h: low.contains(h))) for k, hints in SCOPE_HINTS.items()}
    most = F.greatest(*score.values())
    first = F.coalesce(*[F.when(n == most, F.lit(k)) for k, n in score.items()])
    return F.when(most == 0, "design_checks").otherwise(first)


def domain_tokens(domain: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def _standard(source: Column, number: str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), "[^a-z0-9]+", "").contains(number)


def topic(domain: Column, source: Column | None = None) -> Column:
    """A key under which items on one topic meet: the first topic that shares a word with the domain or the source, else
    the words. What the standard of warning systems says is on warning, unless it is of detection and of nothing else."""
    source = F.lit("") if source is None else source
    t = F.array_union(domain_tokens(domain), domain_tokens(source))
    shares = lambda words: F.arrays_overlap(t, F.array(*map(F.lit, words)))
    warning = _standard(source, "16704") & (~shares(DETECTION_ONLY) | shares(WARNING_WORDS))
    named = [F.when(shares(words), F.lit(k)) for k, words in TOPICS.items()]
    return F.when(F.size(t) == 0, "general").when(warning | shares(WARNING_FIRST), "ewis_warning").otherwise(F.coalesce(*named, F.array_join(F.slice(F.array_sort(t), 1, 5), " ")))


def supersession_group(key: Column) -> Column:
    return F.coalesce(*[F.when(key.isin(*g), F.lit(g[0])) for g in SUPERSEDED], key)


def section_label(labels: Column) -> Column:
    u = cleaned(labels, 1_000_000)
    more = F.concat(F.array_join(F.slice(u, 1, 3), " · "), F.lit(" + "), (F.size(u) - 3).cast("string"), F.lit(" more"))
    return F.when(F.size(u) == 0, "Selected codes").when(F.size(u) <= 4, F.array_join(u, " · ")).otherwise(more)


def citation(label: Column, clause: Column, heading: Column, page: Column) -> Column:
    clause, heading = F.trim(F.coalesce(clause, F.lit(""))), F.trim(F.coalesce(heading, F.lit("")))
    own = F.when((heading != "") & (F.lower(heading) != F.lower(clause)), heading)
    return F.concat(F.concat_ws(" — ", label, F.nullif(clause, F.lit("")), own), F.when(page.isNull(), "").otherwise(F.concat(F.lit(", p. "), page.cast("string"))))


def citation_line(claim: Column, ref: Column) -> Column:
    claim, ref = F.trim(F.coalesce(claim, F.lit(""))), F.trim(F.coalesce(ref, F.lit("")))
    head = F.concat(F.lit("- **"), F.coalesce(F.nullif(ref, F.lit("")), F.lit("Clause")), F.lit("**"))
    return F.when((claim == "") & (ref == ""), None).when(claim == "", head).otherwise(F.concat(head, F.lit(" - "), claim))


def without_empty_sections(markdown: Column) -> Column:
    m = F.regexp_replace(markdown, r"(?i)\*\*(Conditions|Exceptions|Required Actions)\*\*\s*\n+\s*[-•]?\s*None\s*(\n|$)", "")
    return F.trim(F.regexp_replace(m, r"\n\s*[-•]\s*None\s*\n", "\n"))


def bullets(title: str, lines: Column) -> Column:
    """A section, '' without lines."""
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.lit(f"\n\n**{title}**\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")))


def answer(conclusion: Column, short: Column, conditions: Column, actions: Column, refs: Column) -> Column:
    """Markdown of a structured answer, with the index of its sources."""
    outcome = F.coalesce(*[F.when(conclusion == k, F.lit(f"**Outcome:** {v}\n\n")) for k, v in OUTCOMES.items()], F.lit(""))
    body = F.concat(F.lit("**Practitioner summary**\n\n"), outcome, short, bullets("What the cited clauses require", conditions), bullets("Required actions or sequencing", actions))
    body = F.when(conclusion == "insufficient_evidence", F.concat(F.lit("**Insufficient evidence in the supplied clauses**\n\n"), short)).otherwise(body)
    return F.concat(body, F.when(F.size(refs) == 0, "").otherwise(F.concat(F.lit("\n\n**Sources / citations**\n\n"), F.array_join(refs, "\n"))))


def discipline(value: Column) -> Column:
    k = F.lower(F.trim(F.split(F.coalesce(value, F.lit("")), "/")[0]))
    return F.when(k == "fire", "fire").when(k.isin("hydraulic", "hydraulics", "plumbing"), "hydraulics").when(k == "mechanical", "mechanical").otherwise("electrical")
