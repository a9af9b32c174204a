"""Schema rules for nodes, relations and ingestion payloads, as joins and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "tambon string, village string, domain string, social_capital struct<name: string, level: string>, activity struct<name: string, type: string, scope_level: string, is_routine: string, is_innovation: string, status: string>, impacts array<struct<name: string, type: string, evidence_strength: string>>"
#: How a field's type names an enum, and the fields that a payload's parts need.
ENUM_MARK = "enum → "
REQUIRED = ("tambon", "village", "domain")
ACTIVITY = ("name", "type", "scope_level", "is_routine", "is_innovation", "status")


@dataclass
class Schema:
    """Fields (node type, field, type, required), relations (subject, relation, object) and enums."""

    fields: list[tuple[str, str, str, bool]] = field(default_factory=list)
    relations: list[tuple[str, str, str]] = field(default_factory=list)
    enums: dict[str, list[str]] = field(default_factory=dict)

    def values(self, enum: str) -> list[str]:
        return sorted(self.enums.get(enum, []))


def parse(text: str) -> Schema:
    """A schema from markdown: a table of fields below ``### Name``, tables of relations, fenced enums below ``### `Name` ``."""
    out, title, table, fenced = Schema(), "", "", False
    for line in text.splitlines():
        if line.startswith("```"):
            fenced = not fenced and title.startswith("`")
            if fenced:
                out.enums[title.strip("`")] = []
        elif fenced:
            if line.strip():
                out.enums[title.strip("`")].append(line.strip())
        elif line.startswith("### "):
            title, table = line[4:].strip(), ""
        elif line.startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if cells[:3] in (["Field", "Type", "Required"], ["Subject", "Relation", "Object"]):
                table = cells[0]
            elif len(cells) >= 3 and set("".join(cells)) - set("-: "):
                if table == "Field":
                    out.fields.append((title, cells[0], cells[1], cells[2].lower() == "yes"))
                elif table == "Subject":
                    out.relations.append((cells[0], cells[1], cells[2]))
        else:
            table = ""
    return out


def _rules(nodes: DataFrame, schema: Schema) -> DataFrame:
    """One row a node type; as small as the schema's text."""
    rows = [(t, [f for u, f, _, r in schema.fields if u == t and r], [f for u, f, _, _ in schema.fields if u == t], {f: schema.values(k.removeprefix(ENUM_MARK)) for u, f, k, _ in schema.fields if u == t and k.startswith(ENUM_MARK) and k.removeprefix(ENUM_MARK) in schema.enums}) for t in sorted({f[0] for f in schema.fields})]
    return nodes.sparkSession.createDataFrame(rows, "_t string, _need array<string>, _known array<string>, _enums map<string, array<string>>")


def node_errors(nodes: DataFrame, schema: Schema, kind: str = "type", values: str = "fields") -> DataFrame:
    """``nodes`` with ``errors array<string>``: missing and unknown fields and values outside an enum.

    ``values`` is a map from field to value; a null map has no fields. An unknown type is the only error of its row.
    """
    rules = F.broadcast(_rules(nodes, schema))
    m = F.coalesce(F.col(values), F.create_map().cast("map<string, string>"))
    keys = F.map_keys(m)
    missing = F.transform(F.array_except("_need", keys), lambda f: F.concat(F.lit("Missing required field: "), f))
    unknown = F.transform(F.array_except(keys, "_known"), lambda f: F.concat(F.lit("Unknown field: "), f))
    own = F.filter("_known", lambda f: F.array_contains(keys, f) & F.element_at("_enums", f).isNotNull() & ~F.coalesce(F.array_contains(F.element_at("_enums", f), F.element_at(m, f)), F.lit(False)))
    wrong = F.transform(own, lambda f: F.concat(F.lit("Invalid value for "), f, F.lit(": "), F.coalesce(F.element_at(m, f), F.lit("None")), F.lit(". Must be one of: "), F.array_join(F.element_at("_enums", f), ", ")))
    found = F.when(F.col("_t").isNull(), F.array(F.concat(F.lit("Unknown node type: "), F.coalesce(F.col(kind), F.lit("None"))))).otherwise(F.concat(missing, unknown, wrong))
    return nodes.join(rules, F.col(kind) == F.col("_t"), "left").withColumn("errors", found).drop("_t", "_need", "_known", "_enums")


def valid_relations(edges: DataFrame, schema: Schema, subject: str = "subject_type", relation: str = "edge_type", object_: str = "object_type", invalid: bool = False) -> DataFrame:
    """Edges whose types and relation the schema has; with ``invalid`` the others."""
    allowed = F.broadcast(edges.sparkSession.createDataFrame(schema.relations, "_s string, _r string, _o string").distinct())
    return edges.join(allowed, (F.col(subject) == F.col("_s")) & (F.col(relation) == F.col("_r")) & (F.col(object_) == F.col("_o")), "left_anti" if invalid else "left_semi")


def payload_errors(payload: Column, schema: Schema) -> Column:
    """The errors of an ingestion payload in JSON; a field that is null counts as missing."""
    p = F.from_json(payload, PAYLOAD)
    has = lambda c, names: F.greatest(*(c[n].isNull().cast("int") for n in names)) == 0

    def one_of(value: Column, enum: str, what: Column) -> Column:
        return F.when(value.isNotNull() & ~value.isin(schema.values(enum)), F.concat(F.lit("Invalid "), what, F.lit(": "), value, F.lit(". Must be one of: " + ", ".join(schema.values(enum)))))

    capital, act = p["social_capital"], p["activity"]
    given = F.get_json_object(payload, "$.impacts")
    single = [F.when(p[f].isNull(), F.lit(f"Missing required field: {f}")) for f in REQUIRED]
    single += [F.when(capital.isNotNull() & ~has(capital, ("name", "level")), F.lit("social_capital must have 'name' and 'level' fields")), one_of(capital["level"], "SocialCapitalLevel", F.lit("social_capital level"))]
    single += [F.when(act.isNotNull() & act[f].isNull(), F.lit(f"activity must have '{f}' field")) for f in ACTIVITY]
    single += [one_of(act["scope_level"], "ScopeLevel", F.lit("activity scope_level")), F.when(given.isNotNull() & ~given.startswith("["), F.lit("impacts must be a list"))]

    def of_impact(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("impact["), i.cast("string"), F.lit("]"))
        return F.array(F.when(~has(x, ("name", "type", "evidence_strength")), F.concat(at, F.lit(" must have 'name', 'type', and 'evidence_strength' fields"))), one_of(x["evidence_strength"], "EvidenceStrength", F.lit("impact evidence_strength")))

    impacts = F.when(given.startswith("["), F.flatten(F.transform(p["impacts"], of_impact)))
    return F.array_compact(F.concat(F.array(*single), F.coalesce(impacts, F.array().cast("array<string>")), F.array(one_of(p["domain"], "DomainCode", F.lit("domain")))))
