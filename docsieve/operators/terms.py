"""Search terms from catalogue tables.

Each row gives up to three terms: one ``select`` with an array of candidate structs, nulls filtered, exploded. Tables
that no chosen component needs are not in the plan at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, optional
from ..functions.units import is_unit_cell

# Components in order, the tables they need, policies, record types, roles and markers.
COMPONENTS = [
    "unit_operations", "process_steps", "materials", "quantity_expressions", "units", "equipment", "parameter_names",
    "parameter_value_expressions",
]
NEEDS = {
    "materials_fda_ema": ["materials"],
    "materials_chebi": ["materials"],
    "equipment": ["equipment", "parameter_names", "units"],
    "unit_operations": ["unit_operations", "process_steps"],
}
POLICIES = ["direct_candidate", "context_required", "step_cue_only", "support_only", "inspection_only"]
CUE_POLICIES = ["step_cue_only", "support_only", "inspection_only"]
RECORD_TYPES = ["unit_operation", "generic_step_cue"]
UNAVAILABLE = ["n/a", "na", "unknown", "none"]
NATURAL_ROLES = ["equipment_type", "parameter_name", "unit_operation", "process_step"]
MATERIAL_ROLES = ["material_name", "material_alias", "unii"]


def unavailable(c: Column) -> Column:
    """A code cell that says there is none."""
    return F.lower(F.trim(c)).isin(UNAVAILABLE)


def native_id(c: Column) -> Column:
    """A code cell, null where it is blank or says there is none."""
    return F.when(~blank(c) & ~unavailable(c), c)


def searchable(c: Column, policy: Column | None = None) -> Column:
    """Three characters at least, and not a term that needs its context."""
    ok = ~blank(c) & (F.length(c) >= 3)
    return ok if policy is None else ok & (F.coalesce(policy, F.lit("")) != "context_required")


def fuzzy_shape(c: Column) -> Column:
    """One word of six letters at least."""
    return F.coalesce(c.rlike(r"^\p{L}{6,}$"), F.lit(False))


def fuzzy_allowed(c: Column, role: Column, policy: Column | None = None) -> Column:
    """Whether one edit may be forgiven: a natural role, no limiting policy, the right shape."""
    ok = role.isin(NATURAL_ROLES) & fuzzy_shape(c)
    return ok if policy is None else ok & ~F.coalesce(policy, F.lit("")).isin([*CUE_POLICIES, "context_required"])


def _term(when, literal, component, role, table, field, hint="default", fuzzy=False, display=None, lexical=None, **more):
    role = role if isinstance(role, Column) else F.lit(role)
    pairs = [x for k, v in sorted(more.items()) for x in (F.lit(k), v)]
    attributes = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map()
    return F.when(
        when,
        F.struct(
            literal.alias("literal"), F.lit(component).alias("component"), role.alias("term_role"),
            F.lit(table).alias("source_table"), F.lit(field).alias("source_field"), F.col("row_id"),
            (lexical if lexical is not None else F.lit(None).cast("string")).alias("lexical_term_id"),
            F.lit(hint).alias("boundary_hint"), (fuzzy if isinstance(fuzzy, Column) else F.lit(fuzzy)).alias("fuzzy_allowed"),
            (display if display is not None else F.lit(None).cast("string")).alias("display_name"),
            attributes.cast("map<string,string>").alias("attributes"),
        ),
    )


def _explode(table: DataFrame, terms: list[Column]) -> DataFrame:
    return table.select(F.explode(F.filter(F.array(*terms), lambda t: t.isNotNull())).alias("t")).select("t.*")


def material_terms(table: DataFrame, name: str) -> DataFrame:
    """Names, aliases and registry codes of materials."""
    main, alias, lexical = F.col("material_name"), F.col("alias_name"), optional(F.col("lexical_term_id"))
    more = {"alias_type": optional(F.col("alias_type")), "source": optional(F.col("source"))}
    if name == "materials_fda_ema":
        more |= {"unii": native_id(F.col("UNII")), "sms_id": native_id(F.col("SMS_ID"))}
    else:
        more |= {
            "chebi_id": native_id(F.col("CHEBI_ID")), "source_version": optional(F.col("source_version")),
            "source_record": optional(F.col("source_record")),
        }
    shared = {"display": optional(main), "lexical": lexical, **more}
    terms = [
        _term(searchable(main), main, "materials", "material_name", name, "material_name", **shared),
        _term(searchable(alias), alias, "materials", "material_alias", name, "alias_name", **shared),
    ]
    if name == "materials_fda_ema":
        code = F.col("UNII")
        terms.append(
            _term(searchable(code) & ~unavailable(code), code, "materials", "unii", name, "UNII", hint="whole_code", **shared)
        )
    return _explode(table, terms)


def equipment_terms(table: DataFrame, chosen: list[str]) -> DataFrame:
    """Equipment types, parameter names and unit spellings."""
    kind, parameter, unit = F.col("`Equipment type (EN)`"), F.col("`Operating parameter (EN)`"), F.col("Unit")
    section, type_id = optional(F.col("`Source / section`")), optional(F.col("equipment_type_id"))
    terms = []
    if "equipment" in chosen:
        terms.append(
            _term(searchable(kind), kind, "equipment", "equipment_type", "equipment", "Equipment type (EN)",
                  fuzzy=fuzzy_allowed(kind, F.lit("equipment_type")), display=optional(kind), equipment_type_id=type_id,
                  source_section=section)
        )
    if "parameter_names" in chosen:
        terms.append(
            _term(searchable(parameter), parameter, "parameter_names", "parameter_name", "equipment", "Operating parameter (EN)",
                  fuzzy=fuzzy_allowed(parameter, F.lit("parameter_name")), display=optional(parameter),
                  parameter_id=optional(F.col("parameter_id")), catalogue_equipment_type_id=type_id,
                  catalogue_equipment_type_label=optional(kind), source_section=section)
        )
    if "units" in chosen:
        terms.append(
            _term(is_unit_cell(unit), unit, "units", "unit_spelling", "equipment", "Unit", hint="atomic_unit", source_section=section)
        )
    return _explode(table, terms)


def operation_role(policy: Column, record: Column) -> Column:
    """Role of a unit-operation search term; values that are not known fail."""
    return (
        F.when(~blank(policy) & ~policy.isin(POLICIES), F.raise_error(F.lit("UNKNOWN_MATCH_POLICY")).cast("string"))
        .when(~blank(record) & ~record.isin(RECORD_TYPES), F.raise_error(F.lit("UNKNOWN_RECORD_TYPE")).cast("string"))
        .when((record == "generic_step_cue") | policy.isin(CUE_POLICIES), "generic_cue")
        .when(policy.isin("direct_candidate", "context_required"), "unit_operation")
        .otherwise(F.raise_error(F.lit("AMBIGUOUS_UO_CLASSIFICATION")).cast("string"))
    )


def operation_terms(table: DataFrame, chosen: list[str]) -> DataFrame:
    """Unit-operation search terms of rows marked TRUE, and process steps of all rows."""
    word, step, policy = F.col("`Search term (EN)`"), F.col("`Process step (EN)`"), F.col("`Match policy`")
    canonical, english = optional(F.col("`Canonical unit operation`")), optional(F.col("`Unit operation (EN)`"))
    lexical = optional(F.col("lexical_term_id"))
    more = {
        "match_policy": optional(policy), "record_type": optional(F.col("record_type")),
        "term_relation": optional(F.col("`Term relation`")), "operation_role": optional(F.col("`Operation role`")),
        "provenance_source": optional(F.col("`Provenance / source`")),
        "index_this_row": F.when(F.col("`Index this row`") != "", F.col("`Index this row`")),
    }
    terms = []
    if "unit_operations" in chosen:
        wanted = (F.col("`Index this row`") == "TRUE") & searchable(word, policy)
        role = operation_role(policy, F.col("record_type"))
        terms.append(
            _term(wanted, word, "unit_operations", role, "unit_operations", "Search term (EN)",
                  fuzzy=fuzzy_allowed(word, role, policy), display=F.coalesce(canonical, english), lexical=lexical,
                  operation_id=F.when(role == "unit_operation", optional(F.col("`Operation ID`"))),
                  canonical_unit_operation=canonical, unit_operation_en=english, **more)
        )
    if "process_steps" in chosen:
        terms.append(
            _term(searchable(step), step, "process_steps", "process_step", "unit_operations", "Process step (EN)",
                  fuzzy=fuzzy_allowed(step, F.lit("process_step"), policy), display=optional(step), lexical=lexical,
                  process_step_id=optional(F.col("process_step_id")),
                  supporting_evidence=optional(F.col("`Source / supporting evidence`")), **more)
        )
    return _explode(table, terms)


def eligible_terms(tables: dict[str, DataFrame], components: list[str]) -> DataFrame:
    """All search terms of the chosen components; tables that none of them needs are not read."""
    parts = []
    for name, table in tables.items():
        chosen = [c for c in NEEDS.get(name, []) if c in components]
        if chosen:
            parts.append(
                material_terms(table, name) if name.startswith("materials") else
                equipment_terms(table, chosen) if name == "equipment" else operation_terms(table, chosen)
            )
    if not parts:
        raise ValueError("no table holds terms of these components")
    return reduce(DataFrame.unionByName, parts)
