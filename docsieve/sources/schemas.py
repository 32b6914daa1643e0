"""Fixed schemas of catalogue tables, blocks and review records."""

from __future__ import annotations

#: The four catalogue tables and their columns, all text.
CATALOGUE = {
    "materials_fda_ema": [
        "UNII", "material_name", "CAS_NUMBER", "alias_name", "alias_type", "SMS_ID", "Language", "Is_Preferred_Name",
        "source", "match_status", "row_id", "lexical_term_id",
    ],
    "materials_chebi": [
        "CHEBI_ID", "material_name", "CAS_NUMBER", "alias_name", "alias_type", "alias_category", "alias_source", "source",
        "source_version", "source_record", "star_rating", "row_id", "lexical_term_id",
    ],
    "equipment": [
        "Equipment type (EN)", "Operating parameter (EN)", "Unit", "Source / section", "row_id", "equipment_type_id",
        "parameter_id",
    ],
    "unit_operations": [
        "Search term (EN)", "Process step (EN)", "Index this row", "Match policy", "record_type", "Term relation",
        "Operation role", "Provenance / source", "Source / supporting evidence", "Operation ID", "process_step_id",
        "Canonical unit operation", "Unit operation (EN)", "row_id", "lexical_term_id",
    ],
}
TABLES = list(CATALOGUE)
TERM = (
    "literal string, component string, term_role string, source_table string, source_field string, row_id string, "
    "lexical_term_id string, boundary_hint string, fuzzy_allowed boolean, display_name string, attributes map<string,string>"
)
BLOCK = (
    "doc_id string, node_id string, kind string, text string, page_number int, block_order int, element_id string, "
    "table_id string, cell struct<row:int,column:int,row_span:int,column_span:int>, ocr array<struct<block_id:string,order:int>>"
)
