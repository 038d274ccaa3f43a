"""Schemas of the normalized tables, and the fixed vocabularies."""

from __future__ import annotations

BBOX = "struct<l: double, t: double, r: double, b: double, coord_origin: string>"
FORMATTING = "struct<bold: boolean, italic: boolean, underline: boolean, strikethrough: boolean, script: string>"

#: (doc_id, ref) identifies a node. ``path`` holds child positions from the root: its order is reading order.
NODES = (
    "doc_id long, ref string, kind string, label string, layer string, parent_ref string, child_pos int, text string, orig string, "
    f"heading_level int, marker string, enumerated boolean, code_language string, formatting {FORMATTING}, hyperlink string, name string, page_no int"
)
PROV = f"doc_id long, ref string, prov_ix int, page_no int, bbox {BBOX}, charspan array<int>"
PAGES = "doc_id long, page_no int, width double, height double"
TABLE_CELLS = f"doc_id long, ref string, cell_ix int, r0 int, r1 int, c0 int, c1 int, row_span int, col_span int, text string, column_header boolean, row_header boolean, row_section boolean, fillable boolean, bbox {BBOX}, rich_ref string"
GRAPH_CELLS = "doc_id long, ref string, cell_id int, label string, text string, orig string, item_ref string"
GRAPH_LINKS = "doc_id long, ref string, link_ix int, label string, source_cell_id int, target_cell_id int"
FLOAT_REFS = "doc_id long, owner_ref string, role string, pos int, target_ref string"
CUES = "doc_id long, ref string, start_time double, end_time double, identifier string, voice string"

# Labels that default exports include.
DEFAULT_LABELS = (
    "title", "document_index", "section_header", "paragraph", "table", "picture", "formula", "checkbox_unselected", "checkbox_selected",
    "text", "list_item", "code", "reference", "page_header", "page_footer", "key_value_region", "empty_value", "field_key", "field_value",
    "field_heading", "field_hint", "marker", "handwritten_text",
)

# Labels of groups; the layers of content, of which only the first is exported by default.
GROUP_LABELS = ("unspecified", "list", "ordered_list", "chapter", "section", "sheet", "slide", "form_area", "key_value_area", "comment_section", "inline", "picture_area")
LAYERS = ("body", "furniture", "background", "invisible", "notes")

# The array of the document that holds a node of a kind.
ARRAYS = ("groups", "texts", "pictures", "tables", "key_value_items", "form_items", "field_regions", "field_items")
