"""All queries of the core, with their SQL."""

from __future__ import annotations

from loomdex.plans import attributes, auditing, duplicate_groups, event_groups, findings, index_diff, inference, module_graph, nested, planning, references, round_trips, scoring, structure, text_search
from loomdex.plans.problem_sql import PROBLEM_SQL

FLAGSHIP = "deletion_status"

QUERIES = {
    "p1_found": index_diff.p1_found,
    "p3_found": attributes.p3_found,
    "p3_wide": attributes.p3_wide,
    "p3_wide_cells": attributes.p3_wide_cells,
    "p4_found": nested.p4_found,
    "p4_fields": nested.p4_fields,
    "p4_rejected": nested.p4_rejected,
    "p5_found": references.p5_found,
    "p5_report": references.p5_report,
}
SQL = dict(PROBLEM_SQL)

for _module in (module_graph, duplicate_groups, text_search, findings, scoring, auditing, inference, event_groups, planning, round_trips, structure):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
