"""Node and edge types, base weights, and the columns of the two core tables.

nodes(seq, id, type, name, source_system), edges(seq, source, target, type, c4): seq is the position in the list, which
decides ties; c4 is the confidence in ten-thousandths, as a whole number, so that products round alike everywhere.
"""

from __future__ import annotations

# Names and weights that results are stated in.
NODE_TYPES = ("table", "view", "partition", "function", "file")
DECLARED_FK, INFERRED_NAMING, STATIC_SQL, ORM_CALL, DYNAMIC, STRUCTURAL = "declared_fk", "inferred_naming", "static_sql_string", "orm_call", "dynamic_unresolved", "structural_belongs_to"
BASE_C4 = {DECLARED_FK: 10000, STATIC_SQL: 9600, ORM_CALL: 9800, INFERRED_NAMING: 9200, DYNAMIC: 1500, STRUCTURAL: 10000}
EDGE_TYPES = (DECLARED_FK, INFERRED_NAMING, STATIC_SQL, ORM_CALL, DYNAMIC, STRUCTURAL)
DISPLAY_NAMES = {
    DECLARED_FK: "FK", STRUCTURAL: "file membership", ORM_CALL: "ORM call", STATIC_SQL: "static SQL", INFERRED_NAMING: "naming inference", DYNAMIC: "dynamic query",
}
UNRESOLVED_ID, UNRESOLVED_NAME = "table:unresolved", "<unresolved_dynamic_query>"
