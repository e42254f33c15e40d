"""Query plans built from the operators: the query contract with its SQL oracle, the
batch refresh of the derived tables, and plan inspection helpers."""
