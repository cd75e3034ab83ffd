"""Independent SQL for every registered query, run by DuckDB over the same tables."""

from oracle import generated, governance, star, storage

ORACLE = {**star.ORACLE, **generated.ORACLE, **storage.ORACLE, **governance.ORACLE}
