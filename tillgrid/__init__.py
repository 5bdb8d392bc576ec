"""tillgrid: point-of-sale and shop-management analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   - shop table schemas, defaults, schema evolution, payload parsing, exports
* ``functions`` - column helpers (labels, statuses, text cleaning)
* ``operators`` - filters, joins, reports, windows and the batch write rules
* ``streaming`` - Structured Streaming versions of the live figures, presence tracking
* ``plans``     - query registry and the DuckDB oracle used by the correctness gate

Every operator takes DataFrames and returns DataFrames; nothing is collected
except one-row scalars (e.g. a current maximum id).
"""

from tillgrid.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
