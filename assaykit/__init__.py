"""assaykit: assessment normalization, audit and delivery state as Spark jobs.

Payloads in three provider formats are validated, normalized to one unified
schema on a 0-100 scale, scrubbed of personal identifiers, and recorded in
idempotent Parquet tables; audit aggregates, time-window metrics and alert
rules run over those tables. Every stage is a DataFrame / SQL expression so
Catalyst can prune, push down and fuse it.
"""

from assaykit.session import get_spark, checkpoint_root

__all__ = ["get_spark", "checkpoint_root"]
__version__ = "0.1.0"
