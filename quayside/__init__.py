"""quayside: Spark jobs for fleets of replicated, snapshot-based databases.

Inventories go in as DataFrames (object listings, heartbeats, snapshot
catalogs, layered settings); plans, reports and streams come out as
DataFrames. Every job handles all databases at once, and takes the current
time as a parameter.
"""

from quayside.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
