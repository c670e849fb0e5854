"""alertforge: alert and incident analytics as Spark DataFrame jobs.

Layers (each a set of pure ``DataFrame -> DataFrame`` functions):

* ``sources``    readers for vendor feeds, silver files, documents; sinks
* ``functions``  column expressions (severity maps, windows, text rules)
* ``operators``  silver, incidents, gold, star schema, reports, ML, vectors
* ``plans``      end-to-end jobs that wire operators together
* ``streaming``  Structured Streaming versions of the same rules
"""

from alertforge.session import ensure_checkpoint_dir, get_session, ship_package

__all__ = ["get_session", "ensure_checkpoint_dir", "ship_package"]
