"""estatescope: assess a database estate from catalog snapshots, as Spark jobs.

Layers: ``sources`` (snapshots -> silver inventory, sinks), ``functions``
(column expressions), ``operators`` (relational shapes usable on any table) and
``plans`` (gold views, compatibility rules, reports).  ``star`` maps a plain
star schema to the same inputs so that every layer can run on ordinary tables.
"""

from estatescope.session import build_session

__all__ = ["build_session"]
