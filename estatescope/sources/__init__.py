from estatescope.sources.collectors import *  # noqa: F401,F403
from estatescope.sources.snapshot import read_all, read_snapshot, split_rejected  # noqa: F401
from estatescope.sources.sinks import append, clear, collect_all, refresh, replace  # noqa: F401
