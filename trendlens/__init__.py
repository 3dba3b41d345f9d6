"""trendlens: topic-trend and brand-volume analytics as Spark DataFrame transforms.

Every public function takes and returns ``DataFrame`` objects (or builds a
``Column``); nothing here triggers an action except the writers in
``trendlens.sources.writers``.
"""

__version__ = "0.1.0"
