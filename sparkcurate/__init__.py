"""Curation of question-answer and reasoning datasets as Spark DataFrame transformations.

Layers, bottom up:

* ``functions``  -- Column builders (no DataFrame, no action),
* ``operators``  -- DataFrame -> DataFrame transformations,
* ``sources``    -- readers and writers,
* ``plans``      -- the composite jobs a user calls,
* ``streaming``  -- Structured Streaming forms of the live operators.
"""

from sparkcurate.config import DomainCheck, Rules, SftConfig, SplitRatios, Task

__all__ = ["DomainCheck", "Rules", "SftConfig", "SplitRatios", "Task"]
