"""DataFrame transformations built on the Columns of ``sparkcurate.functions``."""
