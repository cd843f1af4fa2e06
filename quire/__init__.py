"""quire: source code and prose as Spark tables.

Files become lines, lines become blocks, tokens and declarations with exact
character spans; rules match over ordered rows; tags, fragments and trees are
resolved by joins.  Every operator is a ``DataFrame -> DataFrame`` or
``Column -> Column`` function built from Spark's own expressions, windows and
joins.
"""

__all__ = ["catalog", "session"]
