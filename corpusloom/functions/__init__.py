"""Column functions: native expressions in ``text``, ``numbers`` and ``judge``, Arrow functions in ``arrow``."""
