"""Connected components; the operator itself is part of the core."""

from tidemark.operators.components import MOST_ROUNDS, components  # noqa: F401
