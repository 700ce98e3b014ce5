"""Exceptions of the engine."""


class TracewellError(Exception):
    """Base of all errors raised here."""


class ShapeError(TracewellError, ValueError):
    """Traces, labels or arrays of unexpected shape or type."""


class ClassOutOfBoundError(TracewellError, ValueError):
    """A label is not below the number of classes."""


class EmptyClassError(TracewellError, ValueError):
    """A class or a bit value has no trace."""


class SingularError(TracewellError, ValueError):
    """A scatter matrix cannot be inverted; more traces are needed."""


class GraphError(TracewellError, ValueError):
    """A factor graph's text or use is wrong; ``faults`` has the places in the text."""

    faults: list = []  # noqa: RUF012


class NotAcyclicError(GraphError):
    """Exact inference was asked of a cyclic graph."""


class RankError(TracewellError, ValueError):
    """Costs or keys that cannot be ranked."""
