"""What can go wrong with a query."""


class GraphError(Exception):
    """Any of the following."""


class ParseError(GraphError):
    """The text isn't a query."""


class SemanticError(GraphError):
    """Names, scopes or functions don't make sense."""


class TypeMismatchError(GraphError):
    """A value has a type that its place can't take."""


class QueryRuntimeError(GraphError):
    """Evaluation failed."""


class NotImplementedFeature(GraphError):
    """A form that isn't supported."""


class ConstraintError(GraphError):
    """A write, or existing data, violates a constraint."""
