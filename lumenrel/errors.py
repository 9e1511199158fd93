"""Errors, by category."""


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError): ...


class Unsupported(EngineError): ...


class TableNotFound(EngineError): ...


class TableExists(EngineError): ...


class ColumnNotFound(EngineError): ...


class AmbiguousColumn(EngineError): ...


class TypeMismatch(EngineError): ...


class NullViolation(EngineError): ...


class DuplicateKey(EngineError): ...


class Conflict(EngineError): ...


class PermissionDenied(EngineError): ...


class UserError(EngineError): ...


class IndexError_(EngineError): ...
