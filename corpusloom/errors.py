"""One base for errors that the operator of the engine can fix; the command line prints them without a trace."""


class EngineError(Exception):
    """A problem with configuration, scope, index, vectors, questions or generation."""


class ConfigError(EngineError):
    pass


class ScopeError(EngineError):
    pass


class IndexStoreError(EngineError):
    pass


class VectorStoreError(EngineError):
    pass


class EmbeddingError(EngineError):
    pass


class EvaluationError(EngineError):
    pass


class GenerationError(EngineError):
    pass
