"""What can go wrong, by stage."""


class DocloomError(Exception):
    """Any error of this library."""


class ConfigurationError(DocloomError):
    """A setting is out of bounds."""


class CorpusError(DocloomError):
    """A corpus or its manifest breaks a rule."""


class DocumentParseError(DocloomError):
    """A file can't be parsed."""


class CleaningError(DocloomError):
    """Elements can't be cleaned."""


class ChunkingError(DocloomError):
    """Elements can't be cut into chunks."""


class IndexingError(DocloomError):
    """An index doesn't agree with its data."""


class RetrievalError(DocloomError):
    """Candidates contradict each other."""


class RerankError(DocloomError):
    """A reranker answers with bad indexes."""


class GenerationError(DocloomError):
    """An answer breaks the rules on citations or refusal."""


class EvaluationError(DocloomError):
    """Evaluation data are incomplete or inconsistent."""
