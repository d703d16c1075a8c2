"""What the engine refuses, by kind; problems of single rows are columns (status, refusal), not exceptions."""


class EmbeddingUnavailable(RuntimeError):
    """The embedding service gave no vector, or not one for each text."""


class ModelUnavailable(RuntimeError):
    """The language model gave no answer."""


class AnswerNotJson(ValueError):
    """The language model's answer holds no JSON."""


class FitRefused(ValueError):
    """A fit that would mean nothing: a loss that is no number, or a senseless setting."""


class LabelDiversityError(FitRefused):
    """Too few rows, or one class only."""


class LeakageError(FitRefused):
    """Calibration data carry source text."""


class RedisplayError(ValueError):
    """An artifact shows collected text word for word, or cites rows that are not there."""


class WriteConflict(RuntimeError):
    """Another writer made the version of a table that this one was about to make."""


class ConfigError(ValueError):
    """A setting that is not understood."""
