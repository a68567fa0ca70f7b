"""polylabel: multi-label text corpus preparation, evaluation and annotation
analytics as Spark DataFrame transformations."""

from .schema import DEFAULT_LABELS, EMOTIONS, LabelSet  # noqa: F401

__version__ = "0.1.0"
