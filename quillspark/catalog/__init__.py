"""Every registered query and the SQL it is checked against."""

from quillspark.catalog import cleaning, corpus, files, models, styles, topical, vocabularies  # noqa: F401
from quillspark.catalog.base import ORACLES, QUERIES  # noqa: F401
