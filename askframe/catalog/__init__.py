"""The operators on the shared test tables, each with its oracle SQL where SQL can express it."""

from askframe.catalog import answers, blending, contexts, curation, logs, prompts, topics  # noqa: F401
from askframe.catalog.base import oracles, queries  # noqa: F401
