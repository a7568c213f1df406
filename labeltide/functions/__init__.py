"""Column -> Column functions (text cleaning, tokenising)."""

from .text import (  # noqa: F401
    CLEAN_STEPS, TASK_PREFIX, add_prefix, clean_text, clean_text_stepwise, tokens, to_string,
)
