"""Regular expressions of scripts, with a time limit where the ``regex`` package is there."""

from __future__ import annotations

import functools
import re
from typing import Any

try:
    import regex as engine
except ImportError:  # without it there is no limit
    engine = re

#: Seconds after which a pattern is given up (a fixed value of the source).
LIMIT = 1.0


class PatternError(ValueError):
    """A pattern that is none, or that takes too long."""


@functools.lru_cache(maxsize=512)
def _compiled(pattern: str, flags: int) -> Any:
    return engine.compile(pattern, flags)


def apply(method: str, pattern: str, *arguments: Any, flags: str = "", limit: float = LIMIT) -> Any:
    """``search``, ``fullmatch`` or ``sub`` of a pattern; ``flags``: letters of i, m, s and x."""
    try:
        own = _compiled(pattern, sum((getattr(engine, f.upper()) for f in flags if f in "imsx"), 0))
        return getattr(own, method)(*arguments, **({"timeout": limit} if engine is not re else {}))
    except (re.error, getattr(engine, "error", re.error)) as e:
        raise PatternError(f"bad pattern: {e}") from None
    except TimeoutError:
        raise PatternError(f"the pattern takes more than {limit:g} s") from None
