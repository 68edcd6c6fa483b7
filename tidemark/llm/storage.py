"""Where the corpus operators' intermediate tables go: the core's one scratch module under the names used here."""

from __future__ import annotations

from tidemark.sources.scratch import cleared, exists, fresh_path, kept
from tidemark.sources.scratch import written as materialize

__all__ = ["cleared", "exists", "fresh_path", "kept", "materialize"]
