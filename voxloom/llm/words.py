"""Words as all operators of this subpackage see them."""

from __future__ import annotations

import re

#: A maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())
