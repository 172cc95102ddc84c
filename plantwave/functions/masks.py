"""Validity masks: `pv_valid && (sp_valid || !op_valid)` as a boolean column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def mask(text: str | None, columns: list[str]) -> Column:
    """The mask as a column; names that are no columns are false, an empty mask is true.

    The text is checked name by name and handed to Spark's own expression grammar."""
    if not text or not text.strip():
        return F.lit(True)
    if not re.fullmatch(r"[\w\s&|!()]+", text):
        raise ValueError(f"not a mask: {text}")
    known = set(columns)
    sql = _NAME.sub(lambda m: f"coalesce(`{m[0]}`, false)" if m[0] in known else "false", text)
    return F.expr(sql.replace("&&", " and ").replace("||", " or ").replace("!", " not "))
