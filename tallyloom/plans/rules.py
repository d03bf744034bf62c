"""Rule tables as plan metadata: reading them into lists and binding rule text to columns."""
from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\b[A-Za-z_]\w*\b")


def rule_rows(rules) -> list[dict]:
    """Rules as dictionaries. A rule becomes an expression of the plan, so the rule table is
    as small as a plan must be; it is the only thing read to the driver here. NaN, which a data frame has for an empty
    cell, counts as missing. Where the order of rules matters, a frame needs a column ``position``."""
    if isinstance(rules, DataFrame):
        ordered = rules.orderBy("position") if "position" in rules.columns else rules
        rules = [r.asDict() for r in ordered.collect()]
    return [{k: None if isinstance(v, float) and math.isnan(v) else v for k, v in dict(r).items()} for r in rules]


def names(text) -> list[str]:
    """Split an ``@`` list; empty and missing text give no names."""
    return [t for t in (p.strip() for p in str(text or "").split("@")) if t and t != "nan"]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(text: str, substitutions: Mapping[str, str]) -> str:
    """Replace whole words of a SQL rule, leaving quoted text and names alone."""
    text = re.sub(r"[\r\n]", " ", text).strip()
    return _TOKEN.sub(lambda m: substitutions.get(m.group(), m.group()), text)


def word_array(words: Sequence[str]) -> str:
    return "array(" + ", ".join(text_literal(w) for w in words) + ")"


def boolean_rule(df: DataFrame, sql: str, where: str, errors: list[str] | None) -> Column | None:
    """The rule as a Column, or None with the reason reported when it does not resolve to a
    condition over the columns of ``df``."""
    try:
        kind = df.select(F.expr(sql).alias("r")).schema["r"].dataType.typeName()
        if kind != "boolean":
            raise ValueError(f"not a condition but {kind}")
        return F.expr(sql)
    except (AnalysisException, ParseException, ValueError) as problem:
        report(errors, f"{where}: {str(problem).splitlines()[0]}")
        return None


def report(errors: list[str] | None, message: str) -> None:
    if errors is None:
        warnings.warn(message, stacklevel=3)
    else:
        errors.append(message)


def missing_columns(df: DataFrame, cols: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c not in have]
