"""Boolean expressions over flag columns, such as ``prb~homozygous and not sib``.

The expression text is already boolean logic, so every name is replaced by a bit test and the
result is handed to Spark SQL, which applies the precedence ``not`` > ``and`` > ``or``.
"""

from __future__ import annotations

import ast
import re
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import codes

_NAME = re.compile(r"[\w+-]+(?:~[\w+-]+)?")
_LIST = re.compile(r"\b(any|all)\s*\(\s*\[([^\[\]]*)\]\s*\)", re.IGNORECASE)
_KEYWORDS = {"and", "or", "not", "any", "all"}


def _expand_lists(text: str) -> str:
    """``any([a, b])`` becomes ``(a or b)`` and ``all([a, b])`` becomes ``(a and b)``."""
    while _LIST.search(text):
        text = _LIST.sub(
            lambda m: "(" + (" or " if m[1].lower() == "any" else " and ").join(
                f"({item.strip()})" for item in m[2].split(",")) + ")",
            text)
    return text


def flag_sql(text: str, column: str, names: dict[str, int], zygosity_column: str | None = None) -> str:
    """The Spark SQL condition equivalent to a flag expression."""
    known = {name.lower(): code for name, code in names.items()}

    def condition(match: re.Match) -> str:
        word = match[0].lower()
        if word in _KEYWORDS:
            return word.upper()
        name, _, zygosity = word.partition("~")
        if name not in known:
            raise ValueError(f"unknown name {name!r}; expected one of {sorted(known)}")
        test = f"(({column} & {known[name]}) != 0"
        if zygosity:
            if zygosity_column is None or zygosity not in codes.ZYGOSITY:
                raise ValueError(f"zygosity {zygosity!r} is not supported here")
            mask = codes.zygosity_mask(known[name], codes.ZYGOSITY[zygosity])
            test += f" AND (CAST({zygosity_column} AS BIGINT) & {mask}) != 0"
        return test + ")"

    return _NAME.sub(condition, _expand_lists(text))


def flag_expr(text: str, column: str, names: dict[str, int], zygosity_column: str | None = None) -> Column:
    """A flag expression as a boolean Column."""
    return F.expr(flag_sql(text, column, names, zygosity_column))


def matches(text: str, value: int, names: dict[str, int]) -> bool:
    """Whether a plain integer satisfies a flag expression; zygosities are ignored.

    With names replaced by their truth the text is a Python boolean expression of the same
    precedence; only its ``and``, ``or``, ``not`` and constants are accepted.
    """
    known = {name.lower(): code for name, code in names.items()}

    def truth(match: re.Match) -> str:
        word = match[0].lower()
        return word if word in _KEYWORDS else str(bool(known[word] & value))

    def holds(node: ast.AST) -> bool:
        match node:
            case ast.Expression(body=body):
                return holds(body)
            case ast.BoolOp(op=ast.And(), values=values):
                return all([holds(v) for v in values])
            case ast.BoolOp(op=ast.Or(), values=values):
                return any([holds(v) for v in values])
            case ast.UnaryOp(op=ast.Not(), operand=operand):
                return not holds(operand)
            case ast.Constant(value=bool() as constant):
                return constant
        raise ValueError(f"not a flag expression: {text!r}")

    return holds(ast.parse(_NAME.sub(truth, _expand_lists(without_zygosity(text))).strip(), mode="eval"))


def with_zygosity(text: str, zygosity: str) -> str:
    """Attach a zygosity to every name of an expression."""
    if "~" in text:
        raise ValueError("expression already carries zygosities")
    return _NAME.sub(
        lambda m: m[0] if m[0].lower() in _KEYWORDS else f"{m[0]}~{zygosity}", text)


def without_zygosity(text: str) -> str:
    """Drop every zygosity from an expression."""
    return re.sub(r"~[\w+-]+", "", text)


def roles(text: str, column: str = "allele_in_roles", zygosity_column: str = "zygosity_in_roles") -> Column:
    return flag_expr(text, column, codes.ROLES, zygosity_column)


def sexes(text: str, column: str = "allele_in_sexes", zygosity_column: str = "zygosity_in_sexes") -> Column:
    return flag_expr(text, column, {**codes.SEXES, **codes.SEX_ALIASES}, zygosity_column)


def statuses(text: str, column: str = "allele_in_statuses", zygosity_column: str = "zygosity_in_status") -> Column:
    return flag_expr(text, column, codes.STATUSES, zygosity_column)


def inheritance(text: str | list[str], column: str = "inheritance_in_members") -> Column:
    """A list of expressions must all hold."""
    texts = [text] if isinstance(text, str) else list(text)
    return F.expr(" AND ".join(f"({flag_sql(t, column, codes.INHERITANCE)})" for t in texts))


def variant_type(text: str, column: str = "variant_type") -> Column:
    return flag_expr(text, column, {**codes.ALLELE_TYPES, **codes.ALLELE_TYPE_ALIASES})


def denovo_only_inheritance(texts: str | list[str]) -> bool:
    """No combination of inheritance classes without ``denovo`` satisfies all the expressions."""
    texts = [texts] if isinstance(texts, str) else list(texts)
    others = sorted({code for name, code in codes.INHERITANCE.items() if name != "denovo"})
    masks = {sum(chosen) for n in range(len(others) + 1) for chosen in combinations(others, n)}
    return not any(all(matches(t, mask, codes.INHERITANCE) for t in texts) for mask in masks)
