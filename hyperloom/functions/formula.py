"""Arithmetic formulas: an allow-list over Python's syntax tree, compiled to Columns or evaluated on the driver.

Nothing is ever passed to eval. ^ is power, as in the formula tables.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions and constants of the formula language.
FUNCTIONS = {"abs": abs, "sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "log": math.log, "log10": math.log10}
CONSTANTS = {"pi": math.pi, "e": math.e}


def parse(formula: str) -> ast.expr | None:
    """The tree of a formula that keeps to the allow-list; None for any other text."""
    try:
        tree = ast.parse((formula or "").replace("^", "**").strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError):
        return None
    return tree if _allowed(tree) else None


def _allowed(t: ast.AST) -> bool:
    if isinstance(t, ast.BinOp):
        return isinstance(t.op, (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow)) and _allowed(t.left) and _allowed(t.right)
    if isinstance(t, ast.UnaryOp):
        return isinstance(t.op, (ast.UAdd, ast.USub)) and _allowed(t.operand)
    if isinstance(t, ast.Call):
        return _function(t) is not None and len(t.args) == 1 and not t.keywords and _allowed(t.args[0])
    if isinstance(t, ast.Attribute):
        return isinstance(t.value, ast.Name) and t.value.id == "math" and t.attr in CONSTANTS
    return isinstance(t, ast.Name) or isinstance(t, ast.Constant) and type(t.value) in (int, float)


def _function(t: ast.Call) -> str | None:
    f = t.func
    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "math" else None
    return name if name in FUNCTIONS else None


def names(formula: str) -> list[str]:
    """Distinct quantities of a formula in order of appearance."""
    tree = parse(formula)
    if tree is None:
        return []
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    found = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called), key=lambda n: n.col_offset)
    return list(dict.fromkeys(n.id for n in found if n.id not in CONSTANTS and n.id != "math"))


def evaluate(formula: str, values: Mapping[str, float]) -> float | None:
    """The value; None for a missing quantity, division by zero, a result beyond the numbers or a text out of bounds."""
    tree = parse(formula)
    if tree is None:
        return None
    try:
        out = _value(tree, values)
    except (KeyError, ZeroDivisionError, ValueError, TypeError, OverflowError):
        return None
    return out if isinstance(out, (int, float)) and math.isfinite(out) else None


def _value(t: ast.AST, values: Mapping[str, float]):
    if isinstance(t, ast.BinOp):
        a, b = _value(t.left, values), _value(t.right, values)
        if isinstance(t.op, ast.Add):
            return a + b
        if isinstance(t.op, ast.Sub):
            return a - b
        if isinstance(t.op, ast.Mult):
            return a * b
        return a / b if isinstance(t.op, ast.Div) else a**b
    if isinstance(t, ast.UnaryOp):
        return -_value(t.operand, values) if isinstance(t.op, ast.USub) else _value(t.operand, values)
    if isinstance(t, ast.Call):
        return FUNCTIONS[_function(t)](_value(t.args[0], values))
    if isinstance(t, ast.Attribute):
        return CONSTANTS[t.attr]
    if isinstance(t, ast.Name):
        return values[t.id] if t.id in values else CONSTANTS[t.id]
    return t.value


def column(formula: str, value_of) -> Column:
    """The formula as a Column inside code generation; ``value_of`` gives the Column of a name. Null where undefined."""
    tree = parse(formula)
    return F.lit(None).cast("double") if tree is None else _column(tree, value_of)


def _column(t: ast.AST, value_of) -> Column:
    if isinstance(t, ast.BinOp):
        a, b = _column(t.left, value_of), _column(t.right, value_of)
        if isinstance(t.op, ast.Add):
            return a + b
        if isinstance(t.op, ast.Sub):
            return a - b
        if isinstance(t.op, ast.Mult):
            return a * b
        return F.try_divide(a, b) if isinstance(t.op, ast.Div) else F.pow(a, b)
    if isinstance(t, ast.UnaryOp):
        return -_column(t.operand, value_of) if isinstance(t.op, ast.USub) else _column(t.operand, value_of)
    if isinstance(t, ast.Call):
        x, f = _column(t.args[0], value_of), _function(t)
        if f in ("sqrt", "log", "log10"):
            x = F.when(x >= 0 if f == "sqrt" else x > 0, x)
        return getattr(F, f)(x)
    if isinstance(t, ast.Attribute):
        return F.lit(CONSTANTS[t.attr])
    if isinstance(t, ast.Name):
        return F.lit(CONSTANTS[t.id]) if t.id in CONSTANTS else value_of(t.id)
    return F.lit(float(t.value))
