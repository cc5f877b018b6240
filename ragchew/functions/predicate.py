"""Row predicates as users write them, as a column.

``predicate("speed >= 24 and band in [10, 20] and not dx == 'ST1'", columns)``. The text is read by Python's own
parser; only the node kinds, columns and functions listed here are let through, so a text cannot reach other SQL
functions. Names are columns; in front of a name that is no Python word use backticks.

Missing values compare as in a data frame library: a comparison with a missing value is false, ``!=`` and ``not in``
are true, and ``not`` turns either round.
"""

from __future__ import annotations

import ast
import io
import operator
import re
import tokenize

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq}
ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Mod: F.try_mod}
# Functions of one value, and methods of a text column (``dx.str.startswith("ST")``) or any column (``db.isnull()``).
FUNCTIONS = {"abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt}
TEXT_METHODS = {"startswith": Column.startswith, "endswith": Column.endswith, "contains": Column.contains}
COLUMN_METHODS = {"isnull": Column.isNull, "isna": Column.isNull, "notnull": Column.isNotNull, "notna": Column.isNotNull}


def predicate(text: str, columns: list[str]) -> Column:
    """The condition that ``text`` states over ``columns``; ``ValueError`` for anything that is not let through."""
    quoted: dict[str, str] = {}

    def plain(found: re.Match) -> str:
        return quoted.setdefault(found.group(1), f"__quoted_{len(quoted)}")

    try:
        tree = ast.parse(_words_for_signs(re.sub(r"`([^`]+)`", plain, text.strip())), mode="eval")
    except (SyntaxError, ValueError, tokenize.TokenError) as error:
        raise ValueError(f"not a predicate: {text!r}") from error
    names = {word: name for name, word in quoted.items()}
    return _truth(tree.body, set(columns), names)


def _words_for_signs(text: str) -> str:
    """``&`` and ``|`` bind like ``and`` and ``or``."""
    signs = {"&": " and ", "|": " or "}
    found = tokenize.generate_tokens(io.StringIO(text).readline)
    return tokenize.untokenize((t.type, signs.get(t.string, t.string) if t.type == tokenize.OP else t.string) for t in found).strip()


def _refuse(node: ast.AST) -> ValueError:
    return ValueError(f"not allowed in a predicate: {ast.unparse(node)}")


def _truth(node: ast.AST, columns: set, names: dict) -> Column:
    """A condition that is true or false, never null."""
    if isinstance(node, ast.BoolOp):
        parts = [_truth(v, columns, names) for v in node.values]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if isinstance(node.op, ast.And) else out | part
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
        return ~_truth(node.operand, columns, names)
    if isinstance(node, ast.Compare):
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators):
            one = _compare(op, left, right, columns, names)
            out = one if out is None else out & one
            left = right
        return out
    if isinstance(node, ast.Constant) and isinstance(node.value, bool):
        return F.lit(node.value)
    return F.coalesce(_value(node, columns, names).cast("boolean"), F.lit(False))


def _compare(op: ast.cmpop, left: ast.AST, right: ast.AST, columns: set, names: dict) -> Column:
    if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
        items = [ast.literal_eval(e) if isinstance(e, (ast.Constant, ast.UnaryOp)) else None for e in right.elts]
        if None in items or not isinstance(op, (ast.In, ast.NotIn, ast.Eq, ast.NotEq)):
            raise _refuse(right)
        inside = F.coalesce(_value(left, columns, names).isin(items), F.lit(False))
        return inside if isinstance(op, (ast.In, ast.Eq)) else ~inside
    a, b = _value(left, columns, names), _value(right, columns, names)
    if isinstance(op, ast.NotEq):
        return F.coalesce(a != b, F.lit(True))
    if type(op) not in COMPARE:
        raise _refuse(right)
    return F.coalesce(COMPARE[type(op)](a, b), F.lit(False))


def _value(node: ast.AST, columns: set, names: dict) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        name = names.get(node.id, node.id)
        if name not in columns:
            raise ValueError(f"no such column: {name}")
        return F.col(f"`{name}`")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = _value(node.operand, columns, names)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
        return ARITHMETIC[type(node.op)](_value(node.left, columns, names), _value(node.right, columns, names))
    if isinstance(node, ast.Call) and not node.keywords:
        f = node.func
        if isinstance(f, ast.Name) and f.id in FUNCTIONS and len(node.args) == 1:
            return FUNCTIONS[f.id](_value(node.args[0], columns, names))
        if isinstance(f, ast.Attribute):
            of = f.value
            if isinstance(of, ast.Attribute) and of.attr == "str" and f.attr in TEXT_METHODS and len(node.args) == 1:
                part = node.args[0]
                if isinstance(part, ast.Constant) and isinstance(part.value, str):
                    return TEXT_METHODS[f.attr](_value(of.value, columns, names), part.value)
            if f.attr in COLUMN_METHODS and not node.args:
                return COLUMN_METHODS[f.attr](_value(of, columns, names))
    if isinstance(node, (ast.Compare, ast.BoolOp)):
        return _truth(node, columns, names)
    raise _refuse(node)
