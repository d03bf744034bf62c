"""Rules written as Python expressions, compiled to Columns. Nothing is evaluated as Python.

``compile_rule`` reads the syntax tree of a rule and accepts a short list of nodes: constants, names, ``and or not``, comparisons (also
chained, ``in``, ``is None``), arithmetic, ``x if c else y``, lists, comprehensions over lists, parts of texts, and the calls in
``CALLS`` and ``METHODS``. Everything else (attributes, lambdas, assignments, other calls and names) is a :class:`RuleError`.

What a rule means is what Python says about a row of a data frame:

- A missing value is NaN: no comparison but ``!=`` holds, ``not in`` holds, arithmetic gives NaN, and as a condition it is true.
- A number never equals a text; ordering them, or taking the length of a number or of a missing text, raises. A row for which a rule
  raises has no answer, whatever answer is looked for. ``and``, ``or``, ``any``, ``all`` and conditional expressions only evaluate what
  Python would, so ``isinstance(a, str) and len(a) > 3`` does not raise for a missing ``a``.
- Dividing by zero does not raise, as the cells of a data frame do not: it gives an infinity or NaN, for whole numbers ``//`` and ``%`` give 0. A
  remainder has the sign of the divisor.

``isinstance`` follows the type of the column: whole numbers are ``int``, others ``float``, a missing value is a ``float``. A number that leaves the range
of its type counts as NaN.
"""
from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import strip


class RuleError(ValueError):
    """The rule is no expression that can be compiled."""


@dataclass(eq=False)
class Value:
    """What an expression gives: a column of one kind (``int``, ``float``, ``bool``, ``text``), None, a list of known length, or a choice
    between two values. ``raises`` holds where evaluating it raises (None: nowhere)."""
    kind: str
    col: Column | None = None
    raises: Column | object | None = None
    items: Sequence[tuple[Value | None, Value]] = ()  # of a list: a condition on the element, and the element
    unique: bool = False  # of a list: a set
    test: Column | None = None  # of a choice
    missing: Column | None = None  # of a text that may be missing


#: ``raises`` of what raises for every row.
ALWAYS = object()
NUMBERS = ("int", "float", "bool")


def _either(*raises: Column | None) -> Column | None:
    """Where any of these raises."""
    known: list[Column] = []
    for r in raises:
        if r is not None and not any(r is k for k in known):
            known.append(r)
    if any(r is ALWAYS for r in known):
        return ALWAYS
    out = None
    for r in known:
        out = r if out is None else out | r
    return out


def _only_if(test: Column, raises: Column | None, before: Column | None = None) -> Column | None:
    """Where ``raises`` holds and it comes to that; ``before``: what was evaluated first and may raise alike."""
    if raises is None or raises is before:
        return None
    return test if raises is ALWAYS else test & raises


def _boolean(col: Column, *raises: Column | None) -> Value:
    return Value("bool", col, _either(*raises))


def _raising() -> Value:
    return Value("bool", F.lit(False), ALWAYS)


def _choice(test: Column, yes: Value, no: Value, raises: Column | None = None) -> Value:
    """``yes`` where ``test`` holds, else ``no``; one column if both are of one kind."""
    both = _either(raises, _only_if(test, yes.raises), _only_if(~test, no.raises))
    if yes.kind == no.kind and yes.kind not in ("list", "choice", "none"):
        missing = None
        if yes.kind == "text":
            missing = F.when(test, _missing(yes)).otherwise(_missing(no))
        return Value(yes.kind, F.when(test, yes.col).otherwise(no.col), both, missing=missing)
    if yes.kind in NUMBERS and no.kind in NUMBERS and "bool" not in (yes.kind, no.kind):
        return Value("float", F.when(test, yes.col.cast("double")).otherwise(no.col.cast("double")), both)
    return Value("choice", raises=both, items=((None, yes), (None, no)), test=test)


def _spread(function: Callable[..., Value], *values: Value) -> Value:
    """``function`` of values of which some are choices."""
    for k, v in enumerate(values):
        if v.kind == "choice":
            yes, no = (_spread(function, *values[:k], side, *values[k + 1:]) for _, side in v.items)
            made = _choice(v.test, yes, no)
            return Value(made.kind, made.col, _either(v.raises, made.raises), made.items, made.unique, made.test, made.missing)
    return function(*values)


def _missing(text: Value) -> Column:
    return text.missing if text.missing is not None else F.lit(False)


def _number(v: Value) -> Column:
    return v.col.cast("int") if v.kind == "bool" else v.col


def constant(value) -> Value:
    if value is None:
        return Value("none")
    if isinstance(value, bool):
        return Value("bool", F.lit(value))
    if isinstance(value, int) and -(1 << 63) <= value < 1 << 63:
        return Value("int", F.lit(value).cast("bigint"))
    if isinstance(value, (int, float)):
        return Value("float", F.lit(float(value)))
    if isinstance(value, str):
        return Value("text", F.lit(value))
    raise RuleError(f"no constant {value!r}")


def words(texts: Sequence[str]) -> Value:
    return Value("list", items=[(None, constant(t)) for t in texts])


def column(df: DataFrame, name: str) -> Value:
    """A column as a rule sees it; NaN and null are one."""
    kind, col = df.schema[name].dataType, F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, T.BooleanType):
        return Value("float", col.cast("double"))  # a boolean with missing values
    if isinstance(kind, T.IntegralType):
        return Value("int", col.cast("bigint"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Value("float", F.nanvl(col.cast("double"), F.lit(None)))
    if isinstance(kind, T.DecimalType):
        return Value("float", col.cast("double"))
    if isinstance(kind, T.StringType):
        return Value("text", col, missing=col.isNull())
    raise RuleError(f"column {name} is {kind.simpleString()}, neither number nor text")


# ------------------------------------------------------------------------ what operators mean

def truth(value: Value) -> Value:
    """The value as a condition."""
    def of(v: Value) -> Value:
        if v.kind == "bool":
            return v
        if v.kind == "none":
            return Value("bool", F.lit(False), v.raises)
        if v.kind == "list":
            if any(c is not None for c, _ in v.items):
                return compare(ast.Gt, length(v), constant(0))
            return Value("bool", F.lit(bool(v.items)), v.raises)
        empty = F.lit("") if v.kind == "text" else F.lit(0)
        return Value("bool", F.coalesce(v.col != empty, F.lit(True)), v.raises)
    return _spread(of, value)


def negated(value: Value) -> Value:
    t = truth(value)
    return Value("bool", ~t.col, t.raises)


def both(left: Value, right: Value) -> Value:
    """``left and right``"""
    return _second(left, right, truth(left).col, operator.and_)


def either(left: Value, right: Value) -> Value:
    """``left or right``"""
    return _second(left, right, ~truth(left).col, operator.or_)


def _joined(join: Callable[[Value, Value], Value], values: Sequence[Value]) -> Value:
    """``and`` or ``or`` of several values, as a tree of small depth."""
    if len(values) == 1:
        return values[0]
    half = len(values) // 2
    return join(_joined(join, values[:half]), _joined(join, values[half:]))


def _second(left: Value, second: Value, goes_on: Column, join: Callable[[Column, Column], Column]) -> Value:
    """``left``, or ``second`` where it goes on. Conditions are never null, so they are joined as such."""
    first = truth(left)
    raises = _either(first.raises, _only_if(goes_on, second.raises, first.raises))
    if raises is ALWAYS:
        return _raising()
    if left.kind == "bool" and second.kind == "bool":
        return Value("bool", join(left.col, second.col), raises)
    plain = [Value(v.kind, v.col, None, v.items, v.unique, v.test, v.missing) for v in (second, left)]
    made = _choice(goes_on, *plain)
    return Value(made.kind, made.col, raises, made.items, made.unique, made.test, made.missing)


def equal(a: Value, b: Value) -> Value:
    def of(x: Value, y: Value) -> Value:
        raises = _either(x.raises, y.raises)
        if x.kind in NUMBERS and y.kind in NUMBERS:
            return _boolean(F.coalesce(_number(x) == _number(y), F.lit(False)), raises)
        if x.kind == y.kind == "text":
            return _boolean(F.coalesce(x.col == y.col, F.lit(False)), raises)
        if x.kind == y.kind == "none":
            return _boolean(F.lit(True), raises)
        if "list" in (x.kind, y.kind) and x.kind == y.kind:
            raise RuleError("lists are not compared")
        return _boolean(F.lit(False), raises)
    return _spread(of, a, b)


def unlike(x: Value, y: Value) -> Column | None:
    """Where one of two texts is missing; two missing ones are two NaN, which go together."""
    if x.missing is not None and y.missing is not None:
        return x.missing != y.missing
    return x.missing if x.missing is not None else y.missing


_ORDER = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def compare(op: type, a: Value, b: Value) -> Value:
    if op is ast.Eq:
        return equal(a, b)
    if op is ast.NotEq:
        return negated(equal(a, b))
    if op is ast.In:
        return _spread(contained, a, b)
    if op is ast.NotIn:
        return negated(_spread(contained, a, b))
    if op in (ast.Is, ast.IsNot):
        if "none" not in (a.kind, b.kind):
            raise RuleError("only None is compared with is")
        same = Value("bool", F.lit(a.kind == b.kind), _either(a.raises, b.raises))
        return same if op is ast.Is else negated(same)

    def of(x: Value, y: Value) -> Value:
        raises = _either(x.raises, y.raises)
        if x.kind in NUMBERS and y.kind in NUMBERS:
            return _boolean(F.coalesce(_ORDER[op](_number(x), _number(y)), F.lit(False)), raises)
        if x.kind == y.kind == "text":
            return _boolean(F.coalesce(_ORDER[op](x.col, y.col), F.lit(False)), raises, unlike(x, y))
        if {x.kind, y.kind} & set(NUMBERS) and "text" in (x.kind, y.kind):
            text = x if x.kind == "text" else y
            return _boolean(F.lit(False), raises, ~text.missing if text.missing is not None else ALWAYS)
        return _raising()
    return _spread(of, a, b)


def contained(item: Value, container: Value) -> Value:
    raises = _either(item.raises, container.raises)
    if container.kind == "list":
        found = [(c, equal(item, element)) for c, element in container.items]
        out = _any(Value("list", items=found), True)
        return Value("bool", out.col, _either(raises, out.raises))
    if container.kind == "text" and item.kind == "text":
        return _boolean(F.coalesce(F.contains(container.col, item.col), F.lit(False)), raises, container.missing, item.missing)
    return _raising()


def _ieee_division(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    infinite = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    return F.when(y == 0, infinite).otherwise(F.try_divide(x, y))


def _remainder(x: Column, y: Column) -> Column:
    return F.when(y != 0, F.try_mod(F.try_add(F.try_mod(x, y), y), y))


def arithmetic(op: type, a: Value, b: Value) -> Value:
    def of(x: Value, y: Value) -> Value:
        raises = _either(x.raises, y.raises)
        if op is ast.Add and x.kind == y.kind == "list":
            return Value("list", items=[*x.items, *y.items], raises=raises)
        if op is ast.Add and x.kind == y.kind == "text":
            none = _missing(x) & _missing(y)  # two missing texts are two NaN, and so is their sum
            return Value("text", F.concat(x.col, y.col), _either(raises, unlike(x, y)), missing=none)
        if {x.kind, y.kind} <= {*NUMBERS, "text"} and x.kind != y.kind and "text" in (x.kind, y.kind):
            text = x if x.kind == "text" else y
            if text.missing is not None:
                return Value("float", F.lit(None).cast("double"), _either(raises, ~text.missing))
        if x.kind not in NUMBERS or y.kind not in NUMBERS:
            return _raising()
        kind = "float" if "float" in (x.kind, y.kind) else "int"
        cast = "double" if kind == "float" else "bigint"
        m, n = _number(x).cast(cast), _number(y).cast(cast)
        if op in (ast.Add, ast.Sub, ast.Mult):
            made = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[op](m, n)
        elif op is ast.Div:
            kind, made = "float", _ieee_division(m, n)
        elif op is ast.Mod:
            made = _remainder(m, n) if kind == "float" else F.when(n == 0, F.lit(0).cast(cast)).otherwise(_remainder(m, n))
        elif op is ast.FloorDiv:
            whole = F.try_divide(F.try_subtract(m, _remainder(m, n)), n)
            made = (F.when(n == 0, F.lit(0).cast(cast)).otherwise(F.round(whole).cast(cast)) if kind == "int"
                    else F.when(n == 0, _ieee_division(m, n)).otherwise(F.round(whole)))
        else:
            raise RuleError(f"no operator {op.__name__}")
        return Value(kind, made, raises)
    return _spread(of, a, b)


# ------------------------------------------------------------------------ calls

def length(value: Value) -> Value:
    def of(v: Value) -> Value:
        if v.kind == "text":
            return Value("int", F.length(v.col).cast("bigint"), _either(v.raises, v.missing))
        if v.kind != "list":
            return _raising()
        out = Value("int", F.lit(0).cast("bigint"), v.raises)
        for k, (condition, element) in enumerate(v.items):
            counts = constant(True) if condition is None else truth(condition)
            if v.unique:
                for before, other in v.items[:k]:
                    same = equal(other, element)
                    counts = both(counts, negated(same if before is None else both(truth(before), same)))
            out = arithmetic(ast.Add, out, counts)
        return out
    return _spread(of, value)


def _any(v: Value, stop: bool) -> Value:
    """``any`` (stop at true) or ``all`` (stop at false)."""
    if v.kind != "list":
        return _raising()
    if not v.items:
        return Value("bool", F.lit(not stop), v.raises)
    found = []
    for condition, element in v.items:
        here = truth(element)
        if condition is not None:
            here = both(truth(condition), here) if stop else either(negated(condition), here)
        found.append(here)
    out = _joined(either if stop else both, found)
    return Value("bool", out.col, _either(v.raises, out.raises))


def _sum(v: Value) -> Value:
    if v.kind != "list":
        return _raising()
    out = constant(0)
    for condition, element in v.items:
        added = element
        if condition is not None:
            t = truth(condition)
            added = _choice(t.col, element, constant(0), t.raises)
        out = arithmetic(ast.Add, out, added)
    return Value(out.kind, out.col, _either(v.raises, out.raises))


def _text(v: Value) -> Value:
    if v.kind == "text":
        return Value("text", F.coalesce(v.col, F.lit("nan")), v.raises)
    if v.kind == "bool":
        return Value("text", F.when(v.col, "True").otherwise("False"), v.raises)
    if v.kind == "int":
        return Value("text", F.coalesce(v.col.cast("string"), F.lit("nan")), v.raises)
    if v.kind == "float":
        whole = (F.abs(v.col) < 1e15) & (F.floor(v.col) == v.col)
        shown = F.when(whole, F.concat(v.col.cast("bigint").cast("string"), F.lit(".0"))).otherwise(v.col.cast("string"))
        return Value("text", F.coalesce(shown, F.lit("nan")), v.raises)
    if v.kind == "none":
        return constant("None")
    raise RuleError("a list is not turned into text")


_WHOLE, _REAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _to_number(v: Value, kind: str) -> Value:
    cast = "bigint" if kind == "int" else "double"
    if v.kind == "text":
        body = strip(v.col)
        good = F.coalesce(body.rlike(_WHOLE if kind == "int" else _REAL), F.lit(False))
        if kind == "float" and v.missing is not None:
            good = good | v.missing  # float(NaN)
        return Value(kind, F.when(body.rlike(_REAL), body.try_cast(cast)), _either(v.raises, ~good))
    if v.kind not in NUMBERS:
        return _raising()
    if kind == "float":
        return Value(kind, _number(v).cast("double"), v.raises)
    bad = None if v.kind == "bool" else F.coalesce(F.abs(v.col) >= float(1 << 63), F.lit(True))
    col = F.when(F.abs(v.col) < float(1 << 63), v.col.cast("bigint")) if v.kind == "float" else _number(v).cast("bigint")
    return Value(kind, col, _either(v.raises, bad))


def _as_list(v: Value, unique: bool) -> Value:
    if v.kind != "list":
        raise RuleError("only lists are turned into lists or sets")
    return Value("list", items=v.items, raises=v.raises, unique=unique or v.unique)


def _absent(v: Value) -> Value:
    def of(x: Value) -> Value:
        if x.kind == "none":
            return Value("bool", F.lit(True), x.raises)
        return Value("bool", x.col.isNull(), x.raises)
    return _spread(of, v)


_IS = {"str": "text", "int": "int", "float": "float", "bool": "bool"}


def _is_instance(v: Value, names: Sequence[str]) -> Value:
    def of(x: Value) -> Value:
        wanted = {_IS[n] for n in names}
        if x.kind == "bool":
            return Value("bool", F.lit(bool(wanted & {"bool", "int"})), x.raises)
        if x.kind in ("none", "list"):
            return Value("bool", F.lit(False), x.raises)
        return Value("bool", F.when(x.col.isNull(), F.lit("float" in wanted)).otherwise(F.lit(x.kind in wanted)), x.raises)
    return _spread(of, v)


def _method(name: str) -> Callable[..., Value]:
    def starts(x: Value, part: Value) -> Value:
        parts = [e for _, e in part.items] if part.kind == "list" else [part]
        out = constant(False)
        for p in parts:
            if p.kind != "text":
                return _raising()
            test = F.startswith if name == "startswith" else F.endswith
            out = Value("bool", out.col | F.coalesce(test(x.col, p.col), F.lit(False)), _either(out.raises, p.raises, p.missing))
        return out

    def replaced(x: Value, old: Value, new: Value) -> Value:
        if old.kind != "text" or new.kind != "text":
            return _raising()
        return Value("text", F.replace(x.col, old.col, new.col), _either(old.raises, new.raises, old.missing, new.missing))

    plain = {"strip": strip, "lower": F.lower, "upper": F.upper}
    if name in plain:
        return lambda x: Value("text", plain[name](x.col))
    if name == "isdigit":
        return lambda x: Value("bool", F.coalesce(x.col.rlike(r"^\p{Nd}+$"), F.lit(False)))
    return replaced if name == "replace" else starts


CALLS: dict[str, Callable[[Value], Value]] = {
    "any": lambda v: _any(v, True), "all": lambda v: _any(v, False), "sum": _sum, "len": length, "bool": truth,
    "str": lambda v: _spread(_text, v), "int": lambda v: _spread(lambda x: _to_number(x, "int"), v),
    "float": lambda v: _spread(lambda x: _to_number(x, "float"), v), "list": lambda v: _as_list(v, False),
    "set": lambda v: _as_list(v, True), "tuple": lambda v: _as_list(v, False),
    "abs": lambda v: _spread(lambda x: Value(x.kind, F.abs(x.col), x.raises) if x.kind in ("int", "float") else _raising(), v)}
METHODS = {"strip": 0, "lower": 0, "upper": 0, "isdigit": 0, "startswith": 1, "endswith": 1, "replace": 2}
_ABSENT = {"isna": True, "isnull": True, "isnan": True, "notna": False, "notnull": False}


# ------------------------------------------------------------------------ the compiler

class _Compiler:
    def __init__(self, names: Mapping[str, Value]) -> None:
        self.names = dict(names)

    def __call__(self, node: ast.AST) -> Value:
        visit = getattr(self, f"_{type(node).__name__}", None)
        if visit is None:
            raise RuleError(f"{type(node).__name__} is not allowed in a rule")
        return visit(node)

    def _Constant(self, node: ast.Constant) -> Value:
        return constant(node.value)

    def _Name(self, node: ast.Name) -> Value:
        if node.id not in self.names:
            raise RuleError(f"no name {node.id!r}")
        return self.names[node.id]

    def _List(self, node) -> Value:
        made = [self(e) for e in node.elts]
        return Value("list", items=[(None, v) for v in made], raises=_either(*[v.raises for v in made]))

    _Tuple = _List

    def _Set(self, node: ast.Set) -> Value:
        return _as_list(self._List(node), True)

    def _BoolOp(self, node: ast.BoolOp) -> Value:
        return _joined(both if isinstance(node.op, ast.And) else either, [self(v) for v in node.values])

    def _UnaryOp(self, node: ast.UnaryOp) -> Value:
        value = self(node.operand)
        if isinstance(node.op, ast.Not):
            return negated(value)
        if isinstance(node.op, (ast.USub, ast.UAdd)):
            return arithmetic(ast.Sub if isinstance(node.op, ast.USub) else ast.Add, constant(0), value)
        raise RuleError(f"{type(node.op).__name__} is not allowed in a rule")

    def _BinOp(self, node: ast.BinOp) -> Value:
        return arithmetic(type(node.op), self(node.left), self(node.right))

    def _Compare(self, node: ast.Compare) -> Value:
        left, out = self(node.left), None
        for op, right_node in zip(node.ops, node.comparators):
            right = self(right_node)
            here = compare(type(op), left, right)
            out = here if out is None else both(out, here)
            left = right
        return out

    def _IfExp(self, node: ast.IfExp) -> Value:
        test = truth(self(node.test))
        return _choice(test.col, self(node.body), self(node.orelse), test.raises)

    def _GeneratorExp(self, node) -> Value:
        items: list[tuple[Value | None, Value]] = []
        raises: list[Column | None] = []

        def go(k: int, condition: Value | None) -> None:
            if k == len(node.generators):
                items.append((condition, self(node.elt)))
                return
            part = node.generators[k]
            if not isinstance(part.target, ast.Name) or part.is_async:
                raise RuleError("a comprehension has one name")
            over = self(part.iter)
            if over.kind != "list":
                raise RuleError("a comprehension goes over a list of known length")
            raises.append(over.raises)
            hidden = self.names.get(part.target.id)
            for given, element in over.items:
                self.names[part.target.id] = element
                here = condition
                for test in [given, *part.ifs]:
                    if test is not None:
                        value = test if isinstance(test, Value) else self(test)
                        here = truth(value) if here is None else both(here, truth(value))
                go(k + 1, here)
            if hidden is None:
                self.names.pop(part.target.id, None)
            else:
                self.names[part.target.id] = hidden

        go(0, None)
        return Value("list", items=items, raises=_either(*raises), unique=isinstance(node, ast.SetComp))

    _ListComp = _SetComp = _GeneratorExp

    def _Subscript(self, node: ast.Subscript) -> Value:
        value = self(node.value)

        def bound(part: ast.AST | None) -> int | None:
            if part is None:
                return None
            try:
                k = ast.literal_eval(part)
            except ValueError:
                k = None
            if not isinstance(k, int) or isinstance(k, bool):
                raise RuleError("parts are taken by whole numbers")
            return k

        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise RuleError("parts are taken without a step")
            low, high, one = bound(node.slice.lower), bound(node.slice.upper), False
        else:
            low, one = bound(node.slice), True
            high = None
        if value.kind == "list" and all(c is None for c, _ in value.items):
            if not one:
                return Value("list", items=value.items[low:high], raises=value.raises)
            return value.items[low][1] if -len(value.items) <= low < len(value.items) else _raising()
        return _spread(lambda x: self._part(x, low, high, one), value)

    @staticmethod
    def _part(x: Value, low: int | None, high: int | None, one: bool) -> Value:
        if x.kind != "text":
            return _raising()
        size = F.length(x.col)

        def place(k: int | None, default: Column) -> Column:
            if k is None:
                return default
            return F.least(F.lit(k), size) if k >= 0 else F.greatest(size + k, F.lit(0))

        start = place(low, F.lit(0))
        if one:
            short = size < (low + 1 if low >= 0 else -low)
            return Value("text", F.substr(x.col, start + 1, F.lit(1)), _either(x.raises, x.missing, F.coalesce(short, F.lit(False))))
        return Value("text", F.substr(x.col, start + 1, F.greatest(place(high, size) - start, F.lit(0))), _either(x.raises, x.missing))

    def _Call(self, node: ast.Call) -> Value:
        if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise RuleError("calls have plain arguments")
        called = node.func
        if isinstance(called, ast.Attribute):
            if isinstance(called.value, ast.Name) and called.value.id in ("pd", "np") and called.attr in _ABSENT and len(node.args) == 1:
                absent = _absent(self(node.args[0]))
                return absent if _ABSENT[called.attr] else negated(absent)
            if METHODS.get(called.attr) != len(node.args):
                raise RuleError(f"no method {called.attr!r} with {len(node.args)} arguments")
            return self._on_text(called.attr, self(called.value), [self(a) for a in node.args])
        if not isinstance(called, ast.Name):
            raise RuleError(f"{type(called).__name__} is not called in a rule")
        if called.id == "isinstance" and len(node.args) == 2:
            kinds = node.args[1].elts if isinstance(node.args[1], ast.Tuple) else [node.args[1]]
            if not all(isinstance(k, ast.Name) and k.id in _IS for k in kinds):
                raise RuleError("isinstance knows str, int, float and bool")
            return _is_instance(self(node.args[0]), [k.id for k in kinds])
        if called.id not in CALLS or len(node.args) != 1:
            raise RuleError(f"no function {called.id!r} with {len(node.args)} arguments")
        return CALLS[called.id](self(node.args[0]))

    @staticmethod
    def _on_text(name: str, value: Value, arguments: list[Value]) -> Value:
        def of(x: Value, *rest: Value) -> Value:
            if x.kind != "text":
                return _raising()
            made = _method(name)(x, *rest)
            return Value(made.kind, made.col, _either(x.raises, x.missing, *[r.raises for r in rest], made.raises))
        return _spread(of, value, *arguments)


def compile_rule(text: str, names: Mapping[str, Value]) -> Value:
    """The rule over these names. Line breaks count as spaces."""
    try:
        tree = ast.parse(" ".join(str(text).split("\n")).replace("\r", " ").strip(), mode="eval")
        return _Compiler(names)(tree.body)
    except (SyntaxError, RecursionError, MemoryError) as problem:
        raise RuleError(f"not an expression: {problem}") from None
    except RuleError:
        raise
    except ValueError as problem:  # a null character
        raise RuleError(f"not an expression: {problem}") from None


def holds(value: Value) -> Column:
    """Where the rule, as a condition, is true and does not raise."""
    return _without(truth(value))


def answers(value: Value, wanted: bool) -> Column:
    """Where the rule gives exactly this answer (1 and 0 equal True and False) and does not raise."""
    return _without(equal(value, constant(wanted)))


def _without(condition: Value) -> Column:
    if condition.raises is ALWAYS:
        return F.lit(False)
    return condition.col if condition.raises is None else ~condition.raises & condition.col


def raising(value: Value) -> Column:
    """Where the rule raises."""
    if value.raises is ALWAYS:
        return F.lit(True)
    return F.lit(False) if value.raises is None else value.raises
