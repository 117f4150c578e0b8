"""The small languages, compiled to Spark columns.

    filter_column     row filters in the manner of DataFrame queries: `a > 1 and name in ['x', 'y']`
    value_column      arithmetic over columns, with a list of math functions: `np.log1p(pop) / area`
    rule_column       validation rules: arithmetic and one comparison at a time, no strings
    trigger_column    predicates on old and new values of a change: `new.status == 'x' AND old.n IS NULL`
    predicate_column  nested objects: {"and": [{"attr": "n", "op": "gt", "value": 3}]}
    chain_column      several filters put together by priority
"""

from __future__ import annotations

import ast
import datetime as dt
import math
import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS = 4096


class ExpressionError(ValueError):
    pass


def _bad(node: ast.AST) -> ExpressionError:
    return ExpressionError(f"not allowed in an expression: {type(node).__name__}")


def _divide(a: Column, b: Column) -> Column:
    """Floating division: x/0 is an infinity, 0/0 not a number, never an error."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).when(a.isNotNull(), F.lit(math.nan))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(_divide(a, b))


def _modulo(a: Column, b: Column) -> Column:
    """With the sign of the divisor."""
    safe = F.when(b != 0, b)
    return ((a % safe) + safe) % safe


# the functions that value expressions may call: name -> (arguments, column)
FUNCTIONS = {
    "abs": (1, F.abs), "round": (None, lambda x, n=None: F.bround(x, n if n is None else n)), "absolute": (1, F.abs), "log": (1, F.ln), "log2": (1, F.log2), "log10": (1, F.log10), "log1p": (1, F.log1p),
    "exp": (1, F.exp), "expm1": (1, F.expm1), "sqrt": (1, F.sqrt), "cbrt": (1, F.cbrt), "square": (1, lambda x: x * x), "power": (2, F.pow), "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan),
    "arcsin": (1, F.asin), "arccos": (1, F.acos), "arctan": (1, F.atan), "arctan2": (2, F.atan2), "sinh": (1, F.sinh), "cosh": (1, F.cosh), "tanh": (1, F.tanh), "sign": (1, F.signum),
    "ceil": (1, F.ceil), "floor": (1, F.floor), "trunc": (1, lambda x: F.signum(x) * F.floor(F.abs(x))), "minimum": (2, F.least), "maximum": (2, F.greatest), "clip": (3, lambda x, lo, hi: F.least(F.greatest(x, lo), hi)),
    "isnan": (1, lambda x: F.isnan(x) | x.isNull()), "isfinite": (1, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)), "isinf": (1, lambda x: F.abs(x) == math.inf), "where": (3, lambda c, a, b: F.when(c, a).otherwise(b)),
}
CONSTANTS = {"pi": math.pi, "e": math.e}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: _divide, ast.FloorDiv: _floor_divide, ast.Mod: _modulo, ast.Pow: F.pow}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


class _Compiler:
    def __init__(self, types: dict[str, str], strings: bool = True, chains: bool = True, calls: bool = True, tables=None):
        self.types, self.strings, self.chains, self.calls, self.tables = types, strings, chains, calls, tables or {}
        #: In a row filter null is as good as false outside of `not`, and a bare comparison can be pushed to the scan.
        self.bare = False

    def column(self, text: str) -> Column:
        if len(text) > MOST_CHARS:
            raise ExpressionError("expression too long")
        if "`" in text or "__" in text or "@" in text:
            raise ExpressionError("backticks, dunder names and at-signs are not allowed")
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as e:
            raise ExpressionError(f"cannot read {text!r}") from e
        return self.of(tree.body)

    def text_like(self, n: ast.AST) -> bool:
        if isinstance(n, ast.Constant):
            return isinstance(n.value, str)
        if isinstance(n, ast.Name):
            return self.types.get(n.id) == "string"
        return isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add) and (self.text_like(n.left) or self.text_like(n.right))

    def of(self, n: ast.AST) -> Column:
        if isinstance(n, ast.Constant):
            if isinstance(n.value, str) and not self.strings:
                raise ExpressionError("strings are not allowed here")
            if n.value is not None and not isinstance(n.value, (bool, int, float, str)):
                raise _bad(n)
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            if n.id not in self.types:
                raise ExpressionError(f"unknown column {n.id}")
            return F.col(n.id)
        if isinstance(n, ast.BoolOp):
            return reduce(operator.and_ if isinstance(n.op, ast.And) else operator.or_, [self.of(v) for v in n.values])
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.Not, ast.Invert)):
            was, self.bare = self.bare, False
            x = self.of(n.operand)
            self.bare = was
            return ~F.coalesce(x, F.lit(False))
        if isinstance(n, ast.UnaryOp):
            x = self.of(n.operand)
            return -x if isinstance(n.op, ast.USub) else x
        if isinstance(n, ast.BinOp):
            if isinstance(n.op, (ast.BitAnd, ast.BitOr)):
                return (operator.and_ if isinstance(n.op, ast.BitAnd) else operator.or_)(self.of(n.left), self.of(n.right))
            if type(n.op) not in _ARITHMETIC:
                raise _bad(n.op)
            if isinstance(n.op, ast.Add) and (self.text_like(n.left) or self.text_like(n.right)):
                return F.concat(self.of(n.left).cast("string"), self.of(n.right).cast("string"))
            return _ARITHMETIC[type(n.op)](self.of(n.left), self.of(n.right))
        if isinstance(n, ast.Compare):
            if len(n.ops) > 1 and not self.chains:
                raise ExpressionError("one comparison at a time")
            sides = [n.left, *n.comparators]
            return reduce(operator.and_, [self.compare(a, op, b) for a, op, b in zip(sides, n.ops, sides[1:], strict=False)])
        if isinstance(n, ast.IfExp):
            return F.when(F.coalesce(self.of(n.test), F.lit(False)), self.of(n.body)).otherwise(self.of(n.orelse))
        if isinstance(n, ast.Call) and self.calls:
            return self.call(n)
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in ("np", "numpy") and n.attr in CONSTANTS:
            return F.lit(CONSTANTS[n.attr])
        raise _bad(n)

    def compare(self, a: ast.AST, op: ast.cmpop, b: ast.AST) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(b, (ast.List, ast.Tuple, ast.Set)):
                raise ExpressionError("`in` needs a list")
            values = [ast.literal_eval(x) for x in b.elts]
            hit = self.of(a).isin(values)
            if self.bare and isinstance(op, ast.In):
                return hit
            hit = F.coalesce(hit, F.lit(False))
            return hit if isinstance(op, ast.In) else ~hit
        if type(op) not in _COMPARE:
            raise _bad(op)
        x, y = self.of(a), self.of(b)
        if self.bare and not isinstance(op, ast.NotEq):
            return _COMPARE[type(op)](x, y)
        # missing values: unequal to everything, otherwise false
        return F.coalesce(_COMPARE[type(op)](x, y), F.lit(isinstance(op, ast.NotEq)))

    def call(self, n: ast.Call) -> Column:
        f = n.func
        name = f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("np", "numpy") else f.id if isinstance(f, ast.Name) else None
        if name in self.tables:
            return self.tables[name](self, n)
        if n.keywords:
            raise ExpressionError("no keyword arguments")
        args = [self.of(a) for a in n.args]
        if isinstance(f, ast.Name) and name in ("min", "max"):
            return (F.least if name == "min" else F.greatest)(*args)
        if isinstance(f, ast.Name) and name == "round" and len(n.args) == 2:
            return F.bround(args[0], ast.literal_eval(n.args[1]))
        if name not in FUNCTIONS or (isinstance(f, ast.Name) and name not in ("abs", "round", *self.tables)):
            raise ExpressionError(f"unknown function {name}")
        want, build = FUNCTIONS[name]
        if want is not None and len(args) != want:
            raise ExpressionError(f"{name} takes {want} arguments")
        return F.bround(args[0]) if name == "round" else build(*args)


def _types(df) -> dict[str, str]:
    return dict(df.dtypes)


def _plain(text: str) -> str:
    text = re.sub(r"(?<![<>=!])=(?!=)", "==", text.replace("<>", "!="))
    return re.sub(r"\b(AND|OR|NOT|IN)\b", lambda m: m[0].lower(), text)


def filter_column(df, text: str) -> Column:
    """True where the expression holds, else false. Single = and <> are read as == and !=."""
    return F.coalesce(_Compiler(_types(df)).column(_plain(text)), F.lit(False))


def where_column(df, text: str) -> Column:
    """The same for a row filter: null where filter_column may say false, so that comparisons reach the scan as they are."""
    c = _Compiler(_types(df))
    c.bare = True
    return c.column(_plain(text))


def value_column(df, text: str) -> Column:
    return _Compiler(_types(df)).column(text)


def rule_column(df, text: str, tables=None) -> Column:
    """A rule's value: null where a column it needs is missing."""
    c = _Compiler(_types(df), strings=False, chains=False, tables=tables)
    c.compare = lambda a, op, b: _COMPARE[type(op)](c.of(a), c.of(b)) if type(op) in _COMPARE else (_ for _ in ()).throw(_bad(op))
    return c.column(text)


# ---------------------------------------------------------------- trigger predicates

_WORD = re.compile(r"\s*(?:(?P<num>-?\d+\.?\d*(?:[eE][-+]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|>=|<=|>|<|\(|\)|\[|\]|,)|(?P<id>[A-Za-z_][\w.]*))")
MOST_DEPTH = 32


def trigger_column(text: str, resolve) -> Column:
    """`resolve(path)` gives the column of a dotted path. == and != treat null as a value; order comparisons with null are false."""
    words, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at : at + 20]!r}")
        words.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    words.append(("end", ""))
    k = 0

    def peek(*names: str) -> bool:
        return words[k][1].upper() in names if words[k][0] in ("id", "op") else False

    def take(name: str | None = None):
        nonlocal k
        w = words[k]
        if name and not peek(name):
            raise ExpressionError(f"{name} expected, not {w[1]!r}")
        k += 1
        return w

    def either(depth: int) -> Column:
        if depth > MOST_DEPTH:
            raise ExpressionError("nested too deeply")
        out = both(depth)
        while peek("OR"):
            take()
            out = out | both(depth)
        return out

    def both(depth: int) -> Column:
        out = one(depth)
        while peek("AND"):
            take()
            out = out & one(depth)
        return out

    def literal():
        kind, w = take()
        if kind == "num":
            return float(w) if re.search(r"[.eE]", w) else int(w)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", w[1:-1])
        if kind == "id" and w.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[w.upper()]
        raise ExpressionError(f"value expected, not {w!r}")

    def side() -> Column:
        if words[k][0] == "id" and words[k][1].upper() not in ("TRUE", "FALSE", "NULL"):
            return resolve(take()[1])
        return F.lit(literal())

    def one(depth: int) -> Column:
        if peek("NOT"):
            take()
            return ~one(depth + 1)
        if peek("("):
            take()
            out = either(depth + 1)
            take(")")
            return out
        left = side()
        if peek("IS"):
            take()
            no = peek("NOT") and bool(take())
            take("NULL")
            return left.isNotNull() if no else left.isNull()
        no = peek("NOT") and bool(take())
        if no or peek("IN"):
            take("IN")
            take("[")
            values = []
            while not peek("]"):
                values.append(literal())
                if peek(","):
                    take()
            take("]")
            hit = F.coalesce(left.isin([v for v in values if v is not None]), F.lit(False)) | (left.isNull() if None in values else F.lit(False))
            return ~hit if no else hit
        op = take()[1]
        right = side()
        if op == "==":
            return left.eqNullSafe(right)
        if op == "!=":
            return ~left.eqNullSafe(right)
        tests = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
        if op not in tests:
            raise ExpressionError(f"unknown operator {op!r}")
        return F.coalesce(tests[op](left, right), F.lit(False))

    out = either(0)
    if words[k][0] != "end":
        raise ExpressionError(f"unexpected {words[k][1]!r}")
    return out


# ---------------------------------------------------------------- predicate objects


def like_column(c: Column, pattern: str) -> Column:
    """SQL LIKE without regard to case."""
    return c.ilike(pattern)


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(text) -> float:
    """A number of seconds, or text like 15m, 2 h, 1d."""
    if isinstance(text, (int, float)):
        return float(text)
    m = re.fullmatch(r"\s*(\d+\.?\d*)\s*([a-zA-Z]*)\s*", text)
    if not m or (m[2] and m[2][0].lower() not in _UNITS):
        raise ExpressionError(f"no duration: {text!r}")
    if m[2].lower().startswith("ms"):
        return float(m[1]) / 1000
    return float(m[1]) * (_UNITS[m[2][0].lower()] if m[2] else 1)


def attribute_column(df, attr: str, op: str, value=None, now: dt.datetime | None = None) -> Column:
    """One attribute test. On a missing value every test but is_null is false."""
    if attr not in df.columns:
        return F.lit(op == "is_null")
    c = F.col(attr)
    now = F.lit(now) if now else F.current_timestamp()
    time = lambda: c.try_cast("timestamp") if hasattr(c, "try_cast") else c.cast("timestamp")
    tests = {
        "eq": lambda: c == value, "neq": lambda: c != value, "ne": lambda: c != value, "gt": lambda: c > value, "lt": lambda: c < value, "gte": lambda: c >= value, "lte": lambda: c <= value,
        "in": lambda: c.isin(list(value)), "not_in": lambda: ~c.isin(list(value)), "like": lambda: like_column(c.cast("string"), value), "is_null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(),
        "age_gt": lambda: F.unix_micros(now) - F.unix_micros(time()) > seconds(value) * 1e6, "age_lt": lambda: F.unix_micros(now) - F.unix_micros(time()) < seconds(value) * 1e6,
        "before": lambda: time() < F.lit(value).cast("timestamp"), "after": lambda: time() > F.lit(value).cast("timestamp"),
        "between": lambda: (time() >= F.lit(value[0]).cast("timestamp")) & (time() <= F.lit(value[1]).cast("timestamp")) if isinstance(value[0], str) else c.between(value[0], value[1]),
    }
    if op not in tests:
        raise ExpressionError(f"unknown test {op}")
    return F.coalesce(tests[op](), F.lit(False))


def predicate_column(df, tree: dict, geometry=None, now: dt.datetime | None = None) -> Column:
    """`geometry(test)` gives the column of a geometry test (a dict with `geom_op`)."""
    if "and" in tree:
        return reduce(operator.and_, [predicate_column(df, t, geometry, now) for t in tree["and"]], F.lit(True))
    if "or" in tree:
        return reduce(operator.or_, [predicate_column(df, t, geometry, now) for t in tree["or"]], F.lit(False))
    if "not" in tree:
        return ~predicate_column(df, tree["not"], geometry, now)
    if "geom_op" in tree:
        if geometry is None:
            raise ExpressionError("geometry tests need a geometry column")
        return F.coalesce(geometry(tree), F.lit(False))
    return attribute_column(df, tree["attr"], tree["op"], tree.get("value"), now)


#: Filters by kind and their rank when none is given.
PRIORITIES = {"spatial": 100, "attribute": 90, "temporal": 80, "expression": 70, "range": 60, "category": 50, "search": 45, "selection": 40, "custom": 30}


def chain_column(df, filters: list[dict], strategy: str = "priority_and", custom: str | None = None) -> Column:
    """Filters {type, expression or predicate, priority?, enabled?, name?} put together.

    priority_and / priority_or join them in order of rank; replace takes the first; custom is an expression over their names.
    """
    live = [f for f in filters if f.get("enabled", True)]
    live.sort(key=lambda f: -f.get("priority", PRIORITIES.get(f.get("type", "custom"), 30)))
    parts = [(f.get("name", f"f{i}"), filter_column(df, f["expression"]) if "expression" in f else predicate_column(df, f["predicate"])) for i, f in enumerate(live)]
    if not parts:
        return F.lit(True)
    if strategy == "replace":
        return parts[0][1]
    if strategy == "custom":
        named = dict(parts)

        def build(n: ast.AST) -> Column:
            if isinstance(n, ast.BoolOp):
                return reduce(operator.and_ if isinstance(n.op, ast.And) else operator.or_, map(build, n.values))
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
                return ~build(n.operand)
            if isinstance(n, ast.Name) and n.id in named:
                return named[n.id]
            raise _bad(n)

        return build(ast.parse(re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[0].lower(), custom or ""), mode="eval").body)
    if strategy not in ("priority_and", "priority_or"):
        raise ExpressionError(f"unknown strategy {strategy}")
    return reduce(operator.and_ if strategy == "priority_and" else operator.or_, [c for _, c in parts])
