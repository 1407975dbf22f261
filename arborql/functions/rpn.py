"""Postfix expressions compiled to Columns: the stack exists at compile time only.

Values are numbers (double), strings or sets (arrays). A missing field is NaN as a number
and empty as a string. The first operand of a binary operator is the top of the stack.
Numbers count as true if their integer part isn't 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_LABELS = 256, 128
_TOKEN = re.compile(r'\s*(\{(?:\s*"(?:[^"\\]|\\.)*"\s*,?)*\s*\}|"(?:[^"\\]|\\.)*"|#[-+]?[\w.+-]+|[@$&]\d+|>\d+|\.\d+:[A-Za-z]?|[A-Za-z])')


class RpnError(ValueError):
    """An expression can't be compiled."""


@dataclass
class Value:
    kind: str  # num, str or set
    col: Column


def _num(c: Column) -> Value:
    return Value("num", c)


def _bool(c: Column) -> Value:
    return Value("num", F.when(c, 1.0).otherwise(0.0))


def truthy(v: Value) -> Column:
    if v.kind == "num":
        return F.coalesce(~F.isnan(v.col) & (F.abs(v.col) >= 1), F.lit(False))
    if v.kind == "str":
        return F.coalesce(F.length(v.col) > 0, F.lit(False))
    return F.coalesce(F.size(v.col) > 0, F.lit(False))


def tokenize(text: str) -> list[str]:
    out, pos = [], 0
    while text[pos:].strip():
        m = _TOKEN.match(text, pos)
        if not m:
            raise RpnError(f"can't read {text[pos:]!r}")
        out.append(m[1])
        pos = m.end()
    return out


@dataclass
class Node:
    """What expressions can read of the current node."""

    column: Callable[[str], Column | None] = lambda path: None
    id: Column | None = None
    now: Column | None = None
    has: Callable[[str, Column], Column | None] = lambda path, v: None
    exists: Callable[[str], Column | None] = lambda path: None


def _compare(op: str, a: Column, b: Column) -> Column:
    # NaN compares like IEEE: only != holds
    odd = F.isnan(a) | F.isnan(b) | a.isNull() | b.isNull()
    raw = {"F": a == b, "G": a != b, "H": a < b, "I": a > b, "J": a <= b, "K": a >= b}[op]
    return F.when(odd, op == "G").otherwise(raw)


class _Machine:
    def __init__(self, tokens: list[str], registers: list, node: Node):
        self.tokens, self.registers, self.node = tokens, registers, node
        self.labels = {}
        for i, t in enumerate(tokens):
            if m := re.match(r"\.(\d+):", t):
                self.labels[int(m[1])] = i
        if len(self.labels) > MAX_LABELS:
            raise RpnError("too many labels")

    def run(self, pc: int, stack: list[Value]) -> Value:
        stack = list(stack)
        while pc < len(self.tokens):
            t = self.tokens[pc]
            pc += 1
            if t[0] == "." and len(t) > 1:
                t = t.partition(":")[2]
                if not t:
                    continue
            if t[0] == ">":
                cond = truthy(self.pop(stack))
                target = self.labels.get(int(t[1:]))
                if target is None or target < pc:
                    raise RpnError("jumps go forward to a label")
                yes, no = self.run(target, stack), self.run(pc, stack)
                return self.choose(cond, yes, no)
            if t in "PQ":
                top = self.pop(stack)
                rest = self.run(pc, [*stack, top])
                if t == "P":
                    return self.choose(truthy(top), rest, _num(F.lit(0.0)))
                return self.choose(truthy(top), top, rest)
            if t == "Z":
                break
            self.step(t, stack)
            if len(stack) > MAX_DEPTH:
                raise RpnError("stack too deep")
        if not stack:
            raise RpnError("nothing on the stack")
        return stack[-1]

    @staticmethod
    def pop(stack: list[Value]) -> Value:
        if not stack:
            raise RpnError("stack underflow")
        return stack.pop()

    def choose(self, cond: Column, a: Value, b: Value) -> Value:
        if a.kind != b.kind:
            if {a.kind, b.kind} == {"num", "str"} or "set" in (a.kind, b.kind):
                a, b = _bool(truthy(a)), _bool(truthy(b))
        return Value(a.kind, F.when(cond, a.col).otherwise(b.col))

    def number(self, v: Value) -> Column:
        return v.col if v.kind == "num" else v.col.try_cast("double") if v.kind == "str" else F.lit(float("nan"))

    def path(self, v: Value) -> str:
        if not hasattr(v, "literal"):
            raise RpnError("field names are literals or registers")
        return v.literal

    def literal(self, kind: str, x) -> Value:
        v = Value(kind, F.lit(x) if kind != "set" else F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))
        v.literal = x
        return v

    def step(self, t: str, stack: list[Value]) -> None:
        pop = lambda: self.pop(stack)
        push = stack.append
        node = self.node
        if t[0] == "#":
            push(self.literal("num", float(t[1:])))
        elif t[0] == '"':
            push(self.literal("str", re.sub(r"\\(.)", r"\1", t[1:-1])))
        elif t[0] == "{":
            push(self.literal("set", sorted({re.sub(r"\\(.)", r"\1", x) for x in re.findall(r'"((?:[^"\\]|\\.)*)"', t)})))
        elif t[0] in "@$&":
            i = int(t[1:])
            if i == 0 and node.id is not None and t[0] == "$":
                push(Value("str", node.id))
                return
            if i >= len(self.registers):
                raise RpnError(f"register {i} isn't set")
            x = self.registers[i]
            if isinstance(x, Column):
                push(Value({"@": "num", "$": "str", "&": "set"}[t[0]], x.cast("double") if t[0] == "@" else x))
            else:
                push(self.literal(*{"@": ("num", float(x) if t[0] == "@" else x), "$": ("str", x), "&": ("set", x)}[t[0]]))
        elif t in "ABCDE":
            a, b = self.number(pop()), self.number(pop())
            if t == "C":  # IEEE division
                whole = F.when(b != 0, F.try_divide(a, b))
                col = whole.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            elif t == "E":
                col = F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))
            else:
                col = {"A": a + b, "B": a - b, "D": a * b}[t]
            push(_num(col))
        elif t in "FGHIJK":
            a, b = self.number(pop()), self.number(pop())
            push(_bool(_compare(t, a, b)))
        elif t == "L":
            push(_bool(~truthy(pop())))
        elif t in "MNO":
            a, b = truthy(pop()), truthy(pop())
            push(_bool({"M": a & b, "N": a | b, "O": a != b}[t]))
        elif t == "R":
            a = pop()
            stack += [a, a]
        elif t == "S":
            a, b = pop(), pop()
            stack += [a, b]
        elif t == "U":
            pop()
        elif t == "T":
            cond, yes, no = pop(), pop(), pop()
            push(self.choose(truthy(cond), yes, no))
        elif t == "V":
            a, b = pop(), pop()
            stack += [b, a, b]
        elif t == "W":
            a, b, c = pop(), pop(), pop()
            stack += [b, c, a]
        elif t == "X":
            return
        elif t == "a":
            s, v = pop(), pop()
            if s.kind == "set":
                push(_bool(F.coalesce(F.array_contains(s.col, v.col), F.lit(False))))
            else:
                path = self.path(s)
                hit = node.has(path, v.col)
                c = node.column(path)
                push(_bool(hit if hit is not None else F.lit(False) if c is None else F.coalesce(F.array_contains(c, v.col), F.lit(False))))
        elif t == "b":
            push(Value("str", F.substring(pop().col, 1, 2)))
        elif t in "cd":
            a, b = pop(), pop()
            push(_bool(F.coalesce(a.col, F.lit("")) == F.coalesce(b.col, F.lit(""))))
        elif t == "e":
            push(_bool(F.substring(node.id, 1, 2) == pop().col))
        elif t == "f":
            c = node.column(self.path(pop()))
            push(Value("str", F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit(""))))
        elif t == "g":
            c = node.column(self.path(pop()))
            push(_num(F.lit(float("nan")) if c is None else F.coalesce(c.cast("string").try_cast("double"), F.lit(float("nan")))))
        elif t == "h":
            path = self.path(pop())
            found, c = node.exists(path), node.column(path)
            push(_bool(found if found is not None else F.lit(False) if c is None else c.isNotNull()))
        elif t == "i":
            a, b, c = (self.number(pop()) for _ in range(3))
            push(_bool(_compare("J", a, b) & _compare("J", b, c)))
        elif t in "jk":
            names = self.path(pop())
            cols = [(n, node.column(n)) for n in names]
            full = [(n, F.lit(False) if c is None else c.isNotNull()) for n, c in cols]
            empty = F.array().cast("array<string>")
            if t == "j":
                out = empty
                for n, some in reversed(full):
                    out = F.when(some, F.array(F.lit(n))).otherwise(out)
            else:
                every = F.lit(True)
                for _, some in full:
                    every = every & some
                out = F.when(every, F.array(*(F.lit(n) for n in names))).otherwise(empty)
            push(Value("set", out))
        elif t == "l":
            a, b = pop(), pop()
            if a.kind == "str":
                a = Value("set", node.column(self.path(a)))
            if b.kind == "str":
                b = Value("set", node.column(self.path(b)))
            push(_bool(F.coalesce(F.size(F.array_except(a.col, b.col)) == 0, F.lit(False))))
        elif t == "m":
            a, b = pop(), pop()
            push(_bool(F.coalesce(a.col.contains(b.col), F.lit(False))))
        elif t == "n":
            push(_num((node.now if node.now is not None else F.unix_millis(F.current_timestamp())).cast("double")))
        elif t == "o":
            field_, how, v = self.path(pop()), self.path(pop()), pop()
            push(Value("set", F.transform(record_keys(node.column(field_), how, v.col), lambda k: F.concat(F.lit(f"{field_}."), k))))
        elif t == "z":
            a, b = pop(), pop()
            push(Value("set", F.array_sort(F.array_union(a.col, b.col))))
        else:
            raise RpnError(f"unknown operation {t}")


def record_keys(record: Column, how: str, value: Column) -> Column:
    """Keys of a map that compare with value: how is a (all), f (first) or l (last), then an operator F G H I J K m."""
    keys = F.array_sort(F.map_keys(record))
    test = {"F": lambda k: k == value, "G": lambda k: k != value, "H": lambda k: k < value, "I": lambda k: k > value, "J": lambda k: k <= value, "K": lambda k: k >= value, "m": lambda k: k.contains(value)}[how[1]]
    found = F.coalesce(F.filter(keys, test), F.array().cast("array<string>"))
    if how[0] == "a":
        return found
    one = F.array_min(found) if how[0] == "f" else F.array_max(found)
    return F.when(F.size(found) > 0, F.array(one)).otherwise(F.array().cast("array<string>"))


def compile_rpn(text: str, registers: list | None = None, node: Node | None = None) -> Value:
    """The expression's value; registers[1:] are numbers, strings, lists or Columns."""
    m = _Machine(tokenize(text), registers or [None], node or Node())
    return m.run(0, [])


def rpn_bool(text: str, registers: list | None = None, node: Node | None = None) -> Column:
    return truthy(compile_rpn(text, registers, node))


def rpn_double(text: str, registers: list | None = None, node: Node | None = None) -> Column:
    v = compile_rpn(text, registers, node)
    return v.col if v.kind == "num" else v.col.try_cast("double")


def rpn_string(text: str, registers: list | None = None, node: Node | None = None) -> Column:
    return compile_rpn(text, registers, node).col.cast("string")


def rpn_set(text: str, registers: list | None = None, node: Node | None = None) -> Column:
    v = compile_rpn(text, registers, node)
    if v.kind != "set":
        raise RpnError("not a set")
    return v.col
