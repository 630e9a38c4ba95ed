"""Whether two formulas have the same value, by evaluation at fixed points.

Formulas are LaTeX or plain arithmetic: numbers, letters as unknowns, ``+ - * / ^``, fractions, roots, brackets and products
without a sign.  Both are evaluated with 60 digits at the same points, a few values for every unknown; equal formulas agree at all of
them, others practically never do.  Work is bounded by the length of a formula and by limits on exponents, so no timer is needed, and
the result is the same on every machine.  What cannot be read or computed equals nothing but itself as written.
"""

from __future__ import annotations

import re
from decimal import Context, Decimal, DecimalException, localcontext

LONGEST, DIGITS, POINTS, LARGEST_EXPONENT = 400, 60, 3, 200
PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899")
_TOKEN = re.compile(r"\\[A-Za-z]+|\\%|\d+(?:\.\d+)?|\.\d+|[A-Za-z]|[-+*/^(){}\[\]%]|\S")
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
_IGNORED = re.compile(r"\\(?:left|right|displaystyle)(?![A-Za-z])|\\[,;:! ]|\$|\s+")
_TIMES, _OVER, _FRACTIONS = {"*", r"\cdot", r"\times"}, {"/", r"\div"}, {r"\frac", r"\dfrac", r"\tfrac"}


class Unreadable(ValueError):
    pass


class _Formula:
    """A recursive descent over the tokens of a formula that computes its value at one point."""

    def __init__(self, text: str, point: int):
        self.tokens = _TOKEN.findall(_IGNORED.sub(" ", _THOUSANDS.sub("", text)))
        self.at, self.point = 0, point

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.next()
        if not token or wanted is not None and token != wanted:
            raise Unreadable(token)
        self.at += 1
        return token

    def value(self) -> Decimal:
        out = self.sum()
        if self.next():
            raise Unreadable(self.next())
        return out

    def sum(self) -> Decimal:
        out = self.product()
        while self.next() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out - self.product()
        return out

    def product(self) -> Decimal:
        out = self.signed()
        while token := self.next():
            if token in _TIMES:
                self.take()
                out *= self.signed()
            elif token in _OVER:
                self.take()
                out /= self.signed()
            elif token in "+-)}]%":
                break
            else:
                out *= self.power()
        return out

    def signed(self) -> Decimal:
        if self.next() in ("-", "+"):
            return -self.signed() if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> Decimal:
        base = self.atom()
        while self.next() in ("%", r"\%"):
            self.take()
            base /= 100
        if self.next() == "^":
            self.take()
            exponent = self.group()
            if abs(exponent) > LARGEST_EXPONENT:
                raise Unreadable("exponent")
            return base**exponent
        return base

    def group(self) -> Decimal:
        """An argument: something in braces, or one token; of several digits without braces the first."""
        token = self.next()
        if token == "{":
            return self.atom()
        if token[:1].isdigit() and len(token) > 1:
            self.tokens[self.at] = token[1:]
            return Decimal(token[0])
        return self.signed() if token == "-" else self.atom()

    def atom(self) -> Decimal:
        token = self.take()
        if token in "({[":
            out = self.sum()
            self.take({"(": ")", "{": "}", "[": "]"}[token])
            return out
        if token[0].isdigit() or token[0] == ".":
            return Decimal(token)
        if token in _FRACTIONS:
            return self.group() / self.group()
        if token == r"\sqrt":
            if self.next() == "[":
                degree = self.atom()
                return self.group() ** (1 / degree)
            return self.group().sqrt()
        if token == r"\pi":
            return PI
        if len(token) == 1 and token.isalpha():
            return Decimal(1) + Decimal((ord(token) * 7919 + self.point * 104729) % 9973) / 9973
        raise Unreadable(token)


def same_value(a: str | None, b: str | None) -> bool:
    """Equal as written or in value; null equals nothing."""
    if a is None or b is None:
        return False
    if a == b:
        return True
    if max(len(a), len(b)) > LONGEST:
        return False
    with localcontext(Context(prec=DIGITS, Emax=100_000, Emin=-100_000)):
        try:
            for point in range(POINTS):
                x, y = _Formula(a, point).value(), _Formula(b, point).value()
                if not abs(x - y) <= Decimal(10) ** (10 - DIGITS) * max(abs(x), abs(y), Decimal(1)):
                    return False
        except (Unreadable, DecimalException, RecursionError, ValueError):
            return False
    return True
