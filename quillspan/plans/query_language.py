"""The boolean query language: lexer, implicit AND, shunting-yard, and a stack machine over any algebra.

Malformed queries have a definite answer unless ``strict`` is set, in which case they raise.

The extended language adds atoms where the plain one has terms: ``"a b c"`` (a phrase), ``"a b"~3`` (the words within
3 further tokens, in any order), ``title:a`` (in the title), ``ab*``, ``*ab``, ``a*b`` (patterns) and ``abc~1``, ``abc~2``
(terms within that many edits). Only the quotation mark changes how a query is cut; plain queries keep their meaning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

TERM, AND, OR, NOT, OPEN, CLOSE = "term", "&&", "||", "!", "(", ")"
PRECEDENCE = {OR: 1, AND: 2, NOT: 3}
#: White space of the query language (that of C's isspace).
SPACE = " \t\n\r\v\f"
_OPERATORS = "&|!()"
#: Neighbours between which an AND is understood.
_IMPLIED = {(TERM, TERM), (TERM, OPEN), (CLOSE, TERM), (TERM, NOT)}

V = TypeVar("V")


class QuerySyntaxError(ValueError):
    """A query that strict parsing refuses."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: str


def lex(query: str, extended: bool = False) -> list[Token]:
    tokens, i = [], 0
    while i < len(query):
        c = query[i]
        if c in SPACE:
            i += 1
        elif c in "&|":
            i += 2 if query[i : i + 2] == c * 2 else 1
            tokens.append(Token(c * 2, c * 2))
        elif c in "!()":
            tokens.append(Token(c, c))
            i += 1
        elif extended and c == '"':
            end = query.find('"', i + 1)
            end = len(query) if end < 0 else end + 1
            while end < len(query) and query[end] in "~0123456789":
                end += 1
            tokens.append(Token(TERM, query[i:end]))
            i = end
        else:
            start = i
            while i < len(query) and query[i] not in SPACE and query[i] not in _OPERATORS:
                i += 1
            tokens.append(Token(TERM, query[start:i]))
    return tokens


def with_implied_and(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    for token in tokens:
        if out and (out[-1].kind, token.kind) in _IMPLIED:
            out.append(Token(AND, AND))
        out.append(token)
    return out


def to_rpn(query: str, strict: bool = False, extended: bool = False) -> list[Token]:
    """Reverse Polish form. All operators, NOT included, give way to waiting ones of equal precedence."""
    tokens = with_implied_and(lex(query, extended))
    if strict:
        _validate(tokens)
    out: list[Token] = []
    waiting: list[Token] = []
    for token in tokens:
        if token.kind == TERM:
            out.append(token)
        elif token.kind == OPEN:
            waiting.append(token)
        elif token.kind == CLOSE:
            while waiting and waiting[-1].kind != OPEN:
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        else:
            while waiting and PRECEDENCE.get(waiting[-1].kind, 0) >= PRECEDENCE[token.kind]:
                out.append(waiting.pop())
            waiting.append(token)
    return out + waiting[::-1]


def _validate(tokens: list[Token]) -> None:
    """Accept only well-formed infix: balanced, and operands where they belong. Double negation and the like are refused too."""
    depth, operand = 0, True
    for before, token in zip([None, *tokens], tokens):
        if token.kind in (TERM, OPEN, NOT):
            if not operand:
                raise QuerySyntaxError(f"operator missing before {token.value!r}")
            if token.kind == NOT and before is not None and before.kind == NOT:
                raise QuerySyntaxError("double negation")
            depth += token.kind == OPEN
            operand = token.kind != TERM
        elif token.kind == CLOSE:
            depth -= 1
            if operand or depth < 0:
                raise QuerySyntaxError("unexpected ')'")
        else:
            if operand:
                raise QuerySyntaxError(f"operand missing before {token.value!r}")
            operand = True
    if operand or depth:
        raise QuerySyntaxError("query ends early")


@dataclass(frozen=True)
class Atom:
    """A term of the extended language: its kind, the words as written, and the slack or the edits."""

    kind: str
    words: tuple[str, ...]
    slack: int = 0


def atom(value: str, words: Callable[[str], list[str]]) -> Atom:
    """Read one term of the extended language; ``words`` cuts the inside of a phrase into words.

    What does not fit the syntax is a plain term, so that no query fails: a ``*`` alone, more than two edits, a ``~`` after something
    that is no word. A phrase of one word is that word; one without words is never found.
    """
    if value.startswith('"'):
        inside, _, rest = value[1:].partition('"')
        found = tuple(words(inside))
        near = rest[1:] if rest.startswith("~") else ""
        if near.isdigit():
            return Atom("near", found, int(near))
        return Atom("phrase", found)
    if value.startswith("title:") and len(value) > 6:
        return Atom("title", (value[6:],))
    head, mark, edits = value.rpartition("~")
    if mark and head and edits in ("1", "2"):
        return Atom("fuzzy", (head,), int(edits))
    if "*" in value and value.strip("*"):
        return Atom("pattern", (value,))
    return Atom("term", (value,))


def rpn_text(query: str) -> str:
    return " ".join(t.value for t in to_rpn(query))


def terms_of(rpn: list[Token]) -> list[str]:
    """Distinct terms in order of appearance."""
    return list(dict.fromkeys(t.value for t in rpn if t.kind == TERM))


def evaluate(rpn: list[Token], term: Callable[[str], V], both: Callable[[V, V], V], either: Callable[[V, V], V], negate: Callable[[V], V], nothing: V) -> V:
    """Run the stack machine. Operators without operands are skipped; a leftover ``(`` eats two operands."""
    stack: list[V] = []
    for token in rpn:
        if token.kind == TERM:
            stack.append(term(token.value))
        elif token.kind == NOT:
            if stack:
                stack.append(negate(stack.pop()))
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token.kind == AND:
                stack.append(both(left, right))
            elif token.kind == OR:
                stack.append(either(left, right))
    return stack[-1] if stack else nothing
