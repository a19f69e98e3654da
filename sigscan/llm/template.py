"""A small sandboxed template language for chats, compiled to Python closures.

``{{ expression }}`` puts a value out; ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in list %} {% endfor %}``, ``{% set x = expression %}`` and
``{% generation %} {% endgeneration %}`` (what a model is to learn) are the
statements; ``{# #}`` is a comment; a minus sign at a mark's inside takes the white space there away.
Expressions have texts, whole numbers, true, false, none, names, fields
(``m.role``), ``a if c else b``, or, and, not, ==, !=, in, +, ~ and filters.

Sandbox: a name is a variable given to the template or set in it, a field is a key
of a mapping; there are no calls, no attributes and no loops but over given
lists, so a template ends and reaches nothing else. What is unknown is refused when it is compiled.

Source is parsed to a tree of tuples, parts that hold no names are computed
once, branches that cannot be taken go, neighbouring texts are joined, and each
node becomes a closure. Rendering yields its output piece by piece and takes
messages from an iterator, so a conversation of any length is never held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: Yielded where a generation begins and ends.
BEGIN, END = object(), object()
_MARKS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_WORDS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[()|.+~]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_KEYWORDS = {"if", "else", "or", "and", "not", "in"}
_DEPTH = 50


class TemplateError(ValueError):
    """Source that is not of the language."""


class Controls:
    """The strings that structure a format, and the escape of them inside texts.

    Where a text holds a control string, or one with backslashes behind its first
    character, one more backslash goes there; taking one away gives the text back,
    and texts without control strings stay as they are. First characters occur at
    no other place of a control string and none begins another, so what surrounds a text cannot complete one.
    """

    def __init__(self, strings: Iterable[str]):
        self.strings = sorted(set(strings))
        firsts = {c[:1] for c in self.strings}
        for c in self.strings:
            if len(c) < 2 or set(c[1:]) & (firsts | {"\\"}) or any(d != c and d.startswith(c) for d in self.strings):
                raise TemplateError(f"not a control string beside the others: {c!r}")
        tails = "|".join(f"{re.escape(f)}{{}}(?={'|'.join(re.escape(c[1:]) for c in self.strings if c[0] == f)})" for f in sorted(firsts))
        self._any, self._escaped = (re.compile(tails.replace("{}", x)) if self.strings else None for x in (r"\\*", r"\\+"))
        self.split = re.compile("|".join(map(re.escape, self.strings))) if self.strings else None

    def escape(self, text: str) -> str:
        return self._any.sub(lambda m: m[0] + "\\", text) if self._any else text

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][:-1], text) if self._escaped else text


# ---- source to tree


def _expression(source: str) -> tuple:
    """The tree of an expression."""
    words, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _WORDS.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        words.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    words.append((0, ""))
    pos, depth = 0, 0

    def peek(*values):
        return words[pos][0] in (3, 4) and words[pos][1] in values

    def take(value=None):
        nonlocal pos
        word = words[pos]
        if value is not None and word[1] != value:
            raise TemplateError(f"{value!r} expected in {source!r}")
        pos += 1
        return word

    def choice():
        nonlocal depth
        depth += 1
        if depth > _DEPTH:
            raise TemplateError("too deep")
        left = either()
        if peek("if"):
            take()
            test = either()
            take("else")
            left = ("choice", test, left, choice())
        depth -= 1
        return left

    def chain(words_, below):
        def parse():
            left = below()
            while peek(*words_):
                left = ("binary", take()[1], left, below())
            return left

        return parse

    def negated():
        nonlocal depth
        if not peek("not"):
            return compared()
        take()
        depth += 1
        if depth > _DEPTH:
            raise TemplateError("too deep")
        inner = ("not", negated())
        depth -= 1
        return inner

    def filtered():
        left = value()
        while peek("|", "."):
            mark, (_, name) = take()[1], take()
            if not name.isidentifier():
                raise TemplateError(f"a name expected in {source!r}")
            left = ("filter", name, left) if mark == "|" else ("field", name, left)
        return left

    def value():
        kind, word = take()
        if kind == 1:
            return "const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S)
        if kind == 2:
            return "const", int(word)
        if word == "(":
            inner = choice()
            take(")")
            return inner
        if kind != 3 or word in _KEYWORDS:
            raise TemplateError(f"a value expected in {source!r}")
        return ("const", _CONSTANTS[word]) if word in _CONSTANTS else ("name", word)

    compared = chain(("==", "!=", "in"), chain(("+", "~"), filtered))
    either = chain(("or",), chain(("and",), negated))
    tree = choice()
    if words[pos][0]:
        raise TemplateError(f"{words[pos][1]!r} is too much in {source!r}")
    return tree


def parse(source: str) -> list[tuple]:
    """The tree of a template: a list of nodes."""
    tokens, at, strip = [], 0, False
    for m in _MARKS.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        tokens.append(("text", text.rstrip() if m[1] or m[4] else text))
        if m[2] is not None:
            tokens.append(("out", m[2]))
        elif m[5] is not None:
            tokens.append(("statement", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6])
    tokens.append(("text", source[at:].lstrip() if strip else source[at:]))
    tokens.reverse()

    def body(ends: tuple[str, ...], depth: int) -> tuple[list[tuple], str]:
        if depth > _DEPTH:
            raise TemplateError("too deep")
        nodes: list[tuple] = []
        while tokens:
            kind, text = tokens.pop()
            if kind == "text":
                nodes.append(("text", text))
            elif kind == "out":
                nodes.append(("out", _expression(text)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return nodes, text
                if word == "if":
                    nodes.append(branch(rest, depth))
                elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    nodes.append(("for", m[1], _expression(m[2]), body(("endfor",), depth + 1)[0]))
                elif word == "generation":
                    nodes.append(("generation", body(("endgeneration",), depth + 1)[0]))
                elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)):
                    nodes.append(("set", m[1], _expression(m[2])))
                else:
                    raise TemplateError(f"no such statement: {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def branch(test: str, depth: int) -> tuple:
        then, end = body(("elif", "else", "endif"), depth + 1)
        word, _, rest = end.partition(" ")
        other = [branch(rest, depth + 1)] if word == "elif" else body(("endif",), depth + 1)[0] if word == "else" else []
        return "if", _expression(test), then, other

    return body((), 0)[0]


# ---- folding


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b)}


def fold_expression(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with all parts computed that hold no names."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind in ("field", "filter"):
        inner = fold_expression(tree[2], filters)
        if kind == "filter" and tree[1] not in filters:
            raise TemplateError(f"no such filter: {tree[1]}")
        return ("const", filters[tree[1]](inner[1])) if kind == "filter" and inner[0] == "const" else (kind, tree[1], inner)
    if kind == "not":
        inner = fold_expression(tree[1], filters)
        return ("const", not inner[1]) if inner[0] == "const" else (kind, inner)
    if kind == "choice":
        test, then, other = (fold_expression(t, filters) for t in tree[1:])
        return (then if test[1] else other) if test[0] == "const" else (kind, test, then, other)
    left, right = fold_expression(tree[2], filters), fold_expression(tree[3], filters)
    if tree[1] in ("and", "or"):
        return (right if bool(left[1]) == (tree[1] == "and") else left) if left[0] == "const" else (kind, tree[1], left, right)
    try:
        return ("const", _BINARY[tree[1]](left[1], right[1])) if left[0] == right[0] == "const" else (kind, tree[1], left, right)
    except TypeError as e:
        raise TemplateError(str(e)) from e


def fold(nodes: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """The nodes with constants put out as texts, untaken branches gone and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            value = fold_expression(node[1], filters)
            new = [("text", _text(value[1]))] if value[0] == "const" else [("out", value)]
        elif kind == "if":
            test, then, other = fold_expression(node[1], filters), fold(node[2], filters), fold(node[3], filters)
            new = (then if test[1] else other) if test[0] == "const" else [("if", test, then, other)]
        elif kind == "for":
            new = [("for", node[1], fold_expression(node[2], filters), fold(node[3], filters))]
        elif kind == "set":
            new = [("set", node[1], fold_expression(node[2], filters))]
        elif kind == "generation":
            new = [("generation", fold(node[1], filters))]
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


# ---- tree to closures


def _compile_expression(tree: tuple, filters: dict[str, Callable], names: set[str]) -> Callable[[dict], object]:
    kind, sub = tree[0], lambda t: _compile_expression(t, filters, names)
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        if name not in names:
            raise TemplateError(f"no such name: {name}")
        return lambda env: env.get(name)
    if kind == "field":
        name, of = tree[1], sub(tree[2])

        def field(env):
            value = of(env)
            return value.get(name) if isinstance(value, dict) else None

        return field
    if kind == "filter":
        f, of = filters[tree[1]], sub(tree[2])
        return lambda env: f(of(env))
    if kind == "not":
        of = sub(tree[1])
        return lambda env: not of(env)
    if kind == "choice":
        test, then, other = map(sub, tree[1:])
        return lambda env: then(env) if test(env) else other(env)
    left, right = sub(tree[2]), sub(tree[3])
    if tree[1] == "and":
        return lambda env: left(env) and right(env)
    if tree[1] == "or":
        return lambda env: left(env) or right(env)
    f = _BINARY[tree[1]]
    return lambda env: f(left(env), right(env))


def _compile(nodes: list[tuple], filters: dict[str, Callable], names: set[str]) -> Callable[[dict], Iterator]:
    """A closure that yields the output of nodes; names set in them are known behind."""
    parts = [_compile_node(n, filters, names) for n in nodes]

    def run(env):
        for is_text, f in parts:
            if is_text:
                yield f(env)
            else:
                yield from f(env)

    return run


def _compile_node(node: tuple, filters: dict[str, Callable], names: set[str]) -> tuple[bool, Callable]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return True, lambda env: text
    if kind == "out":
        value = _compile_expression(node[1], filters, names)
        return True, lambda env: _text(value(env))
    if kind == "if":
        test, then, other = _compile_expression(node[1], filters, names), _compile(node[2], filters, names), _compile(node[3], filters, names)
        return False, lambda env: then(env) if test(env) else other(env)
    if kind == "set":
        name, value = node[1], _compile_expression(node[2], filters, names)
        names.add(name)

        def put(env):
            env[name] = value(env)
            return ()

        return False, put
    if kind == "generation":
        inside = _compile(node[1], filters, names)

        def marked(env):
            yield BEGIN
            yield from inside(env)
            yield END

        return False, marked
    name, items = node[1], _compile_expression(node[2], filters, names)
    inside = _compile(node[3], filters, names | {name, "loop"})

    def loop(env):
        held = {k: env.get(k) for k in (name, "loop")}
        source, index = iter(items(env) or ()), 0
        item = next(source, END)
        while item is not END:
            after = next(source, END)
            env[name], env["loop"] = item, {"index": index + 1, "index0": index, "first": index == 0, "last": after is END}
            yield from inside(env)
            item, index = after, index + 1
        env.update(held)

    return False, loop


class Template:
    """A compiled template. ``variables`` are the names that :meth:`render` gets; escape is a filter by ``controls``."""

    def __init__(self, source: str, controls: Iterable[str] = (), variables: Iterable[str] = ("messages",)):
        self.source, self.controls = source, Controls(controls)
        text = lambda f: lambda v: f(_text(v))
        self.filters = {"escape": text(self.controls.escape), "trim": text(str.strip), "upper": text(str.upper), "lower": text(str.lower), "length": text(len)}
        self.tree = fold(parse(source), self.filters)
        self._run = _compile(self.tree, self.filters, set(variables))

    def render(self, **variables) -> Iterator:
        """Pieces of text, with BEGIN and END around generations."""
        return self._run(dict(variables))

    def text(self, **variables) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans of its generations, for short conversations."""
        out, spans, n = [], [], 0
        for piece in self.render(**variables):
            if piece is BEGIN:
                start = n
            elif piece is END:
                spans.append((start, n))
            else:
                out.append(piece)
                n += len(piece)
        return "".join(out), spans
