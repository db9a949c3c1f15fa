"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded, and the tree is
turned into nested Python closures that append to an output and note where
generation blocks begin and end. The language is closed: text, ``{{ e }}``,
``{% for x in e %}``, ``{% if e %} / {% elif e %} / {% else %}``,
``{% set x = e %}`` and ``{% generation %}``; expressions know strings, integers, names,
fields of records, ``== != + and or not``, and the filters of ``FILTERS``. There
are no calls, no attributes of Python objects and no loops beside those over
given lists.

A conversation is formatted turn by turn, by many tasks if it is long. So a
template has one loop over ``messages`` on its outermost level; what stands
before and after it comes once a conversation and doesn't see the turns, and
the loop's body sees its own turn alone. ``split_template`` raises
``TemplateError`` for any other use of ``messages``.

Turns are ordered by turn (null first), role and text; null texts and roles are
empty; a null conv_id is a conversation of its own; repeated rows are repeated
turns; an empty table leaves the added conversation alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.kernels import column

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(re.escape(c) for c in (*CONTROLS, "\\")))

TEMPLATE = (
    "{% set open = '<s>' + '[ROLE]' %}"
    "{% for m in messages %}{{ open }}{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\\\|([<\[])\\", lambda m: m[1] or "\\", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


# --- syntax tree ---------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Get:
    of: object
    key: str


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Emit:
    value: object


@dataclass
class For:
    name: str
    of: object
    body: list


@dataclass
class If:
    test: object
    yes: list
    no: list = field(default_factory=list)


@dataclass
class Assign:
    name: str
    value: object


@dataclass
class Generation:
    body: list


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z][A-Za-z0-9_]*)|(==|!=|[-+|().]))")


class _Expr:
    """A parser by precedence: or, and, not, comparison, +, filters and fields."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.items.append((("str", "int", "name", "op")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in texts

    def next(self, kind: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.items) or kind and self.items[self.at][0] != kind:
            raise TemplateError("an expression ends early")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self):
        out = self.either()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return out

    def either(self):
        return self._chain(("or",), lambda: self._chain(("and",), self.negation))

    def _chain(self, kinds: tuple[str, ...], below):
        out = below()
        while self.peek(*kinds):
            out = Op(self.next()[1], [out, below()])
        return out

    def negation(self):
        if self.peek("not"):
            self.next()
            return Op("not", [self.negation()])
        return self._chain(("==", "!="), lambda: self._chain(("+",), self.filtered))

    def filtered(self):
        out = self.atom()
        while self.peek("|"):
            self.next()
            name = self.next("name")[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Op("|" + name, [out])
        return out

    def atom(self):
        kind, text = self.next()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "int":
            return Const(int(text))
        if text == "(":
            out = self.either()
            if self.next()[1] != ")":
                raise TemplateError("a parenthesis stays open")
            return out
        if kind != "name" or text in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {text!r}")
        out = Name(text)
        while self.peek("."):
            self.next()
            out = Get(out, self.next("name")[1])
        return out


def parse(source: str) -> list:
    """The syntax tree of a template, as a list of nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    root: list = []
    stack: list[tuple] = [("", root)]  # what is open, and where its nodes go
    for part in parts:
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(Emit(_Expr(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9_]*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"not a loop: {part}")
                body.append(node := For(m[1], _Expr(m[2]).whole(), []))
                stack.append(("for", node.body))
            elif word == "if":
                body.append(node := If(_Expr(rest).whole(), []))
                stack.append(("if", node.yes, node))
            elif word in ("elif", "else"):
                kind, _, node = stack.pop() if len(stack[-1]) == 3 else ("", None, None)
                if kind != "if":
                    raise TemplateError(f"no open if before {part}")
                if word == "else":
                    stack.append(("if", node.no, node))
                else:
                    node.no.append(inner := If(_Expr(rest).whole(), []))
                    stack.append(("if", inner.yes, inner))
            elif word == "generation":
                body.append(node := Generation([]))
                stack.append(("generation", node.body))
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9_]*)\s*=(?!=)(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"not an assignment: {part}")
                body.append(Assign(m[1], _Expr(m[2]).whole()))
            elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {part}")
        elif part:
            body.append(Emit(Const(part)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} stays open")
    return root


# --- constant folding ----------------------------------------------------


def _apply(kind: str, args: list) -> object:
    if kind == "+":
        return args[0] + args[1]
    if kind == "==":
        return args[0] == args[1]
    if kind == "!=":
        return args[0] != args[1]
    if kind == "not":
        return not args[0]
    return FILTERS[kind[1:]]("" if args[0] is None else str(args[0]))


def _fold_expr(e, env: dict):
    if isinstance(e, Name):
        return env.get(e.name, e)
    if isinstance(e, Get):
        return Get(_fold_expr(e.of, env), e.key)
    if isinstance(e, Op):
        args = [_fold_expr(a, env) for a in e.args]
        if e.kind in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (e.kind == "and") else args[0]
            return Op(e.kind, args)
        return Const(_apply(e.kind, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(e.kind, args)
    return e


def _assigned(nodes: list) -> set[str]:
    out: set[str] = set()
    for n in nodes:
        if isinstance(n, Assign):
            out.add(n.name)
        for below in (getattr(n, "body", []), getattr(n, "yes", []), getattr(n, "no", [])):
            out |= _assigned(below)
        if isinstance(n, For):
            out.add(n.name)
    return out


def fold(nodes: list, env: dict | None = None) -> list:
    """The tree with constants computed, dead branches gone and neighbouring text joined."""
    env = {} if env is None else env
    out: list = []

    def emit(node):
        if isinstance(node, Emit) and isinstance(node.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
            out[-1] = Emit(Const(_text(out[-1].value.value) + _text(node.value.value)))
        else:
            out.append(node)

    for n in nodes:
        if isinstance(n, Emit):
            emit(Emit(_fold_expr(n.value, env)))
        elif isinstance(n, Assign):
            value = _fold_expr(n.value, env)
            if isinstance(value, Const):
                env[n.name] = value
            else:
                env.pop(n.name, None)
            out.append(Assign(n.name, value))
        elif isinstance(n, If):
            test = _fold_expr(n.test, env)
            if isinstance(test, Const):
                for x in fold(n.yes if test.value else n.no, env):
                    emit(x)
            else:
                out.append(If(test, fold(n.yes, dict(env)), fold(n.no, dict(env))))
                for name in _assigned(n.yes) | _assigned(n.no):
                    env.pop(name, None)
        elif isinstance(n, For):
            of = _fold_expr(n.of, env)
            for name in _assigned(n.body) | {n.name}:
                env.pop(name, None)
            out.append(For(n.name, of, fold(n.body, dict(env))))
        else:
            out.append(Generation(fold(n.body, env)))
    return out


# --- closures ------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _value(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda scope, v=e.value: v
    if isinstance(e, Name):
        return lambda scope, k=e.name: scope.get(k)
    if isinstance(e, Get):
        of = _value(e.of)

        def get(scope, k=e.key):
            record = of(scope)
            return record.get(k) if isinstance(record, dict) else None

        return get
    args = [_value(a) for a in e.args]
    if e.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    return lambda scope, kind=e.kind: _apply(kind, [a(scope) for a in args])


class _Out:
    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.marks: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _steps(nodes: list) -> Callable[[dict, _Out], None]:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, out: _Out) -> None:
        for s in steps:
            s(scope, out)

    return run


def _step(n) -> Callable[[dict, _Out], None]:
    if isinstance(n, Emit):
        if isinstance(n.value, Const):
            return lambda scope, out, t=_text(n.value.value): out.add(t)
        value = _value(n.value)
        return lambda scope, out: out.add(_text(value(scope)))
    if isinstance(n, Assign):
        value = _value(n.value)
        return lambda scope, out, k=n.name: scope.__setitem__(k, value(scope))
    if isinstance(n, If):
        test, yes, no = _value(n.test), _steps(n.yes), _steps(n.no)
        return lambda scope, out: (yes if test(scope) else no)(scope, out)
    if isinstance(n, For):
        of, body = _value(n.of), _steps(n.body)

        def loop(scope, out, k=n.name):
            items = of(scope)
            for item in items if isinstance(items, (list, tuple)) else ():
                body({**scope, k: item}, out)

        return loop
    body = _steps(n.body)

    def generation(scope, out):
        begin = out.length
        body(scope, out)
        out.marks.append((begin, out.length))

    return generation


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's variables that gives (text, generation spans in code points)."""
    run = _steps(fold(parse(source)))

    def render(**scope) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(scope, out)
        return "".join(out.parts), out.marks

    return render


# --- distribution --------------------------------------------------------

TURNS = "messages"
RUN_CHARS = 1 << 20
RUNS = "conv_id bigint, part int, run int, formatted string, marks array<bigint>"
FIRST, LAST = -1, 2**31 - 1  # the parts before and after all turns
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?))</s>", re.S)


def _names(node) -> set[str]:
    """All variables that a node or a list of nodes looks at."""
    if isinstance(node, list):
        return set().union(*map(_names, node))
    if isinstance(node, Name):
        return {node.name}
    return set().union(*(_names(v) for v in vars(node).values() if isinstance(v, list) or hasattr(v, "__dataclass_fields__"))) if hasattr(node, "__dataclass_fields__") else set()


def split_template(source: str) -> tuple[list, For, list]:
    """The folded template as what stands before its loop over the turns, the loop, and what stands after it."""
    nodes = fold(parse(source))
    at = [i for i, n in enumerate(nodes) if isinstance(n, For) and n.of == Name(TURNS)]
    if len(at) != 1:
        raise TemplateError(f"a template has one loop over {TURNS} on its outermost level, not {len(at)}")
    head, loop, tail = nodes[: at[0]], nodes[at[0]], nodes[at[0] + 1 :]
    if TURNS in _names(head) | _names(loop.body) | _names(tail):
        raise TemplateError(f"only the loop itself may look at {TURNS}: a conversation is formatted turn by turn")
    return head, loop, tail


class TurnFormat:
    """A split template: the texts around a conversation's turns, and a function of one turn, each with generation spans."""

    def __init__(self, source: str):
        head, loop, tail = split_template(source)
        self.scope: dict = {}
        self.head = self._run(head)
        self.name, self.body = loop.name, _steps(loop.body)
        inner = dict(self.scope)
        self.tail = self._run(tail)
        self.scope = inner

    def _run(self, nodes: list) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        _steps(nodes)(self.scope, out)
        return "".join(out.parts), out.marks

    def turn(self, role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        self.body({**self.scope, self.name: {"role": role, "text": text}}, out)
        return "".join(out.parts), out.marks


def _render_runs(source: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        render, part, run = TurnFormat(source).turn, TaskContext.get().partitionId(), 0
        conv: object = work  # no conversation yet
        texts: list[str] = []
        marks: list[int] = []
        length = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal texts, marks, length, run
            if texts:
                done.append((conv, part, run, "".join(texts), marks))
                texts, marks, length, run = [], [], 0, run + 1

        def give() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * 5
            done.clear()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "part", "run", "formatted", "marks"])

        for batch in batches:
            size = 0
            for c, role, text in zip(*(column(batch, n).to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv or length > RUN_CHARS:
                    size += length
                    close()
                    conv = c
                    if size > 8 * RUN_CHARS:
                        yield give()
                        size = 0
                body, spans = render(role or "", text or "")
                marks += [length + x for s in spans for x in s]
                texts.append(body)
                length += len(body)
            if done:
                yield give()
        close()
        yield give()

    return work


def format_runs(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted stretches of conversations, in order of part and run, with their generation marks; a conversation may span tasks."""
    around = TurnFormat(template)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    order = ("conv_id", "turn", "role", "text")
    runs = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order).mapInArrow(_render_runs(template), RUNS)
    for part, (text, marks) in ((FIRST, around.head), (LAST, around.tail)):
        if text:
            flat = F.array(*[F.lit(x).cast("bigint") for m in marks for x in m]).cast("array<bigint>")
            each = rows.select("conv_id").distinct()
            runs = runs.unionByName(each.select("conv_id", F.lit(part).alias("part"), F.lit(0).alias("run"), F.lit(text).alias("formatted"), flat.alias("marks")))
    return runs


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, parsed from its formatted stretches in one pass; ``ValueError`` if a stretch isn't whole turns."""
    state: list | None = None
    done: list[tuple] = []

    def close() -> None:
        if state is not None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    for batch in batches:
        for conv, text, marks in zip(*(column(batch, n).to_pylist() for n in ("conv_id", "formatted", "marks"))):
            if state is None or conv != state[0]:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            at = 0
            for m in _TURN.finditer(text):
                if m.start() != at:
                    break
                at = m.end()
                said = m[2] if m[2] is not None else m[3]
                state[1] += 1
                state[2].update(f"{unescape(m[1])}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            if at != len(text):
                raise ValueError(f"text outside of turns at {at} of a stretch of conversation {conv}")
            for a, b in zip(marks[::2], marks[1::2]):
                loss = unescape(text[a:b])
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        yield _digests(done)
    close()
    yield _digests(done)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(done: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*done)) if done else [()] * 6
    done.clear()
    names, kinds = zip(*(x.split() for x in DIGESTS.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, {"bigint": pa.int64(), "string": pa.string()}[k]) for c, k in zip(cols, kinds)], list(names))


def read_back(runs: DataFrame) -> DataFrame:
    """One row a conversation formatted by ``TEMPLATE``; a task streams its stretches, holding digests only."""
    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "run").select("conv_id", "formatted", "marks").mapInArrow(_read_back, DIGESTS)


_COUNTED = r"<s>|</s>|\[/?INST\]|\[/?ROLE\]|\\"
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all conversations and the probe conversation -7, formatted and read back."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_runs(given.unionByName(probe)))


ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations
           union all values (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
g as (select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt)) as turns_sha256,
        sum(case when role = 'assistant' then length(txt) else 0 end)::bigint as loss_chars,
        sha256(coalesce(string_agg(txt, '' order by turn, role, txt) filter (role = 'assistant'), '')) as loss_sha256,
        sum(case when role = 'assistant' then 20 else 33 end
            + length(role) + length(txt) + len(regexp_extract_all(role, '{_COUNTED}')) + len(regexp_extract_all(txt, '{_COUNTED}')))::bigint as formatted_chars
      from t group by conv_id)
select * from g
"""
