"""Functions, metrics and imports of JavaScript and TypeScript source, from tokens.

There is no grammar here: a lexer (comments, strings, nested templates, regular expressions) and matched
brackets. What a full parser says is approximated where only types could tell, and the docstrings say how
each number is counted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import spread

EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
# Words of the language that count as operators, and that can't name a function.
OPERATOR_WORDS = frozenset("function async await return if else switch case default for while do try catch throw new yield break continue export import class as satisfies typeof void delete instanceof in".split())
CONTROL_WORDS = frozenset("if for while switch catch function return typeof new await with super import do else case throw delete void in of instanceof yield".split())
VALUE_WORDS = frozenset("true false null undefined this super".split())
TERMINAL_WORDS = frozenset("return throw break continue".split())
PUNCTUATORS = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** + - * / % = < > ! ~ & | ^ ? : . , ; ( ) [ ] { } @ #"
).split()
BRACKETS = {"(": ")", "[": "]", "{": "}"}
CONSOLE = frozenset("log warn error info debug trace".split())
_PART = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<word>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<mark>" + "|".join(re.escape(p) for p in PUNCTUATORS) + r")|(?P<other>[\s\S])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Token(NamedTuple):
    kind: str
    text: str
    start: int


def tokens(code: str) -> list[Token]:
    """All tokens but white space and comments. A template is one token, whatever is in it."""
    found: list[Token] = []
    at = 0
    while at < len(code):
        if code[at] == "`":
            end = _template(code, at)
            found.append(Token("template", code[at:end], at))
            at = end
            continue
        if code[at] == "/" and not _after_value(found) and (m := _REGEX.match(code, at)):
            found.append(Token("regex", m[0], at))
            at = m.end()
            continue
        m = _PART.match(code, at)
        if m.lastgroup not in ("space", "comment"):
            found.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return found


def _after_value(found: list[Token]) -> bool:
    if not found:
        return False
    last = found[-1]
    return last.kind in ("number", "string", "template", "regex") or last.text in (")", "]", "}") or (last.kind == "word" and last.text not in OPERATOR_WORDS)


def _template(code: str, at: int) -> int:
    depth, at = 0, at + 1
    while at < len(code):
        c = code[at]
        if c == "\\":
            at += 1
        elif depth == 0 and c == "`":
            return at + 1
        elif code.startswith("${", at):
            depth, at = depth + 1, at + 1
        elif depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
        elif depth and c == "`":
            at = _template(code, at) - 1
        at += 1
    return len(code)


@dataclass
class Function:
    """A function by its tokens: from its first to one after its last, and where its body begins."""

    name: str
    first: int
    body: int
    end: int
    params: int
    inner: list[Function] = field(default_factory=list)


def _partners(ts: list[Token]) -> dict[int, int]:
    """The closing bracket of each opening one and the reverse; those without are left out."""
    found, open_ = {}, []
    for k, t in enumerate(ts):
        if t.kind != "mark":
            continue
        if t.text in BRACKETS:
            open_.append(k)
        elif t.text in BRACKETS.values():
            while open_ and BRACKETS[ts[open_[-1]].text] != t.text:
                open_.pop()
            if open_:
                found[k] = open_.pop()
                found[found[k]] = k
    return found


def _block_after(ts: list[Token], k: int, partner: dict[int, int]) -> int | None:
    """The { of a body that follows a parameter list, past a return type."""
    if k < len(ts) and ts[k].text == ":":
        k, angles = k + 1, 0
        while k < len(ts) and (angles > 0 or ts[k].text not in (";", "=>", ",", ")", "]", "}", "=")):
            if ts[k].text == "{" and not angles and ts[k - 1].text not in (":", "|", "&"):
                return k
            angles += (ts[k].text == "<") - ts[k].text.count(">") * (ts[k].text in (">", ">>", ">>>"))
            k = partner.get(k, k) + 1 if ts[k].text in BRACKETS else k + 1
        return None
    return k if k < len(ts) and ts[k].text == "{" else None


def _expression_end(ts: list[Token], k: int, partner: dict[int, int]) -> int:
    while k < len(ts) and ts[k].text not in (",", ";", ")", "]", "}"):
        k = partner.get(k, k) + 1 if ts[k].text in BRACKETS else k + 1
    return k


def _params(ts: list[Token], a: int, b: int, partner: dict[int, int]) -> int:
    n, k, some = 0, a + 1, False
    while k < b:
        if ts[k].text == ",":
            n, some = n + some, False
        else:
            some = True
        k = partner.get(k, k) + 1 if ts[k].text in BRACKETS else k + 1
    return n + some


def functions(code: str, ts: list[Token] | None = None) -> list[Function]:
    """PRS1: declarations, function expressions, arrow functions and methods, each with those directly in it."""
    ts = tokens(code) if ts is None else ts
    partner = _partners(ts)
    found: list[Function] = []
    for k, t in enumerate(ts):
        if t.text == "function" and t.kind == "word":
            j = k + 1 + (k + 1 < len(ts) and ts[k + 1].text == "*")
            name = ts[j].text if j < len(ts) and ts[j].kind == "word" else _assigned(ts, k)
            while j < len(ts) and ts[j].text != "(":
                j += 1
            close = partner.get(j)
            body = _block_after(ts, close + 1, partner) if close else None
            if body is not None and body in partner:
                found.append(Function(name, k - (k > 0 and ts[k - 1].text == "async"), body, partner[body] + 1, _params(ts, j, close, partner)))
        elif t.text == "=>":
            first, n = k - 1, 1
            if k and ts[k - 1].text == ")" and k - 1 in partner:
                first = partner[k - 1]
                n = _params(ts, first, k - 1, partner)
            elif k and (colon := _typed_arrow(ts, k, partner)) is not None:
                first = partner[colon - 1]
                n = _params(ts, first, colon - 1, partner)
            if first > 1 and ts[first].text == "(" and (less := _generics_begin(ts, first - 1, partner)) is not None and ts[less - 1].text in ("=", ":", "(", ",", "async", "return", "default", "=>", "?", "&&", "||", "??", "["):
                first = less
            first -= first > 0 and ts[first - 1].text == "async"
            if k + 1 < len(ts) and ts[k + 1].text == "{" and k + 1 in partner:
                end = partner[k + 1] + 1
            else:
                end = _expression_end(ts, k + 1, partner)
            if first >= 0 and end > k + 1:
                found.append(Function(_assigned(ts, first), first, k + 1, end, n))
        elif t.kind == "word" and t.text not in CONTROL_WORDS and not (k and ts[k - 1].text in (".", "?.", "new", "function")) and (paren := _after_generics(ts, k + 1, partner)) in partner and ts[paren].text == "(":
            close = partner[paren]
            body = _block_after(ts, close + 1, partner)
            if body is not None and body in partner and not (k and ts[k - 1].text == "function"):
                first = k
                while first and ts[first - 1].text in ("async", "static", "private", "public", "protected", "readonly", "get", "set", "override", "abstract"):
                    first -= 1
                found.append(Function(t.text, first, body, partner[body] + 1, _params(ts, paren, close, partner)))
    found.sort(key=lambda f: (f.first, -f.end))
    open_: list[Function] = []
    for f in found:
        while open_ and open_[-1].end <= f.first:
            open_.pop()
        if open_:
            open_[-1].inner.append(f)
        open_.append(f)
    return found


def _after_generics(ts: list[Token], k: int, partner: dict[int, int]) -> int:
    """The token after <...> that begins here; k itself if none does or it isn't closed before the statement is."""
    j, depth = k, 0
    while j < len(ts):
        text = ts[j].text
        if text == "<":
            depth += 1
        elif depth and text.strip(">") == "" and text:
            depth -= len(text)
            if depth <= 0:
                return j + 1 if depth == 0 else k
        elif not depth or text == ";" or text in BRACKETS.values():
            return k
        elif text in BRACKETS:
            if j not in partner:
                return k
            j = partner[j]
        j += 1
    return k


def _generics_begin(ts: list[Token], j: int, partner: dict[int, int]) -> int | None:
    """Where <...> that ends at this token begins."""
    depth = 0
    while j > 0:
        text = ts[j].text
        if text and text.strip(">") == "":
            depth += len(text)
        elif not depth or text == ";" or text in BRACKETS:
            return None
        elif text == "<":
            depth -= 1
            if depth <= 0:
                return j if depth == 0 else None
        elif text in BRACKETS.values():
            if j not in partner:
                return None
            j = partner[j]
        j -= 1
    return None


def _typed_arrow(ts: list[Token], k: int, partner: dict[int, int]) -> int | None:
    """The colon of a return type before =>, looking back over the type; a type is never left through an open bracket."""
    j = k - 1
    while j > 0 and ts[j].text not in (";", "=", ",") and ts[j].text not in BRACKETS:
        if ts[j].text == ":" and ts[j - 1].text == ")" and j - 1 in partner:
            return j
        if ts[j].text and ts[j].text.strip(">") == "" and (less := _generics_begin(ts, j, partner)) is not None:
            j = less - 1
        else:
            j = partner[j] - 1 if ts[j].text in BRACKETS.values() and j in partner else j - 1
    return None


def _assigned(ts: list[Token], k: int) -> str:
    """SCL3: the name that a function at this token is assigned to."""
    if k >= 2 and ts[k - 1].text == "async":
        k -= 1
    if k >= 2 and ts[k - 1].text in ("=", ":") and ts[k - 2].kind == "word":
        return ts[k - 2].text
    return "<anonymous>"


def complexity(ts: list[Token]) -> int:
    """PRS4-5: 1 and one for each if, else, case, loop, catch, conditional, logical operator and optional link.

    An else-if adds two, a do-while one; inner functions count in what holds them.
    """
    n = 1
    for k, t in enumerate(ts):
        if t.kind == "word":
            n += t.text in ("if", "else", "case", "for", "while", "catch") and not (k and ts[k - 1].text == ".")
        elif t.kind == "mark":
            n += t.text in ("&&", "||", "??", "?.") or (t.text == "?" and k + 1 < len(ts) and ts[k + 1].text not in (":", ")", ",", "="))
    return n


def unreachable(ts: list[Token]) -> bool:
    """PRS4, T12: whether a statement follows a return, throw, break or continue in the same block; comments don't count."""
    partner = _partners(ts)
    for k, t in enumerate(ts):
        if t.kind != "word" or t.text not in TERMINAL_WORDS or (k and ts[k - 1].text in (".", ")", "else", ":", "=>")):
            continue
        j = k + 1
        while j < len(ts) and ts[j].text not in (";", "}"):
            j = partner.get(j, j) + 1 if ts[j].text in BRACKETS else j + 1
        if j < len(ts) and ts[j].text == ";" and j + 1 < len(ts) and ts[j + 1].text not in ("}", "case", "default", ")"):
            return True
    return False


def halstead(ts: list[Token]) -> tuple[int, int, int, int, float]:
    """PRS6-7: different and all operators, different and all operands, and the volume N log2(n) in two places.

    Operators are keywords, punctuators other than brackets, commas and semicolons, and calls; operands
    are names, literals and this, super, true, false, null and undefined.
    """
    operators, operands = [], []
    for k, t in enumerate(ts):
        if t.kind == "word" and t.text in OPERATOR_WORDS:
            operators.append(t.text)
        elif t.kind == "mark":
            if t.text == "(" and k and _after_value(ts[k - 1 : k]):
                operators.append("()")
            elif t.text not in "(){}[],;@#":
                operators.append(t.text)
        elif t.kind != "other":
            operands.append(f"{t.kind}:{t.text}")
    n, size = len(set(operators)) + len(set(operands)), len(operators) + len(operands)
    volume = math.floor(size * math.log2(n) * 100 + 0.5) / 100 if n else 0.0
    return len(set(operators)), len(operators), len(set(operands)), len(operands), volume


def imported(ts: list[Token]) -> list[str]:
    """PRS8: what import, export from, require and import() name, each once in order."""
    found: dict[str, None] = {}
    for k, t in enumerate(ts):
        if t.kind != "string":
            continue
        a, b = (ts[k - 1].text if k else ""), (ts[k - 2].text if k > 1 else "")
        if a in ("from", "import") or (a == "(" and b in ("require", "import")):
            found.setdefault(t.text.strip("\"'"))
    return list(found)


def callback_depth(f: Function) -> int:
    """PRS13: how deep functions nest in this one."""
    return max((1 + callback_depth(g) for g in f.inner), default=0)


def smells(code: str, ts: list[Token], f: Function, path: str, line_of: Callable[[int], int]) -> list[tuple[str, str, int]]:
    """PRS11-14: long functions, many parameters, deep callbacks, console calls outside of loggers."""
    own = ts[f.first : f.end]
    first, last = line_of(own[0].start), line_of(own[-1].start)
    found = []
    if last - first + 1 > 80:
        found.append(("LongFunction", f"{last - first + 1} lines", first))
    if f.params > 7:
        found.append(("TooManyParams", f"{f.params} parameters", first))
    if callback_depth(f) > 3:
        found.append(("CallbackHell", f"{callback_depth(f)} nested functions", first))
    if not re.search("utils|logger", path or "", re.I):
        for k in range(len(own) - 3):
            if own[k].text == "console" and own[k + 1].text == "." and own[k + 2].text in CONSOLE and own[k + 3].text == "(":
                found.append(("ConsoleLog", "console call", line_of(own[k].start)))
    return found


def has_jsx(ts: list[Token]) -> bool:
    """SCL5: whether an element opens where a value may stand."""
    places = ("return", "(", "=>", "&&", "||", "?", ":", ",", "=", "[", "{")
    return any(t.text == "<" and k + 1 < len(ts) and (ts[k + 1].text == ">" or ts[k + 1].kind == "word") and (not k or ts[k - 1].text in places) for k, t in enumerate(ts))


def component(name: str, ts: list[Token], path: str) -> bool:
    """SCL4, SCL6: in .tsx and .jsx files, a function with a capital name or with elements in it."""
    return path.lower().endswith((".tsx", ".jsx")) and (name[:1].isupper() or has_jsx(ts))


def without_inner(code: str, ts: list[Token], f: Function) -> str:
    """PRS2: a function's code with the functions directly in it replaced by a remark."""
    begin, stop = ts[f.first].start, ts[f.end - 1].start + len(ts[f.end - 1].text)
    out, at = [], begin
    for g in f.inner:
        a, b = ts[g.first].start, ts[g.end - 1].start + len(ts[g.end - 1].text)
        if a >= at and b <= stop:
            out += [code[at:a], f"/* {g.name} */"]
            at = b
    return "".join([*out, code[at:stop]])


SCHEMA = (
    "path string, name string, start_line int, end_line int, params int, depth int, complexity int, volume double, operators int, operands int, unreachable boolean, component boolean, "
    "smells array<struct<type: string, message: string, line: int>>, imports array<string>, code string, error string, key string, nth int"
)

_SMELL = pa.struct([("type", pa.string()), ("message", pa.string()), ("line", pa.int32())])
_ARROW = pa.schema([
    ("path", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("params", pa.int32()), ("depth", pa.int32()), ("complexity", pa.int32()), ("volume", pa.float64()),
    ("operators", pa.int32()), ("operands", pa.int32()), ("unreachable", pa.bool_()), ("component", pa.bool_()), ("smells", pa.list_(_SMELL)), ("imports", pa.list_(pa.string())), ("code", pa.string()), ("error", pa.string()), ("key", pa.string()), ("nth", pa.int32()),
])


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, code, begin, key in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                found = _rows(path, code, begin)
            except (RecursionError, ValueError, IndexError) as problem:
                found = [{"path": path, "error": f"{type(problem).__name__}: {problem}"}]
            rows += [{**row, "key": key, "nth": n} for n, row in enumerate(found)]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _rows(path: str, code: str, begin: int) -> list[dict]:
    import bisect

    breaks = [m.start() for m in re.finditer("\n", code)]
    line_of = lambda at: begin + bisect.bisect_left(breaks, at)
    ts = tokens(code)
    names = imported(ts)
    rows = []
    for f in functions(code, ts):
        own = ts[f.first : f.end]
        _, n1, _, n2, volume = halstead(own)
        found = [{"type": a, "message": b, "line": c} for a, b, c in smells(code, ts, f, path, line_of)]
        rows.append({
            "path": path, "name": f.name, "start_line": line_of(own[0].start), "end_line": line_of(own[-1].start + len(own[-1].text) - 1), "params": f.params, "depth": callback_depth(f), "complexity": complexity(own),
            "volume": volume, "operators": n1, "operands": n2, "unreachable": unreachable(own), "component": component(f.name, own, path), "smells": found, "imports": names, "code": without_inner(code, ts, f), "error": None,
        })
    return rows


def parse(files: DataFrame, path: str = "path", code: str = "code", start: str | None = None, key: str | None = None) -> DataFrame:
    """SRC9-10, PRS1-16: one row for each function of every source file, see SCHEMA.

    Files that aren't JavaScript or TypeScript by their extension are left out, as are null and empty
    texts. A file that can't be read gives one row with only path and error; it never fails the job. With a
    ``key`` (a text that tells sources apart) repeated rows give their functions once.
    """
    suffix = F.lower(F.regexp_extract(F.col(path), r"\.([^./\\]*)$", 1))
    line = F.coalesce(F.col(start), F.lit(1)) if start else F.lit(1)
    name = F.col(key) if key else F.lit(None).cast("string")
    rows = files.where(suffix.isin(*EXTENSIONS) & (F.length(code) > 0)).select(F.col(path), F.col(code), line.cast("int").alias("begin"), name.alias("key"))
    found = spread(rows).mapInArrow(_parser, SCHEMA)
    return found.dropDuplicates(["key", "nth"]) if key else found.drop("key", "nth")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """PRS9-10: (src, dst) of the relative imports that name a file.

    imports: path, spec; files: path. A name may lack its extension or be a folder with an index file;
    of several candidates the first in the order of extensions wins. Nothing is looked up on disk.
    """
    from codelode.functions.text import normal_path

    endings = ["", *(f".{e}" for e in (*EXTENSIONS, "json")), *(f"/index.{e}" for e in (*EXTENSIONS, "json"))]
    folder = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/[^/]*$", "")
    full = normal_path(F.concat(folder, F.lit("/"), F.col("spec")))
    wanted = imports.where("spec like './%' or spec like '../%' or spec in ('.', '..')").select(F.col("path").alias("src"), "spec", full.alias("full"))
    tried = wanted.select("src", "spec", F.posexplode(F.array(*(F.concat("full", F.lit(e)) for e in endings))).alias("place", "key"))
    known = files.select(F.col("path").alias("dst"), normal_path(F.col("path")).alias("key")).distinct()
    found = tried.join(known, "key").groupBy("src", "spec").agg(F.min_by("dst", "place").alias("dst"))
    return found.select("src", "dst").distinct()
