"""Symbols of other languages by declaration patterns and block matching."""

from __future__ import annotations

import hashlib
import re

from tessera.extract.languages import NOT_NAMES, STATEMENTS, Language

CALL = re.compile(r"([A-Za-z_]\w*)\s*!?\(")
BRANCHES = re.compile(r"\b(?:if|elif|elsif|else\s+if|for|foreach|while|until|case|catch|rescue|when|except)\b|\?(?!\.|\?)[^:\n]*:")
NESTS = re.compile(r"\b(?:if|for|foreach|while|until|switch|match|case|try|catch|unless|loop|select|with)\b")
BOOLEANS = re.compile(r"&&|\|\||\b(?:and|or)\b")
ENDS = re.compile(r"^\s*(?:end\b|END\b|endfunction\b|endmodule\b)", re.M)


def blank_strings(source: str, comment: tuple[str, ...]) -> str:
    """The source with the insides of strings and comments as blanks, positions unchanged."""
    line = [re.escape(c) + r"[^\n]*" for c in comment if c not in ("/*", "(*", "{", "<!--", "*")]
    parts = ([r"/\*.*?\*/"] if "/*" in comment else []) + ([r"\(\*.*?\*\)"] if "(*" in comment else []) + line
    rx = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){0,200}'" + "".join(f"|{p}" for p in parts), re.S)
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if len(m.group()) > 1 else m.group(), source)


def _end(code: str, lines: list[int], start: int, head_end: int, lang: Language) -> int:
    """Where the block of a declaration ends."""
    if lang.block in ("brace", "paren"):
        a, b = ("{", "}") if lang.block == "brace" else ("(", ")")
        at = code.find(a, start)
        stop = code.find(";", head_end) if lang.block == "brace" else -1
        if at < 0 or (0 <= stop < at):
            return stop + 1 if stop >= 0 else _eol(code, head_end)
        depth = 0
        for m in re.compile(f"[{re.escape(a)}{re.escape(b)}]").finditer(code, at):
            depth += 1 if m.group() == a else -1
            if not depth:
                return m.end()
        return len(code)
    if lang.block in ("indent", "end"):
        first = code.rfind("\n", 0, start) + 1
        first = first + len(code[first:]) - len(code[first:].lstrip(" \t\n")) if not code[first:start].strip() else first
        bol = code.rfind("\n", 0, first) + 1
        indent, at, last = len(code[bol:first].expandtabs()), _eol(code, first), _eol(code, first)
        while at < len(code):
            nxt = _eol(code, at + 1)
            text = code[at + 1 : nxt]
            if text.strip():
                own = len(text.expandtabs()) - len(text.expandtabs().lstrip())
                if own <= indent:
                    return nxt if lang.block == "end" and ENDS.match(text) else last
                last = nxt
            at = nxt
        return last
    return _eol(code, head_end)


def _eol(code: str, at: int) -> int:
    e = code.find("\n", at)
    return len(code) if e < 0 else e


def complexity(body: str, signature: str, loc: int) -> dict:
    depth = deepest = cognitive = 0
    branches = len(BRANCHES.findall(body))
    opens: list[bool] = []
    last = 0
    for m in re.finditer(r"[{}]", body):
        if m.group() == "{":
            nest = bool(NESTS.search(body, last, m.start()))
            opens.append(nest)
            depth += nest
            deepest = max(deepest, depth)
        elif opens:
            depth -= opens.pop()
        last = m.end()
    depth = 0
    opens, last = [], 0
    for m in re.finditer(r"[{}]", body):
        cognitive += len(BRANCHES.findall(body[last : m.start()])) * (1 + depth)
        if m.group() == "{":
            nest = bool(NESTS.search(body, last, m.start()))
            opens.append(nest)
            depth += nest
        elif opens:
            depth -= opens.pop()
        last = m.end()
    cognitive += len(BRANCHES.findall(body[last:]))
    bools = len(BOOLEANS.findall(body))
    inside = re.search(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*[^()]*$", signature)
    params = len([p for p in inside.group(1).split(",") if p.strip() and p.strip() not in ("void", "self", "&self", "&mut self")]) if inside else 0
    return {"cyclomatic": 1 + branches + bools, "cognitive": cognitive + bools, "max_nesting": deepest, "param_count": params, "loc": loc}


def _doc(source: str, start: int, comment: tuple[str, ...]) -> str:
    """The comment lines right above a declaration, without their marks."""
    out: list[str] = []
    for line in reversed(source[:start].split("\n")[:-1]):
        s = line.strip()
        if s.startswith(("@", "#[", "[")) and not out:
            continue
        if not s or not (comment and s.startswith(tuple(comment)) or s.endswith("*/") or (out and s.startswith("*"))):
            break
        out.append(re.sub(r"^(?:/\*+|\*+/?|//+!?|#+!?|--+|;+|%+|<!--)\s?|\s*(?:\*+/|-->)$", "", s))
    return "\n".join(reversed([x for x in out if x.strip()])).strip()


def extract(source: str, file: str, lang: Language) -> list[dict]:
    code = blank_strings(source, lang.comment) if not lang.hide_values and lang.name not in ("hcl",) else source
    found: dict[int, tuple[int, int, str, str]] = {}
    for kind, rx in lang.symbols:
        for m in rx.finditer(code):
            name = m.group("name").strip()
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            if name in STATEMENTS or at in found or re.match(r"(?:return|else|new|throw|case|await)\b", code[at : m.end()]):
                continue
            found[at] = (m.end(), _end(code, [], at, m.end(), lang), kind, name)
    data_at = lambda i: len(source[:i].encode("utf-8", "replace"))
    rows: list[dict] = []
    open_: list[tuple[int, dict]] = []
    for at in sorted(found):
        head_end, end, kind, name = found[at]
        while open_ and open_[-1][0] <= at:
            open_.pop()
        parent = open_[-1][1] if open_ and lang.block in ("brace", "end", "indent") else None
        if parent and kind == "function":
            kind = "method"
        text = source[at:end]
        brace = code.find("{", at, end) if lang.block == "brace" else -1
        sig = name if lang.hide_values else source[at : brace if brace >= 0 else _eol(code, head_end)].strip().rstrip("{: \n\t")
        line = source.count("\n", 0, at) + 1
        end_line = line + text.count("\n")
        body = code[brace + 1 : end] if brace >= 0 else code[_eol(code, at) : end]
        calls = list(dict.fromkeys(c for c in CALL.findall(body) if c not in NOT_NAMES)) if lang.calls and kind in ("function", "method") else []
        bases = _names(lang.bases, code[at:end].split("\n{")[0][:500]) if kind in ("class", "type") else []
        impl = _names(lang.implements, code[at : at + 500]) if kind in ("class", "type") else []
        raw = text.encode("utf-8", "replace")
        row = {"file": file, "name": name, "qualified_name": f"{parent['name']}.{name}" if parent else name, "kind": kind, "language": lang.name, "parent": parent, "line": line, "end_line": end_line, "byte_offset": data_at(at), "byte_length": len(raw), "content_hash": hashlib.sha256(raw).hexdigest(), "signature": sig, "docstring": _doc(source, at, lang.comment), "decorators": [], "calls": calls, "imports": [], "inherits_from": bases, "implements": impl, "complexity": complexity(body, sig, end_line - line + 1) if kind in ("function", "method") else None}
        rows.append(row)
        open_.append((end, row))
    imports = list(dict.fromkeys(i.strip() for rx in lang.imports for i in rx.findall(source) if i.strip()))
    if imports:
        top = [r for r in rows if r["parent"] is None]
        for r in top:
            r["imports"] = imports
        if not top:
            rows.append({"file": file, "name": "(module)", "qualified_name": "(module)", "kind": "symbol", "language": lang.name, "parent": None, "line": 1, "end_line": 1, "byte_offset": 0, "byte_length": 0, "content_hash": "", "signature": file, "docstring": "", "decorators": [], "calls": [], "imports": imports, "inherits_from": [], "implements": [], "complexity": None})
    return rows


def _names(rx: re.Pattern | None, head: str) -> list[str]:
    m = rx.search(head) if rx else None
    if not m:
        return []
    parts = re.split(r"[,+]|\bwith\b", re.sub(r"<[^<>]*>", "", m.group(1)))
    parts = [re.sub(r"\(.*", "", p) for p in parts]
    return list(dict.fromkeys(x.split("::")[-1].split(".")[-1] for p in parts for x in [re.sub(r"^(?:public|private|protected|virtual)\s+", "", p.strip())] if x))
