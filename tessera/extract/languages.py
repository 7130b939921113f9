"""What the extractor knows of each language: extensions, how blocks end, comments, declarations and imports.

Python is read by its own grammar (python_source.py). The others are read by declaration patterns and block matching:
names, kinds, spans, calls and imports of ordinary sources are found, unusual layouts may be missed. `fidelity` tells
which applies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

W = r"[A-Za-z_][\w]*"
NOT_NAMES = frozenset("if for while switch catch return else do try new throw sizeof case when elif unless until foreach with using lock assert await yield function def fn sub in is not and or typeof defined".split())

#: Words before a bracket that declare nothing.
STATEMENTS = frozenset("if for while switch catch return else do try throw sizeof elif unless until foreach synchronized".split())


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    block: str  # brace, indent, end (keyword), line, paren, tag
    comment: tuple[str, ...]
    symbols: tuple[tuple[str, re.Pattern], ...] = ()
    imports: tuple[re.Pattern, ...] = ()
    bases: re.Pattern | None = None
    implements: re.Pattern | None = None
    calls: bool = True
    hide_values: bool = False
    fidelity: str = "patterns"
    extra: dict = field(default_factory=dict)


def _p(*pairs: tuple[str, str]) -> tuple[tuple[str, re.Pattern], ...]:
    """Patterns in which the last @ stands for the name, unless they name a group themselves."""
    named = lambda p: p if "(?P<name>" in p else f"(?P<name>{W})".join(p.rsplit("@", 1))
    return tuple((k, re.compile(named(p), re.M)) for k, p in pairs)


def _i(*patterns: str) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(p, re.M) for p in patterns)


C_FN = ("function", r"^(?:[\w:<>,*&\[\]~]+[ \t*&]+)+(?:\w+::)*@[ \t]*\([^;{}]*\)[^;{}]*\{")
C_TYPES = (("type", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+@\s*[^;()]*\{"),)
JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|async|override|virtual|sealed|partial|internal|readonly|extern|unsafe|default|open|suspend|inline|lazy|implicit)\s+)*"
METHOD = ("method", rf"^\s*{JAVA_MODS}(?:<[^>]*>\s*)?[\w<>\[\],.?]+\s+@\s*\([^;{{}}]*\)[^;{{}}]*\{{")
JS = _p(("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+@"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*@"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+@\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*@\s*\([^;{}]*\)\s*(?::[^{;]+)?\{"))
TS = JS + _p(("type", r"^\s*(?:export\s+)?interface\s+@"), ("type", r"^\s*(?:export\s+)?type\s+@[^=\n]*="), ("type", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+@"))
JS_IMPORT = _i(r"^\s*import\s+(?:[^'\";]*\sfrom\s+)?['\"]([^'\"]+)['\"]")
INCLUDE = _i(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]")
EXTENDS, IMPLEMENTS = re.compile(r"\bextends\s+([\w.$<>, ]+?)(?=\s+(?:implements|with)\b|\s*\{|$)"), re.compile(r"\bimplements\s+([\w.$<>, ]+?)\s*\{")
COLON = re.compile(r"^[^{]*?\b(?:class|struct|interface)\s+\w+[^:{]*:\s*([^{]+)")
SLASH, HASH, DASH, SEMI = ("//", "/*", "*"), ("#",), ("--",), (";",)
LISP = _p(("function", r"^\(\s*(?:defun|defmacro|defgeneric|defmethod|define-syntax)\s+(?P<name>[^\s()]+)"), ("function", r"^\(\s*define\s+\(?(?P<name>[^\s()]+)"))

_ALL = [
    Language("python", (".py",), "indent", HASH, fidelity="grammar"),
    Language("javascript", (".js", ".jsx"), "brace", SLASH, JS, JS_IMPORT, EXTENDS),
    Language("typescript", (".ts", ".tsx"), "brace", SLASH, TS, JS_IMPORT, EXTENDS, IMPLEMENTS),
    Language("go", (".go",), "brace", SLASH, _p(("function", r"^func\s+@\s*(?:\[[^\]]*\])?\("), ("method", r"^func\s*\([^)]*\)\s*@\s*\("), ("type", r"^type\s+@\s")), _i(r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", r"^\s+(?:\w+\s+)?\"([^\"]+)\"\s*$")),
    Language("rust", (".rs",), "brace", SLASH, _p(("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+@"), ("class", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?@"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type|union)\s+@")), _i(r"^\s*(?:pub\s+)?use\s+([\w:]+)"), re.compile(r"\btrait\s+\w+[^:{]*:\s*([^{]+)")),
    Language("java", (".java",), "brace", SLASH, _p(("class", rf"^\s*{JAVA_MODS}(?:class|record)\s+@"), ("type", rf"^\s*{JAVA_MODS}(?:interface|enum|@interface)\s+@"), METHOD), _i(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"), EXTENDS, IMPLEMENTS),
    Language("php", (".php",), "brace", (*SLASH, "#"), _p(("class", r"^\s*(?:abstract\s+|final\s+)*class\s+@"), ("type", r"^\s*(?:interface|trait|enum)\s+@"), ("function", r"^function\s+&?@"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?@")), _i(r"^\s*use\s+([\w\\]+)"), EXTENDS, IMPLEMENTS),
    Language("c", (".c", ".h"), "brace", SLASH, _p(C_FN, *C_TYPES), INCLUDE),
    Language("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hh"), "brace", SLASH, _p(("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+@\s*[^;]*\{"), C_FN, *C_TYPES), INCLUDE + _i(r"^\s*using\s+(?:namespace\s+)?([\w:]+)"), COLON),
    Language("c_sharp", (".cs",), "brace", SLASH, _p(("class", rf"^\s*{JAVA_MODS}(?:class|record)\s+@"), ("type", rf"^\s*{JAVA_MODS}(?:interface|enum|struct)\s+@"), METHOD), _i(r"^\s*using\s+([\w.]+)\s*;"), COLON),
    Language("ruby", (".rb",), "end", HASH, _p(("class", r"^\s*class\s+(?:\w+::)*@"), ("type", r"^\s*module\s+(?:\w+::)*@"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")), bases=re.compile(r"class\s+[\w:]+\s*<\s*([\w:]+)")),
    Language("swift", (".swift",), "brace", SLASH, _p(("class", r"^\s*(?:\w+\s+)*(?:class|struct|actor)\s+@"), ("type", r"^\s*(?:\w+\s+)*(?:protocol|enum|extension|typealias)\s+@"), ("function", r"^\s*(?:[\w@]+\s+)*func\s+@")), _i(r"^\s*import\s+(\w+)"), COLON),
    Language("kotlin", (".kt", ".kts"), "brace", SLASH, _p(("class", r"^\s*(?:\w+\s+)*class\s+@"), ("type", r"^\s*(?:\w+\s+)*(?:interface|object|typealias)\s+@"), ("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?@")), _i(r"^\s*import\s+([\w.*]+)"), re.compile(r"\bclass\s+\w+[^:{]*(?:\([^)]*\))?\s*:\s*([^{]+)")),
    Language("dart", (".dart",), "brace", SLASH, _p(("class", r"^\s*(?:abstract\s+)?class\s+@"), ("type", r"^\s*(?:mixin|enum|extension|typedef)\s+@"), METHOD, C_FN), _i(r"^\s*(?:import|export)\s+'([^']+)'"), EXTENDS, IMPLEMENTS, calls=False),
    Language("perl", (".pl", ".pm"), "brace", HASH, _p(("function", r"^\s*sub\s+@"), ("type", r"^\s*package\s+(?P<name>[\w:]+)")), _i(r"^\s*use\s+([\w:]+)")),
    Language("lua", (".lua",), "end", DASH, _p(("function", r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)"), ("function", r"^\s*(?:local\s+)?@\s*=\s*function\b"))),
    Language("bash", (".sh", ".bash"), "brace", HASH, _p(("function", r"^\s*(?:function\s+)@\b"), ("function", r"^\s*@\s*\(\s*\)"))),
    Language("scala", (".scala",), "brace", SLASH, _p(("class", r"^\s*(?:\w+\s+)*(?:class|object)\s+@"), ("type", r"^\s*(?:\w+\s+)*(?:trait|type|enum)\s+@"), ("function", r"^\s*(?:\w+\s+)*def\s+@")), bases=EXTENDS),
    Language("r", (".r", ".R"), "brace", HASH, _p(("function", r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b"))),
    Language("elixir", (".ex", ".exs"), "end", HASH, _p(("class", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^\s*(?:defp?|defmacrop?)\s+(?P<name>\w+[?!]?)")), calls=False),
    Language("julia", (".jl",), "end", HASH, _p(("function", r"^\s*(?:function|macro)\s+(?P<name>[\w.!]+)"), ("class", r"^\s*(?:mutable\s+)?(?:struct|module)\s+@"), ("class", r"^\s*abstract\s+type\s+@")), _i(r"^\s*(?:using|import)\s+([\w.]+)")),
    Language("clojure", (".clj", ".cljc", ".cljs"), "paren", SEMI, _p(("function", r"^\s*\((?:defn-?|defmacro|defmulti|defmethod|def)\s+(?P<name>[^\s()\[\]]+)")), calls=False),
    Language("nim", (".nim", ".nims"), "indent", HASH, _p(("function", r"^\s*(?:proc|func|method|template|macro|iterator)\s+@"), ("type", r"^\s+@\*?\s*=\s*(?:ref\s+)?(?:object|enum|tuple)")), _i(r"^\s*(?:import|include)\s+([\w/]+)")),
    Language("haskell", (".hs",), "indent", DASH, _p(("class", r"^(?:data|newtype|class|instance)\s+(?:[\w ]+=>\s*)?@"), ("function", r"^(?P<name>[a-z_]\w*'*)\s*::")), _i(r"^import\s+(?:qualified\s+)?([\w.]+)"), calls=False),
    Language("erlang", (".erl", ".hrl"), "line", ("%",), _p(("class", r"^-module\((?P<name>\w+)\)"), ("type", r"^-(?:type|record)\s*\(?\s*(?P<name>\w+)"), ("function", r"^(?P<name>[a-z]\w*)\s*\([^)]*\)\s*(?:when[^-]*)?->"))),
    Language("zig", (".zig",), "brace", ("//",), _p(("function", r"^\s*(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+@"), ("class", r"^\s*(?:pub\s+)?const\s+@\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)")), calls=False),
    Language("d", (".d",), "brace", SLASH, _p(("class", r"^\s*(?:\w+\s+)*(?:class|struct)\s+@"), ("type", r"^\s*(?:interface|enum|union|alias)\s+@"), C_FN), _i(r"^\s*import\s+([\w.]+)")),
    Language("objc", (".mm",), "brace", SLASH, _p(("class", r"^@(?:interface|implementation|protocol)\s+(?P<name>\w+)"), ("method", r"^[-+]\s*\([^)]*\)\s*(?P<name>\w+)")), _i(r"^\s*#\s*(?:import|include)\s*[<\"]([^>\"]+)")),
    Language("ocaml", (".ml", ".mli"), "indent", ("(*",), _p(("function", r"^\s*(?:let|val)\s+(?:rec\s+)?@"), ("type", r"^\s*type\s+(?:'\w+\s+)?@"), ("class", r"^\s*(?:module|class)\s+(?:type\s+)?@")), _i(r"^\s*open\s+([\w.]+)"), calls=False),
    Language("fsharp", (".fs", ".fsi", ".fsx"), "indent", ("//", "(*"), _p(("function", r"^\s*let\s+(?:rec\s+|inline\s+|private\s+)*@"), ("type", r"^\s*type\s+@"), ("class", r"^\s*module\s+(?P<name>[\w.]+)")), _i(r"^\s*open\s+([\w.]+)"), calls=False),
    Language("elm", (".elm",), "indent", DASH, _p(("function", r"^(?P<name>[a-z]\w*)\s*:"), ("type", r"^type\s+(?:alias\s+)?@")), _i(r"^import\s+([\w.]+)"), calls=False),
    Language("sql", (".sql",), "line", DASH, _p(("class", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?[`\"]?(?P<name>[\w.]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+(?P<name>[\w.]+)"), ("constant", r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.]+)")), calls=False),
    Language("powershell", (".ps1", ".psm1"), "brace", HASH, _p(("function", r"(?i)^\s*function\s+(?P<name>[\w-]+)"), ("class", r"(?i)^\s*class\s+@")), calls=False),
    Language("solidity", (".sol",), "brace", SLASH, _p(("class", r"^\s*(?:abstract\s+)?(?:contract|library|interface)\s+@"), ("class", r"^\s*(?:struct|enum)\s+@"), ("function", r"^\s*(?:function|modifier|event)\s+@")), calls=False),
    Language("hcl", (".tf", ".tfvars"), "brace", ("#", "//"), _p(("class", r"^(?:resource|data)\s+\"[^\"]*\"\s+\"(?P<name>[^\"]+)\""), ("class", r"^(?:module|variable|output|provider)\s+\"(?P<name>[^\"]+)\"")), calls=False),
    Language("proto", (".proto",), "brace", SLASH, _p(("class", r"^\s*(?:message|service|enum)\s+@"), ("function", r"^\s*rpc\s+@")), calls=False),
    Language("graphql", (".graphql", ".gql"), "brace", HASH, _p(("class", r"^\s*(?:extend\s+)?(?:type|interface|enum|input|union|scalar|fragment|query|mutation|subscription)\s+@")), calls=False),
    Language("css", (".css",), "brace", ("/*",), _p(("class", r"^(?P<name>[.#\w][^{}@;]*?)\s*\{"), ("function", r"^@(?:media|keyframes|supports)\s+(?P<name>[^{]+?)\s*\{")), calls=False),
    Language("scss", (".scss",), "brace", SLASH, _p(("function", r"^\s*@(?:mixin|function)\s+(?P<name>[\w-]+)"), ("constant", r"^(?P<name>\$[\w-]+)\s*:"), ("class", r"^(?P<name>[.#%&\w][^{}@;$]*?)\s*\{")), calls=False),
    Language("html", (".html", ".htm"), "tag", ("<!--",), _p(("class", r"<(?:\w+)[^>]*\bid=[\"'](?P<name>[^\"']+)[\"']"), ("class", r"<(?P<name>form|nav|main|article|section|header|footer)\b")), calls=False, hide_values=True),
    Language("xml", (".xml", ".xsl", ".xsd"), "tag", ("<!--",), _p(("class", r"<(?P<name>[A-Za-z_][\w:.-]*)(?=[\s>/])")), calls=False, hide_values=True),
    Language("yaml", (".yaml", ".yml"), "indent", HASH, _p(("constant", r"^(?P<name>[\w./-]+)\s*:(?=\s|$)")), calls=False, hide_values=True),
    Language("json", (".json",), "line", (), _p(("constant", r"^(?:\{|\s{1,4}|\t)\s*\"(?P<name>[^\"]+)\"\s*:")), calls=False, hide_values=True),
    Language("toml", (".toml",), "line", HASH, _p(("class", r"^\[+(?P<name>[^\]\n]+)\]+"), ("constant", r"^(?P<name>[\w.-]+)\s*=")), calls=False, hide_values=True),
    Language("make", (".mk",), "indent", HASH, _p(("function", r"^(?P<name>[\w./%-]+)\s*:(?!=)")), calls=False),
    Language("fortran", (".f90", ".f95", ".f03", ".f08", ".f"), "end", ("!",), _p(("function", r"(?i)^\s*(?:[\w()]+\s+)*(?:subroutine|function)\s+@"), ("class", r"(?i)^\s*(?:program|module)\s+(?!procedure)@")), _i(r"(?i)^\s*use\s+(\w+)")),
    Language("cmake", (".cmake",), "line", HASH, _p(("function", r"(?i)^\s*(?:function|macro)\s*\(\s*@")), calls=False),
    Language("matlab", (".m",), "end", ("%",), _p(("function", r"^\s*function\s+(?:[^=\n]*=\s*)?(?P<name>[\w.]+)"))),
    Language("cuda", (".cu", ".cuh"), "brace", SLASH, _p(("function", r"^\s*(?:__\w+__\s+)+(?:[\w*&<>:]+\s+)+@\s*\("), C_FN, *C_TYPES), INCLUDE),
    Language("v", (".vv",), "brace", SLASH, _p(("function", r"^\s*(?:pub\s+)?fn\s+(?:\([^)]*\)\s*)?@"), ("class", r"^\s*(?:pub\s+)?(?:struct|enum|interface)\s+@")), _i(r"^\s*import\s+([\w.]+)")),
    Language("gleam", (".gleam",), "brace", ("//",), _p(("function", r"^\s*(?:pub\s+)?(?:fn|type|const)\s+@")), _i(r"^\s*import\s+([\w/]+)")),
    Language("odin", (".odin",), "brace", SLASH, _p(("function", r"^\s*@\s*::\s*(?:#\w+\s+)?(?:proc|struct|enum|union)")), _i(r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"")),
    Language("gdscript", (".gd",), "indent", HASH, _p(("function", r"^\s*(?:static\s+)?func\s+@"), ("constant", r"^\s*const\s+@"), ("class", r"^\s*class(?:_name)?\s+@"))),
    Language("verilog", (".sv",), "end", SLASH, _p(("class", r"^\s*(?:module|interface|package|class|program)\s+@")), calls=False),
    Language("vhdl", (".vhd", ".vhdl"), "end", DASH, _p(("class", r"(?i)^\s*(?:entity|architecture|package|component)\s+(?!body)@")), calls=False),
    Language("ada", (".adb", ".ads"), "end", DASH, _p(("function", r"(?i)^\s*(?:procedure|function|package(?:\s+body)?|task)\s+(?P<name>[\w.]+)")), _i(r"(?i)^\s*with\s+([\w.]+)"), calls=False),
    Language("pascal", (".pas", ".pp"), "end", ("//", "{", "(*"), _p(("function", r"(?i)^\s*(?:procedure|function|constructor|destructor)\s+(?P<name>[\w.]+)"), ("class", r"(?i)^\s*@\s*=\s*(?:class|record|interface)")), calls=False),
    Language("commonlisp", (".lisp", ".cl", ".lsp"), "paren", SEMI, LISP, calls=False),
    Language("scheme", (".scm", ".ss"), "paren", SEMI, LISP, calls=False),
    Language("racket", (".rkt",), "paren", SEMI, LISP, calls=False),
    Language("tcl", (".tcl",), "brace", HASH, _p(("function", r"^\s*proc\s+(?P<name>[\w:]+)")), calls=False),
    Language("dockerfile", (".dockerfile",), "line", HASH, _p(("class", r"(?i)^\s*FROM\s+(?P<name>\S+)")), calls=False, hide_values=True),
    Language("glsl", (".glsl", ".vert", ".frag", ".geom", ".comp"), "brace", SLASH, _p(C_FN, *C_TYPES)),
    Language("hlsl", (".hlsl", ".fx"), "brace", SLASH, _p(C_FN)),
    Language("wgsl", (".wgsl",), "brace", SLASH, _p(("function", r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*fn\s+(?P<name>\w+)"), ("class", r"^\s*struct\s+@")), calls=False),
    Language("nix", (".nix",), "line", HASH, _p(("constant", r"^\s*(?P<name>[\w.-]+)\s*=")), calls=False, hide_values=True),
]
LANGUAGES = {x.name: x for x in _ALL}
EXTENSIONS = {e: x.name for x in _ALL for e in x.extensions}
