"""String functions as Column expressions; all stay inside whole-stage codegen unless noted."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = Column | str

# ---- fixed values: the suffix rules of the stemmer (suffix, replacement), in order; a stem keeps three letters or more
STEM_RULES = [("ation", "ate"), ("ating", "ate"), ("ment", ""), ("ness", ""), ("ible", ""), ("able", ""), ("ence", ""), ("ance", ""), ("less", ""), ("ful", ""), ("ous", ""), ("ive", ""), ("ity", ""), ("ing", ""), ("ly", ""), ("er", "e"), ("ed", "e"), ("es", ""), ("al", ""), ("s", "")]

# ---- fixed values: shapes of secrets, tried in this order, in any case
SECRETS = [
    r"sk-[a-zA-Z0-9_\-]{20,}",
    r"sk_live_[a-zA-Z0-9]{24,}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"gho_[a-zA-Z0-9]{36}",
    r"ghu_[a-zA-Z0-9]{36}",
    r"ghs_[a-zA-Z0-9]{36}",
    r"github_pat_[a-zA-Z0-9_]{20,}",
    r"AKIA[A-Z0-9]{16}",
    r"xox[bprs]-[a-zA-Z0-9\-]{10,}",
    r"glpat-[a-zA-Z0-9\-]{20,}",
    r"hf_[a-zA-Z0-9]{34,}",
    r"npm_[a-zA-Z0-9]{36,}",
    r"pypi-[a-zA-Z0-9_\-]{32,}",
    r"AIza[a-zA-Z0-9\-_]{35}",
    r"rk_live_[a-zA-Z0-9]{24,}",
    r"rk_test_[a-zA-Z0-9]{24,}",
    r"SG\.[a-zA-Z0-9_\-]{22,}\.[a-zA-Z0-9_\-]{22,}",
    r"AC[a-f0-9]{32}",
    r"key-[a-zA-Z0-9]{32}",
    r"DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[^;\s]+",
    r"(?:postgres|mysql|mongodb(?:\+srv)?|redis|amqp)://[^:\s]+:[^@\s]+@",
    r"Bearer\s+[A-Za-z0-9\-._~+/]{20,}",
    r"-----BEGIN [A-Z ]+ KEY-----",
    r"(?:password|passwd|secret|api_key|apikey|token|auth|aws_secret_access_key|aws_session_token|twilio)\s*=\s*[\"'][^\"']{4,}[\"']",
]
SECRET = "(?i)(" + "|".join(SECRETS) + ")"

# ---- fixed values: names that no caller needs to reach, and decorator parts of entry points
ENTRY_NAMES = "main __init__ __main__ __post_init__ __new__ __del__ __str__ __repr__ __eq__ __hash__ __lt__ __le__ __gt__ __ge__ __len__ __getitem__ __setitem__ __delitem__ __contains__ __iter__ __next__ __enter__ __exit__ __call__ __bool__ __add__ __sub__ __mul__ __truediv__".split()
ENTRY_DECORATORS = "route endpoint fixture hook export main cli command app. api. pytest.".split()
TEST_PREFIXES, TEST_DIRS = ("test/", "tests/", "__tests__/"), ("/tests/", "/__tests__/")
TEST_SUFFIXES = "_test.py _test.go .test.js .test.ts .test.tsx .test.jsx _spec.rb Test.java Test.kt".split()

# ---- fixed values: file names that hold secrets, and extensions of binary files
SECRET_FILES = ".env .env.* *.pem *.key *.p12 *.pfx *.jks *.keystore id_rsa* id_ed25519* id_ecdsa* id_dsa* *.pub credentials.json service-account*.json secret* *.secret token* *.token .npmrc .pypirc .netrc .htpasswd .htaccess wp-config.php config.php database.yml shadow passwd master.key *.tfvars terraform.tfstate terraform.tfstate.backup .dockercfg docker-compose*.yml kubeconfig *.kubeconfig known_hosts authorized_keys .bash_history .python_history .psql_history *.csr .sops.yaml vault.json application.properties application.yml appsettings*.json .yarnrc.yml *.p8 *.asc".split()
BINARY_EXTENSIONS = ".png .jpg .jpeg .gif .bmp .ico .svg .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .tar .gz .bz2 .7z .rar .exe .dll .so .dylib .o .a .pyc .pyo .class .wasm .mp3 .mp4 .avi .mov .wav .ttf .otf .woff .woff2 .eot .sqlite .db".split()

# ---- fixed values: licence names and classes
LICENSE_NAMES = {"MIT License": "MIT", "Apache License 2.0": "Apache-2.0", "Apache License, Version 2.0": "Apache-2.0", "BSD License": "BSD-3-Clause", "ISC License": "ISC", "GNU General Public License v3.0": "GPL-3.0", "Mozilla Public License 2.0": "MPL-2.0"}
PERMISSIVE = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD Unlicense CC0-1.0 Zlib BSL-1.0".split()
COPYLEFT = "GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EUPL-1.2 GPL-2.0-only GPL-3.0-only GPL-2.0-or-later GPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later".split()


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: C) -> Column:
    return F.coalesce(col(c), F.lit(""))


def split_identifier(c: C) -> Column:
    """Distinct lower-case words of a snake_case, kebab-case or camelCase name."""
    parts = F.flatten(F.transform(F.split(text(c), r"[_\-\s]+"), lambda p: F.split(p, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")))
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda w: w != ""))


def stem(c: C) -> Column:
    """Suffix-stripped lower-case word; words of up to three letters stay."""
    w = F.lower(col(c))
    out = F.when(F.length(w) <= 3, w)
    for suffix, new in STEM_RULES:
        out = out.when(w.endswith(suffix) & (F.length(w) >= len(suffix) + 3), F.concat(F.substr(w, F.lit(1), F.length(w) - len(suffix)), F.lit(new)))
    return out.otherwise(w)


def stem_word(word: str) -> str:
    """stem() of a literal."""
    w = word.lower()
    hit = next(((s, n) for s, n in STEM_RULES if w.endswith(s) and len(w) >= len(s) + 3), None) if len(w) > 3 else None
    return w[: -len(hit[0])] + hit[1] if hit else w


def stems(words: Column) -> Column:
    return F.array_distinct(F.transform(words, stem))


def words(c: C) -> Column:
    """Distinct white-space tokens, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != ""))


def keyword_score(query: str) -> Column:
    """Integer relevance of a symbol row (name, signature, summary, keywords, docstring) for a query."""
    q = query.lower()
    tokens = list(dict.fromkeys(q.split()))
    name, signature, summary, doc = (F.lower(text(c)) for c in ("name", "signature", "summary", "docstring"))
    one = lambda cond, points: F.when(cond, points).otherwise(0)
    score = F.when(name == q, 20).when(name.contains(q), 10).otherwise(0) + one(signature.contains(q), 8) + one(summary.contains(q), 5)
    for w in tokens:
        score = score + one(name.contains(w), 5) + one(signature.contains(w), 2) + one(summary.contains(w), 1) + one(doc.contains(w), 1)
    if tokens:
        mine = F.array(*[F.lit(w) for w in tokens])
        mine_stems = F.array(*[F.lit(w) for w in dict.fromkeys(map(stem_word, tokens))])
        shared = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))
        sig_words = F.array_distinct(F.flatten(F.transform(words("signature"), split_identifier)))
        score = score + shared(mine, F.coalesce("keywords", F.array().cast("array<string>"))) * 3 + shared(mine_stems, stems(split_identifier("name"))) * 4 + shared(mine_stems, stems(sig_words)) + shared(mine_stems, stems(words("summary"))) * 2
    return score


def glob_regex(pattern: str) -> str:
    """Anchored Java regex for a file glob: it may match from any directory on; `*` crosses directories."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", body, flags=re.S)
    body = body.replace("(?>.*?", "(?>.*?")
    return rf"(?s)^(?:.*/)?(?:{body})$"


def glob_match(c: C, pattern: str | None) -> Column:
    """Whether a path fits a glob; simple ones become string predicates that push down to the scan."""
    if not pattern:
        return F.lit(True)
    if pattern.count("[") > 5:
        return F.lit(False)
    if re.fullmatch(r"\*[^*?\[\]]+", pattern):
        return col(c).endswith(pattern[1:])
    if not re.search(r"[*?\[]", pattern):
        return (col(c) == pattern) | col(c).endswith("/" + pattern)
    return col(c).rlike(glob_regex(pattern))


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition (Spark has no built-in form)."""
    import unicodedata

    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def redact_secrets(c: C) -> Column:
    """Secrets replaced by <REDACTED>."""
    return F.regexp_replace(col(c), SECRET, "<REDACTED>")


def redact(c: C, limit: int | None = 10_000, normalise: bool = True) -> Column:
    """Format and C1 characters out, compatibility forms decomposed, secrets replaced, cut to `limit` characters."""
    c = F.regexp_replace(col(c), r"[\p{Cf}\x7f-\x9f]", "")
    c = redact_secrets(nfkd(c) if normalise else c)
    return F.left(c, F.lit(limit)) if limit else c


def clean_list(c: C) -> Column:
    """A list column as it is stored: control characters out, secrets replaced, items and list cut to their limits."""
    return F.slice(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.left(redact_secrets(F.regexp_replace(x, r"[\x00-\x1f\x7f-\x9f]", "")), F.lit(200))), 1, 500)


def is_test_file(c: C) -> Column:
    name = F.substring_index(F.replace(col(c), F.lit("\\"), F.lit("/")), "/", -1)
    out = name.startswith("test_")
    for s in TEST_SUFFIXES:
        out = out | name.endswith(s)
    for d in TEST_DIRS:
        out = out | col(c).contains(d)
    for p in TEST_PREFIXES:
        out = out | col(c).startswith(p)
    return out


def is_entry_point(name: C = "name", decorators: C | None = "decorators") -> Column:
    n = text(name)
    out = n.isin(ENTRY_NAMES) | n.startswith("test_") | n.startswith("Test")
    if decorators is not None:
        hit = "|".join(re.escape(d) for d in ENTRY_DECORATORS)
        out = out | F.coalesce(F.exists(col(decorators), lambda d: F.lower(text(d)).rlike(hit)), F.lit(False))
    return out


def basename(c: C) -> Column:
    return F.substring_index(col(c), "/", -1)


def extension(c: C) -> Column:
    """Last dot and what follows, of the last path segment; empty if there is none or the name only starts with one."""
    return F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1)


def stem_path(c: C) -> Column:
    return F.regexp_replace(col(c), r"\.[^.]*$", "")


def top_dir(c: C) -> Column:
    return F.when(F.instr(col(c), "/") > 0, F.substring_index(col(c), "/", 1)).otherwise("(root)")


def is_secret_file(c: C) -> Column:
    body = "|".join(re.escape(p).replace(r"\*", ".*") for p in SECRET_FILES)
    return F.lower(basename(c)).rlike(rf"(?s)^(?:{body})$")


def is_binary_file(c: C) -> Column:
    return F.lower(extension(c)).isin(BINARY_EXTENSIONS)


def is_binary_content(c: C) -> Column:
    return F.position(F.lit(b"\x00"), F.substring(col(c), 1, 8192)) > 0


def normalize_license(c: C) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LICENSE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, col(c)), col(c))


def classify_license(c: C) -> Column:
    """permissive, copyleft or unknown; in an OR the permissive branch wins, in AND and WITH the copyleft one."""
    n = normalize_license(text(c))
    parts = F.filter(F.transform(F.split(n, r"\s+(?:OR|AND|WITH)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    named = F.transform(parts, normalize_license)
    free, left = (F.arrays_overlap(named, F.array(*[F.lit(x) for x in known])) for known in (PERMISSIVE, COPYLEFT))
    either = F.upper(n).contains(" OR ")
    return F.when(either & free, "permissive").when(left, "copyleft").when(free, "permissive").otherwise("unknown")


def purl(ecosystem: C, name: C, version: C) -> Column:
    n = F.when(col(ecosystem) == "npm", F.replace(col(name), F.lit("@"), F.lit("%40"))).otherwise(col(name))
    tail = F.when(F.length(text(version)) > 0, F.concat(F.lit("@"), col(version))).otherwise("")
    return F.concat(F.lit("pkg:"), col(ecosystem), F.lit("/"), n, tail)


def spdx_id(c: C) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z0-9-]", "-")


def symbol_id(file: C, qualified: C, kind: C) -> Column:
    """{file}::{qualified}#{kind} with separators escaped and lengths bounded."""
    f = F.replace(col(file), F.lit("::"), F.lit("%3A%3A"))
    q = F.left(F.replace(col(qualified), F.lit("#"), F.lit("%23")), F.lit(400))
    tail = F.when(F.length(text(kind)) > 0, F.concat(F.lit("#"), col(kind))).otherwise("")
    return F.left(F.concat(f, F.lit("::"), q, tail), F.lit(500))


def rounded_ms(c: C) -> Column:
    """Milliseconds to the nearest ten, halves up."""
    return (F.floor((col(c) + 5) / 10) * 10).cast("int")


def docstring_summary(c: C) -> Column:
    """First sentence of a docstring, redacted, at most 120 characters and 15 words."""
    first = F.trim(F.substring_index(F.trim(text(c)), "\n", 1))
    first = F.when(F.instr(first, ".") > 0, F.concat(F.substring_index(first, ".", 1), F.lit("."))).otherwise(first)
    return F.array_join(F.slice(F.split(redact_secrets(F.left(first, F.lit(120))), r"\s+"), 1, 15), " ")


def signature_summary(kind: C = "kind", name: C = "name", signature: C = "signature") -> Column:
    k = col(kind)
    label = F.when(k == "class", F.concat(F.lit("Class "), col(name))).when(k == "constant", F.concat(F.lit("Constant "), col(name))).when(k == "type", F.concat(F.lit("Type definition "), col(name)))
    return F.coalesce(label, F.when(F.length(text(signature)) > 0, F.left(col(signature), F.lit(120))), F.concat(k, F.lit(" "), col(name)))
