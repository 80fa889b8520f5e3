"""Facts of paths, names and highlights as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of a file ending.
ENDINGS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".r": "r",
    ".m": "objc",
    ".mm": "objcpp",
}
SUFFIX = r"^.+(\.[^.]+)$"
NAMED_IN_SIGNATURE = r"(?:def|async\s+def|function|class)\s+(\w+)"
NAMED_IN_CODE = r"(?:def|async\s+def|function)\s+(\w+)\s*\("


def name(path: Column) -> Column:
    """The last part of a path; slashes at its end don't count."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/", -1), -1)


def parent(path: Column) -> Column:
    """The path without its last part; a dot for a bare name, a slash below the root."""
    up = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"^(.*?)/+[^/]*$", 1)
    whole = F.regexp_replace(path, "/+$", "")
    return F.when(~whole.contains("/"), ".").when(up == "", "/").otherwise(up)


def suffix(path: Column) -> Column:
    """The ending with its dot; none where the only dot begins or ends the name."""
    return F.regexp_extract(name(path), SUFFIX, 1)


def stem(path: Column) -> Column:
    own = name(path)
    return F.substring(own, F.lit(1), F.length(own) - F.length(suffix(path)))


def test_path(path: Column) -> Column:
    """Where the test of a file would be: beside it."""
    up = parent(path)
    return F.concat(F.when(up == ".", "").when(up == "/", "/").otherwise(F.concat(up, F.lit("/"))), F.lit("test_"), name(path))


def detected_language(path: Column) -> Column:
    """The language by the ending, whatever its case; "unknown" for others and null."""
    low = F.lower(suffix(path))
    out = F.lit("unknown")
    for ending, language in ENDINGS.items():
        out = F.when(low == ending, language).otherwise(out)
    return out


def glob_pattern(glob: str) -> str:
    """A regular expression for a file pattern: * any characters, ? one, [..] one of a set, [!..] one not of it."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "[" and end > 0:
            inside, not_ = glob[i + 1 : end], glob[i + 1] == "!"
            out += "[" + "^" * not_ + re.sub(r"[\\\[\]^&]", r"\\\g<0>", inside[not_:]) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return rf"(?s)^{out}\z"


def glob_matches(value: Column, glob: str) -> Column:
    return value.rlike(glob_pattern(glob))


def function_name(known: Column, signature: Column, code: Column) -> Column:
    """A name that is known, else the one in the signature, else the first function in the code; null if there is none."""
    found = [F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1) for text, pattern in ((signature, NAMED_IN_SIGNATURE), (code, NAMED_IN_CODE))]
    return F.coalesce(F.nullif(known, F.lit("")), *[F.nullif(x, F.lit("")) for x in found])


def first_highlight(*lists: Column) -> Column:
    """The head of the first list that has any, in the order given; null if none has."""
    return F.coalesce(*[F.when(F.size(x) > 0, F.get(x, F.lit(0))) for x in lists])


def exact_tokens(query: Column, most: int = 200) -> Column:
    """Quoted phrases, then numbers of two digits or more that stand alone: trimmed, cut at ``most`` characters, without characters beyond printable ASCII."""
    quoted = F.transform(F.regexp_extract_all(query, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    numbers = F.regexp_extract_all(query, F.lit(r"(?U)(?<![\w.])(\d{2,})(?![\w.])"), F.lit(1))
    trimmed = F.transform(F.concat(quoted, numbers), lambda x: F.trim(x))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.regexp_replace(F.substring(x, 1, most), "[^ -~]", ""))
